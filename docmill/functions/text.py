"""Text functions, Column to Column. White space is Unicode white space, lengths and cuts are in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

# Subject by keyword, the first that is found wins.
SUBJECTS = [("laboral", "laboral"), ("trabajo", "laboral"), ("civil", "civil"), ("penal", "penal"), ("comercial", "comercial"), ("familia", "familia"), ("contencioso", "contencioso administrativo")]

# Subject names of the dash-separated source.
SUBJECT_NAMES = {"DERECHO DEL TRABAJO": "laboral", "DERECHO CIVIL": "civil", "DERECHO PROCESAL": "procesal"}

# Patterns of courts and dates in a ruling's first lines, in order.
COURT_PATTERNS = [
    r"(?:SUPREMA CORTE DE JUSTICIA|S\.?C\.?J\.?)\s*[-–]\s*(.+?)(?:\n|$)",
    r"(?:CÁMARA|CAMARA)\s+(.+?)(?:\n|$)",
    r"(?:JUZGADO)\s+(.+?)(?:\n|$)",
    r"^(.+?(?:SALA|sala)\s+\w+)",
]
DATE_PATTERNS = [r"\d{1,2}\s+de\s+\w+\s+de\s+\d{4}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{4}-\d{2}-\d{2}"]

# Words of legal cases.
LEGAL_WORDS = (
    r"despido|accidente|daño|responsabilidad|contrato|demanda|recurso|amparo|cautelar|ejecuci[oó]n|quiebra|concurso|"
    r"prescripci[oó]n|inconstitucionalidad|alimento|divorcio|usucapi[oó]n|homicidio|estafa|habeas|apelaci[oó]n|laboral|"
    r"penal|civil|comercial|tributari[oa]|societari[oa]|mala\s*praxis|indemnizaci[oó]n|art[íi]culo|ley\s*\d|c[oó]digo|"
    r"LCT|CCyCN|CSJN|AFIP|ART\b|fallo|sentencia|juzgado|tribunal|c[aá]mara|emplead[oa]|imputad[oa]|heredero|locaci[oó]n|"
    r"desalojo|hipoteca|honor[aá]rios|costas|prueba|pericia|embargo|medida"
)


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def present(c: Column) -> Column:
    """c, or null where it is empty: coalesce(present(a), b) is "a or b"."""
    return F.nullif(c, F.lit(""))


def once(c: Column) -> Column:
    """c as the one row of a generator: filters and columns that use it don't make the optimizer work it out again."""
    return F.explode(F.array(c))


def json_value(c: Column) -> Column:
    """The JSON value of a text as a variant; null for bad JSON, also where other text follows the value."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$[0]", "variant")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_markup(c: Column) -> Column:
    """Without [[tag ...]] and [[/tag]] of lower-case tags; white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\[\[/?[a-z]+(?:(?U:\s)[^\]]*?)?\]\]", ""), r"(?U)\s+", " "))


def clean_html(c: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags go, four entities are decoded, other named ones become blanks, numeric ones go."""
    steps = [
        (r"(?s)<script[^>]*>.*?</script>", " "), (r"(?s)<style[^>]*>.*?</style>", " "), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        (r"&[a-z]+;", " "), (r"&#\d+;", ""), (r"(?U)\s+", " "),
    ]
    return strip(reduce(lambda x, s: F.regexp_replace(x, *s), steps, c))


def first_match(c: Column, patterns: list[str], flags: str) -> Column:
    """What the first of the patterns that is found matches, stripped; empty without any."""
    found = [present(F.regexp_extract(c, flags + p, 0)) for p in patterns]
    return or_empty(strip(F.coalesce(*found)))


def court_of(c: Column) -> Column:
    return F.substring(first_match(F.substring(c, 1, 500), COURT_PATTERNS, "(?diuU)"), 1, 200)


def date_text_of(c: Column) -> Column:
    return first_match(F.substring(c, 1, 1000), DATE_PATTERNS, "(?dU)")


def iso_date(c: Column) -> Column:
    """dd/mm/yyyy as yyyy-mm-dd; anything else unchanged."""
    return F.regexp_replace(c, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")


def year_of(c: Column) -> Column:
    """The first group of four digits as an int, or null."""
    return F.regexp_extract(or_empty(c), r"(\d{4})", 1).try_cast("int")


def split_list(c: Column, separator: str) -> Column:
    """Stripped, non-empty parts; no parts for null."""
    return F.filter(F.transform(F.split(or_empty(c), separator), strip), lambda x: x != "")


def subject_of(explicit: Column, described: Column) -> Column:
    """The given subject in lower case, else that of the first keyword found in the descriptors, else empty."""
    text = F.lower(or_empty(described))
    ladder = reduce(lambda w, s: w.when(text.contains(s[0]), s[1]), SUBJECTS[1:], F.when(text.contains(SUBJECTS[0][0]), SUBJECTS[0][1]))
    return F.coalesce(present(F.lower(strip(or_empty(explicit)))), ladder, F.lit(""))


def subject_name(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in SUBJECT_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, c), F.lower(c))


def sha_id(prefix: str, *keys: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of prefix:key[:key]."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(prefix), *keys), 256), 1, 16)


def base_id(c: Column) -> Column:
    """The document's id of a chunk's id: without the last _c<digits>."""
    return F.regexp_replace(c, r"(?s)^(.+)_c\d+$", "$1")


def labelled(label: str, c: Column) -> Column:
    """'label: value', or null where the value is empty."""
    return F.when(or_empty(c) != "", F.concat(F.lit(f"{label}: "), c))


def embedding_text(caratula: Column, materia: Column, voces: Column, tribunal: Column, sobre: Column, sumario: Column, texto: Column) -> Column:
    """What is embedded for a document: labelled parts, then the summary if it is longer than 50 characters, else the text; 3000 at most."""
    listed = F.array_join(F.slice(voces, 1, 10), ", ")
    content = F.when(F.length(or_empty(sumario)) > 50, sumario).otherwise(texto)
    return F.concat_ws(" | ", labelled("Carátula", caratula), labelled("Materia", materia), labelled("Voces", listed), labelled("Tribunal", tribunal), labelled("Sobre", sobre), F.substring(content, 1, 3000))


def fenced_json(c: Column) -> Column:
    """The text within ``` fences, if there are any; parse it with from_json or try_parse_json."""
    text = strip(c)
    inner = F.regexp_replace(F.regexp_replace(text, r"^```(?U:\w)*\n?", ""), r"\n?```$", "")
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


def ensure_list(kind: Column, as_list: Column, as_text: Column) -> Column:
    """A list as it is, a text other than '' and N/D as its one element, else an empty list."""
    none = F.array().cast("array<string>")
    return F.when(kind.startswith("ARRAY"), F.coalesce(as_list, none)).when((kind == "STRING") & ~as_text.isin("", "N/D"), F.array(as_text)).otherwise(none)


def reasoning_of(c: Column, tag: str = "razonamiento") -> Column:
    """What stands before the first </tag> (or the end), behind the last <tag> there; empty without any <tag>."""
    text = or_empty(c)
    before = F.substring_index(text, f"</{tag}>", 1)
    return F.when(text.contains(f"<{tag}>"), strip(F.substring_index(before, f"<{tag}>", -1))).otherwise("")


def after_reasoning(c: Column, tag: str = "razonamiento") -> Column:
    """The rest behind the last </tag>, or everything where a tag is missing."""
    text = or_empty(c)
    both = text.contains(f"<{tag}>") & text.contains(f"</{tag}>")
    return F.when(both, strip(F.substring_index(text, f"</{tag}>", -1))).otherwise(text)


def words(c: Column) -> Column:
    """The number of words between white space."""
    text = strip(or_empty(c))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"(?U)\s+")))


def legal_hits(c: Column) -> Column:
    """How often the legal lexicon occurs, without regard to case."""
    return F.regexp_count(or_empty(c), F.lit(f"(?iuU)(?:{LEGAL_WORDS})"))


def is_header(c: Column) -> Column:
    """Whether a line is a section header: a Roman numeral of I to VIII with a dot, or all upper case."""
    return F.coalesce(c.rlike(r"^(?:I|II|III|IV|V|VI|VII|VIII)\.") | ((F.upper(c) == c) & (F.lower(c) != c)), F.lit(False))


def percent_label(c: Column, whole: float = 1) -> Column:
    """c in whole percent of `whole`, halves up. Of another whole than 1 the percentage is one division: the share times 100 would miss halves (285000 of a million is 28.499999999999996)."""
    percent = c * 100 if whole == 1 else c / (whole / 100)
    return F.concat(F.round(percent).cast("int").cast("string"), F.lit("%"))


def search_tokens(c: Column) -> Column:
    """Lower-case words without accents."""
    return F.filter(F.split(F.translate(F.lower(or_empty(c)), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def agent_summary(row: dict[str, Column]) -> Column:
    """Lines about one analysis; empty and N/D values are left out, of the norms the first eight are named."""
    shown = lambda label, c, gap="": F.when(~or_empty(c).isin("", "N/D"), F.concat(F.lit(gap + label), c))
    outcome = F.coalesce(row["resultado"], F.lit("N/D"))
    outcome = F.when(outcome.isin("favorable", "desfavorable", "parcial", "inadmisible"), F.upper(outcome)).otherwise(outcome)
    norms = F.array_join(F.slice(F.coalesce(row["normas_citadas"], F.array().cast("array<string>")), 1, 8), ", ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Resultado: "), outcome),
        shown("Carátula: ", row["caratula"]),
        shown("Vía procesal: ", row["via_procesal"]),
        shown("Doctrina: ", row["doctrina_aplicada"]),
        shown("Hechos determinantes:\n", row["hechos_determinantes"], "\n"),
        shown("Argumento clave:\n", row["argumento_clave"], "\n"),
        shown("Relevancia para el caso:\n", row["relevancia_cliente"], "\n"),
        F.when(norms != "", F.concat(F.lit("\nNormas: "), norms)),
        shown("Quantum/Costas: ", row["quantum"]),
    )


def short_day(c: Column) -> Column:
    """A date as yy-MM-dd."""
    return F.date_format(c, "yy-MM-dd")


def json_text(c: Column, key: str) -> Column:
    """A member of a JSON object as text; null where it is absent or the text isn't JSON."""
    return F.try_variant_get(F.try_parse_json(c), f"$.{key}", "string")
