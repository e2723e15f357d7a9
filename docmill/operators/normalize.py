"""Raw records of several sources as documents of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.schema import DOCUMENT

# Keys under which lists of descriptors and references are found.
LIST_KEYS = ("descriptor", "descriptores", "voz", "voces", "items")
REFERENCE_KEYS = ("referencia", "referencias", "norma", "normas", "items")

NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(NONE)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _values(v: Column) -> Column:
    """The members of an object in the order of their keys, as texts, without empty ones."""
    own = F.map_values(F.coalesce(v.try_cast("map<string,string>"), F.create_map().cast("map<string,string>")))
    return F.filter(own, lambda x: x.isNotNull() & (x != ""))


def _true(x: Column) -> Column:
    """Whether a list's element counts: not null, false, zero or empty."""
    kind, text = _kind(x), _get(x, "$")
    nothing = kind.isin("VOID") | ((kind == "BOOLEAN") & (text == "false")) | (kind.rlike("INT|DECIMAL|DOUBLE|FLOAT") & (text.try_cast("double") == 0))
    return ~nothing & (X.or_empty(X.strip(text)) != "")


def _strings(v: Column, path: str = "$") -> Column:
    """A list's truthy elements as stripped texts."""
    own = F.filter(F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>")), _true)
    return F.transform(own, lambda x: X.strip(_get(x, "$")))


def safe_str(v: Column) -> Column:
    """A text from a value of any shape: a name or description of an object, a list's elements joined by commas."""
    kind = _kind(v)
    named = F.coalesce(X.present(_get(v, "$.nombre")), X.present(_get(v, "$.descripcion")), F.to_json(v))
    return (
        F.when(v.isNull() | (kind == "VOID"), "")
        .when(kind.startswith("OBJECT"), named)
        .when(kind.startswith("ARRAY"), F.array_join(F.filter(F.coalesce(_get(v, "$", NONE), _empty()), lambda x: X.or_empty(x) != ""), ", "))
        .otherwise(X.strip(X.or_empty(_get(v, "$"))))
    )


def safe_list(v: Column) -> Column:
    """A list of texts from a value of any shape: known keys of an object, else its values; a text parted at ' - ' or commas."""
    kind, text = _kind(v), X.or_empty(_get(v, "$"))
    keyed = F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("ARRAY"), _strings(v, f"$.{k}")) for k in LIST_KEYS), _values(v))
    parted = F.when(text.contains(" - "), X.split_list(text, " - ")).otherwise(X.split_list(text, ","))
    return F.when(kind.startswith("ARRAY"), _strings(v)).when(kind.startswith("OBJECT"), keyed).when(kind == "STRING", parted).otherwise(_empty())


def references(v: Column) -> Column:
    """Legal references from a value of any shape; of objects the description or text, else their own texts in the order of the keys."""
    kind = _kind(v)

    def under(key: str) -> Column:
        inner = F.try_variant_get(v, f"$.{key}", "variant")
        shape = F.coalesce(F.schema_of_variant(inner), F.lit("VOID"))
        items = F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
        one = lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(X.present(_get(x, "$.descripcion")), _get(x, "$.texto"))).otherwise(_get(x, "$"))
        listed = F.filter(F.transform(items, lambda x: X.strip(one(x))), lambda x: X.or_empty(x) != "")
        single = F.when(shape.startswith("OBJECT"), F.to_json(inner)).otherwise(X.strip(X.or_empty(_get(v, f"$.{key}"))))
        return F.when(shape.startswith("ARRAY"), listed).when(single != "", F.array(single)).otherwise(_empty())

    found = F.flatten(F.array(*(under(k) for k in REFERENCE_KEYS)))
    text = X.strip(X.or_empty(_get(v, "$")))
    members = F.map_values(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    whole = F.filter(F.transform(F.filter(members, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: X.strip(_get(x, "$"))), lambda x: x != "")
    listed = F.transform(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>")), safe_str)
    return (
        F.when(kind.startswith("ARRAY"), F.filter(listed, lambda x: x != ""))
        .when(kind.startswith("OBJECT"), F.when(F.size(found) > 0, found).otherwise(whole))
        .when((kind == "STRING") & (text != ""), F.array(text))
        .otherwise(_empty())
    )


def judges(v: Column) -> Column:
    """A list as it is, a text parted at commas, semicolons and slashes."""
    kind = _kind(v)
    return F.when(kind.startswith("ARRAY"), _strings(v)).when(kind == "STRING", X.split_list(_get(v, "$"), "[,;/]")).otherwise(_empty())


def to_documents(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The document schema with the given columns; the others are empty."""
    blank = {"string": F.lit(""), "array<string>": _empty(), "int": F.lit(0)}
    return df.select(*((columns[f.name] if f.name in columns else blank[f.dataType.simpleString()]).cast(f.dataType).alias(f.name) for f in DOCUMENT.fields))


def normalize_variant(raw: DataFrame, json_col: str = "value", prefix: str = "saij") -> DataFrame:
    """Documents from JSON texts whose fields may have any shape. Bad JSON and texts under 100 characters are dropped."""
    v = raw.select(X.once(X.json_value(F.col(json_col))).alias("v")).where("v IS NOT NULL")
    names = ["texto-completo", "texto", "id-infojus", "guid", "sumario", "caratula", "tipo-fallo", "tribunal", "tipo-tribunal", "sala", "magistrados", "materia", "descriptores", "fecha", "jurisdiccion", "provincia", "localidad", "actor", "demandado", "sobre", "referencias-normativas"]
    fields = v.select(*(F.try_variant_get("v", f"$['{n}']", "variant").alias(n.replace("-", "_")) for n in names))
    s = lambda n: safe_str(F.col(n))
    rows = fields.withColumn("body", F.coalesce(X.present(s("texto_completo")), s("texto"))).where(F.length("body") >= 100)
    source_id = F.coalesce(X.present(s("id_infojus")), s("guid"))
    return to_documents(rows, {
        "id": X.sha_id(prefix, F.coalesce(X.present(source_id), F.substring("body", 1, 200))), "source": F.lit(prefix), "source_id": source_id, "texto": F.col("body"),
        "tipo_documento": F.coalesce(X.present(F.lower(s("tipo_fallo"))), F.lit("fallo")), "magistrados": judges(F.col("magistrados")),
        "materia": X.subject_of(s("materia"), s("descriptores")), "voces": safe_list(F.col("descriptores")), "descriptores": safe_list(F.col("descriptores")),
        "referencias_normativas": references(F.col("referencias_normativas")),
        **{n: s(n) for n in ("sumario", "caratula", "tipo_fallo", "tribunal", "tipo_tribunal", "sala", "fecha", "jurisdiccion", "provincia", "localidad", "actor", "demandado", "sobre")},
    })


def normalize_rulings(raw: DataFrame) -> DataFrame:
    """Documents from flat rulings (sentencia, resumen, texto, fallo, voces, sumario, materia); texts under 100 characters are dropped."""
    c = lambda n: X.strip(X.or_empty(F.col(n)))
    rows = raw.withColumn("body", c("sentencia")).where(F.length("body") >= 100)
    return to_documents(rows, {
        "id": X.sha_id("jurisgpt", X.or_empty(F.col("fallo")), X.or_empty(F.col("sumario"))), "source": F.lit("jurisgpt"), "source_id": X.or_empty(F.col("fallo")), "texto": F.col("body"),
        "sumario": F.coalesce(X.present(c("resumen")), c("texto")), "tipo_documento": F.lit("fallo"), "tipo_fallo": F.lit("sentencia"), "tribunal": X.court_of(F.col("body")),
        "materia": X.subject_name(c("materia")), "voces": X.split_list(F.col("voces"), " - "), "fecha": X.date_text_of(F.col("body")), "jurisdiccion": F.lit("Mendoza"), "provincia": F.lit("Mendoza"),
    })


def normalize_records(raw: DataFrame) -> DataFrame:
    """Documents from supreme court records with their text (codigo, idAnalisis, voces, magistrados, jueces, ...); texts under 300 characters are dropped."""
    have = set(raw.columns)
    c = lambda *names: F.coalesce(*(X.present(F.col(n).cast("string")) for n in names if n in have), F.lit(""))
    key = c("codigo", "idAnalisis")
    return to_documents(raw.where(F.length(X.or_empty(F.col("texto"))) >= 300), {
        "id": X.sha_id("csjn", key), "source": F.lit("csjn"), "source_id": key, "texto": F.col("texto"), "sumario": c("sumario", "sintesis"), "caratula": c("caratula", "titulo"),
        "tipo_documento": F.lit("fallo"), "tipo_fallo": F.coalesce(X.present(c("tipoFallo")), F.lit("sentencia")), "tribunal": F.lit("Corte Suprema de Justicia de la Nacion"),
        "tipo_tribunal": F.lit("corte_suprema"), "magistrados": X.split_list(c("magistrados", "jueces"), ","), "materia": c("materia"), "voces": X.split_list(c("voces"), ","),
        "fecha": c("fecha"), "jurisdiccion": F.lit("Nacional"), "provincia": F.lit("Ciudad Autonoma de Buenos Aires"),
    })


# The names of jurisdictions by their codes.
JURISDICTIONS = {
    "5-5": "Ciudad de Buenos Aires",
    "1-1": "Buenos Aires",
    "6-6": "Cordoba",
    "13-13": "Mendoza",
    "17-17": "Salta",
    "17-10": "Jujuy",
    "7-7": "Corrientes",
    "3-3": "Chaco",
    "4-4": "Chubut",
    "8-8": "Entre Rios",
    "3-9": "Formosa",
    "1-11": "La Pampa",
    "6-12": "La Rioja",
    "14-14": "Misiones",
    "16-15": "Neuquen",
    "16-16": "Rio Negro",
    "13-18": "San Juan",
    "24-2": "Catamarca",
}


def normalize_chamber(entries: DataFrame) -> DataFrame:
    """Documents from chamber entries with their text (uuid, expediente, texto, caratula, tribunal, fecha, jurisdiccion as a code).

    The key is the uuid, else the expediente; entries without one and texts under 300 characters are dropped. An unknown code stays as it is.
    """
    c = lambda *names: F.coalesce(*(X.present(F.col(n)) for n in names), F.lit(""))
    key, code = c("uuid", "expediente"), X.or_empty(F.col("jurisdiccion"))
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in JURISDICTIONS.items() for x in pair)), code), code)
    rows = entries.where((key != "") & (F.length(X.or_empty(F.col("texto"))) >= 300))
    return to_documents(rows, {
        "id": X.sha_id("pjn", key), "source": F.lit("pjn_tribunales"), "source_id": key, "texto": F.col("texto"), "caratula": c("caratula", "expediente"), "tipo_documento": F.lit("fallo"),
        "tipo_fallo": F.lit("sentencia"), "tribunal": c("tribunal"), "tipo_tribunal": F.lit("camara"), "fecha": c("fecha"), "jurisdiccion": named,
    })


def newest_days(df: DataFrame, day_col: str, year: int | None = None) -> DataFrame:
    """Rows by their dd/mm/yyyy day, newest first, of one year if asked; days are compared as the texts of year, month and day."""
    own = df if year is None else df.where(F.endswith(F.col(day_col), F.lit(str(year))))
    return own.orderBy(F.desc(F.reverse(F.split(day_col, "/"))))


# The patterns below are those of the source's result pages.
def parse_result_blocks(pages: DataFrame, html_col: str = "html", base: str = "https://example.org") -> DataFrame:
    """One row for each linked ruling in pages of search results: pdf_url, uuid, expediente, tribunal, caratula, fecha."""
    # The patterns of the source's result pages.
    blocks = pages.select(F.explode(F.split(X.or_empty(F.col(html_col)), r'(?=href="[^"]*sentencia-)')).alias("block"))
    get = lambda p: F.regexp_extract("block", p, 1)
    rows = blocks.withColumn("link", get(r'href="([^"]*sentencia-[^"]+\.pdf[^"]*)"')).where("link != ''")
    return rows.select(
        F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit(base + "/"), F.ltrim("link", F.lit("/")))).alias("pdf_url"),
        F.regexp_extract("link", r"sentencia-(?:SGU-)?([a-f0-9-]+)\.pdf", 1).alias("uuid"),
        get(r"([A-Z]{2,5}\s+\d{4,}/\d{4}[^\s<]*)").alias("expediente"),
        X.strip(get(r"(?i)Tribunal:\s*([^<\n]+)")).alias("tribunal"),
        X.strip(get(r"(?i)tula:\s*([^<\n]+)")).alias("caratula"),
        X.iso_date(get(r"(?i)sentencia:\s*(\d{2}/\d{2}/\d{4})")).alias("fecha"),
    )


def month_ranges(df: DataFrame, end_col: str = "end", since: str = "2013-08-21") -> DataFrame:
    """m_start, m_end for each month whose first day isn't before `since`, up to each row's end; the last one ends there."""
    first = F.add_months(F.trunc(F.date_sub(F.lit(since).cast("date"), 1), "month"), 1)
    months = df.select(F.col(end_col).cast("date").alias("e")).where(F.trunc("e", "month") >= first).select("e", F.explode(F.sequence(first, F.trunc("e", "month"), F.expr("interval 1 month"))).alias("m_start"))
    return months.select("m_start", F.least(F.last_day("m_start"), F.col("e")).alias("m_end"))


def work_list(jurisdictions: list[str], courts: list[str], end: str, spark, since: str = "2013-08-21") -> DataFrame:
    """Jurisdictions by courts by months, numbered in that order, newest month first. All three lists are parameters, not data."""
    pairs = spark.createDataFrame([(i * len(courts) + j, a, b) for i, a in enumerate(jurisdictions) for j, b in enumerate(courts)], "pair int, jurisdiction string, court string")
    months = month_ranges(pairs.select("pair", "jurisdiction", "court", F.lit(end).alias("end")), "end", since).distinct().orderBy(F.desc("m_start"))
    listed = [(r.m_start, r.m_end) for r in months.collect()]
    rows = pairs.select("*", F.posexplode(F.array(*(F.struct(F.lit(a).alias("m_start"), F.lit(b).alias("m_end")) for a, b in listed))).alias("k", "m"))
    return rows.select((F.col("pair") * len(listed) + F.col("k")).alias("position"), "jurisdiction", "court", "m.m_start", "m.m_end")
