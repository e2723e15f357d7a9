"""Text functions, chunks and normalisers on hand-made edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import chunk, normalize, quality


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_clean_markup(spark):
    got = values(spark, ["[[p]]a[[/p]]", "[[r uuid:x]]b [[P]]", "  x  \n y ", ""], X.clean_markup)
    assert got == ["a", "b [[P]]", "x y", ""]


def test_clean_html(spark):
    got = values(spark, ["<script>\na</script>x<style a='b'>\n</style>", "a&nbsp;&amp;lt;b", "&#39;q&eacute;z", "<p>a</p><p>b</p>"], X.clean_html)
    assert got == ["x", "a <b", "q z", "a b"]


def test_courts_and_dates(spark):
    assert values(spark, ["Mendoza\nCámara Primera del Trabajo\nx", "S.C.J. - Sala II\n", "Juzgado N° 3", "nada", "X sala II y"], X.court_of) == ["Cámara Primera del Trabajo", "S.C.J. - Sala II", "Juzgado N° 3", "", "X sala II"]
    assert values(spark, ["a 15 de marzo de 2024 b", "1/2/2024", "2024-05-06", "x"], X.date_text_of) == ["15 de marzo de 2024", "1/2/2024", "2024-05-06", ""]
    assert values(spark, ["03/04/2021", "3/4/2021", ""], X.iso_date) == ["2021-04-03", "3/4/2021", ""]
    assert values(spark, ["en 1999 y 2001", "99", None], X.year_of) == [1999, None, None]


def test_lists_ids_and_headers(spark):
    assert values(spark, ["A - B -  - C", "", None], lambda c: X.split_list(c, " - ")) == [["A", "B", "C"], [], []]
    assert values(spark, ["a", "a_c0", "a_c12", "a_c1_c2", "_c1", "a_cx"], X.base_id) == ["a", "a", "a", "a_c1", "_c1", "a_cx"]
    assert values(spark, ["I. Uno", "VISTOS", "IX. no", "12", "Texto", None], X.is_header) == [True, True, False, False, False, False]
    assert values(spark, ["```json\n{\"a\":1}\n```", "```\n[1]```", "{}"], X.fenced_json) == ['{"a":1}', "[1]", "{}"]
    assert values(spark, ["  a b c ", "", None], X.words) == [3, 0, 0]
    assert values(spark, ["<razonamiento>why</razonamiento>{}", "{}"], X.after_reasoning) == ["{}", "{}"]
    assert values(spark, ["Despido y DAÑO, ley 20", "nada"], X.legal_hits) == [3, 0]


#: Texts and their chunks of 40 characters at most, worked out by hand from the rules.
CHUNKS = [
    ("short", ["short"]),
    ("x" * 40, ["x" * 40]),
    ("x" * 41, ["x" * 41]),  # one sentence is never cut
    ("aaaa bbbb cccc dddd\n\neeee ffff gggg\n\nhhhh iiii jjjj", ["aaaa bbbb cccc dddd\n\neeee ffff gggg", "hhhh iiii jjjj"]),
    ("one two three four. five six seven eight. nine ten eleven", ["one two three four.", "five six seven eight. nine ten eleven"]),
    ("line number one here\nline number two here\nline three", ["line number one here", "line number two here line three"]),
    ("y" * 50 + ". z", ["y" * 50 + ".", "z"]),
    (" " * 41, [" " * 40]),  # nothing is left, so the start is the chunk
    (None, [""]),
]


def test_chunks_by_hand(spark):
    assert values(spark, [t for t, _ in CHUNKS], lambda c: chunk.chunks(c, 40)) == [own for _, own in CHUNKS]


def test_chunks_keep_the_text(spark):
    """All that isn't white space stays in its order; a chunk is over the limit only if it is one sentence; ids name the chunks."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab ", "cde. ", "f\n", "gh\n\n", "ijklmnop", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    for text, own in zip(texts, values(spark, texts, lambda c: chunk.chunks(c, 40))):
        assert "".join("".join(own).split()) == "".join(text.split())
        assert own == [text] if len(text) <= 40 else all(c == c.strip() for c in own)
        assert all(len(c) <= 40 or not {". ", "\n"} & {c[k : k + n] for k in range(len(c)) for n in (1, 2)} for c in own)
    df = spark.createDataFrame([("d", CHUNKS[3][0], "s"), ("e", "x", "s")], "id string, texto string, source string")
    assert [(r.id, r.texto, r.chunk_index, r.total_chunks) for r in chunk.chunk_documents(df, most=40).orderBy("id").collect()] == [("d_c0", CHUNKS[3][1][0], 0, 2), ("d_c1", CHUNKS[3][1][1], 1, 2), ("e", "x", 0, 1)]


def test_lists_drop_what_is_nothing(spark):
    df = spark.createDataFrame([(json.dumps({"texto": "T" * 120, "magistrados": ["A", None, False, 0, 7, "", " ", "false", "0"]}),)], "value string")
    assert normalize.normalize_variant(df).first().magistrados == ["A", "7", "false", "0"]


def test_chamber_entries(spark):
    long = "z" * 300
    rows = [("u1", "e1", long, "", "SALA I", "2020-01-02", "6-6"), ("", "e2", long, "A c/ B", None, "", "9-9"), (None, "", long, "c", "t", "f", "1-1"), ("u3", "e", "short", "c", "t", "f", "1-1")]
    got = {r.source_id: r for r in normalize.normalize_chamber(spark.createDataFrame(rows, "uuid string, expediente string, texto string, caratula string, tribunal string, fecha string, jurisdiccion string")).collect()}
    assert {k: (r.caratula, r.tribunal, r.jurisdiccion, r.tipo_tribunal) for k, r in got.items()} == {"u1": ("e1", "SALA I", "Cordoba", "camara"), "e2": ("A c/ B", "", "9-9", "camara")}


@pytest.mark.parametrize(
    ("text", "reason"),
    [("a" * 499, "texto muy corto"), ("a" * 500, None), ("ART. 280" + "a" * 1991, "art. 280 CPCCN"), ("art. 280" + "a" * 1992, None), ("desestímase" + "a" * 1488, "desestimacion breve"),
     ("desestimase" + "a" * 1489, None), ("dase por desistido desestimase" + "a" * 600, "desestimacion breve"), ("dase por desistido" + "a" * 600, "desistimiento"), ("caducidad de instancia" + "a" * 600, "caducidad de instancia"), (None, "texto muy corto")],
)
def test_noise(spark, text, reason):
    got = values(spark, [text], quality.noise_reason)[0]
    assert (got or "").split(" (")[0] == (reason or "")


def test_input_gate(spark):
    got = spark.createDataFrame([(0, "x" * 14), (1, "aaaaaaa bbbbbbbbb"), (2, "despido sin contrato firmado"), (3, "hola que tal como va"), (4, None)], "i int, t string")
    verdicts = {r.i: r.verdict for r in quality.validate_input(got, "t", F.lit(False)).collect()}
    assert verdicts == {0: "too_short", 1: "few_words", 2: "accepted", 3: "rejected", 4: "too_short"}


def test_variant_rows(spark):
    body = "T" * 120
    raw = [
        {"texto-completo": body, "id-infojus": "X1", "jurisdiccion": {"nombre": "CABA"}, "descriptores": {"descriptor": ["DESPIDO", "TRABAJO ", None]}, "magistrados": "Dr. A, Dr. B; C/D", "referencias-normativas": {"referencia": [{"descripcion": "Ley 1"}, "Ley 2"]}},
        {"texto": body, "descriptores": "UNO - DOS", "materia": "PENAL", "magistrados": ["A", " B "], "referencias-normativas": "Ley 3", "sala": ["I", "", "II"]},
        {"texto": body, "descriptores": "UNO, DOS", "referencias-normativas": {"otra": "Ley 4", "n": 3}, "tribunal": 7},
        {"texto": "short"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in raw] + [("{bad",), (None,)], "value string")
    got = {(r.source_id, r.descriptores[1] if r.descriptores else None, r.materia): r for r in normalize.normalize_variant(df).collect()}
    assert len(got) == 3
    one, two, three = got["X1", "TRABAJO", "laboral"], got["", "DOS", "penal"], got["", "DOS", ""]
    assert (one.jurisdiccion, one.magistrados, one.referencias_normativas, one.tipo_documento) == ("CABA", ["Dr. A", "Dr. B", "C", "D"], ["Ley 1", "Ley 2"], "fallo")
    assert (two.magistrados, two.referencias_normativas, two.sala) == (["A", "B"], ["Ley 3"], "I, II")
    assert (three.referencias_normativas[:1], three.tribunal) == (["Ley 4"], "7")


def test_flat_rulings_and_records(spark):
    text = "Mendoza, 3 de mayo de 2020. CÁMARA Segunda\n" + "x" * 90
    r = normalize.normalize_rulings(spark.createDataFrame([(text, "", "t", "9", "A - B", "1", "DERECHO CIVIL"), ("short", "", "", "", "", "", "")], "sentencia string, resumen string, texto string, fallo string, voces string, sumario string, materia string")).collect()
    assert len(r) == 1 and (r[0].sumario, r[0].materia, r[0].voces, r[0].fecha, r[0].tribunal) == ("t", "civil", ["A", "B"], "3 de mayo de 2020", "CÁMARA Segunda")
    c = normalize.normalize_records(spark.createDataFrame([("7", "y" * 300, "", "sint", "a, b"), ("8", "y", "", "", "")], "codigo string, texto string, sumario string, sintesis string, voces string")).collect()
    assert len(c) == 1 and (c[0].source_id, c[0].sumario, c[0].voces, c[0].tipo_fallo) == ("7", "sint", ["a", "b"], "sentencia")


def test_result_blocks(spark):
    html = 'x <a href="/v/sentencia-SGU-ab12-3f.pdf">p</a> Tribunal: SALA I<br>CNT 12345/2019/CA1 Carátula: A c/ B\n Fecha sentencia: 01/02/2020 <a href="http://h/sentencia-ff.pdf?x=1">'
    got = normalize.parse_result_blocks(spark.createDataFrame([(html,)], "html string")).collect()
    assert [tuple(r) for r in got] == [("https://example.org/v/sentencia-SGU-ab12-3f.pdf", "ab12-3f", "CNT 12345/2019/CA1", "SALA I", "A c/ B", "2020-02-01"), ("http://h/sentencia-ff.pdf?x=1", "ff", "", "", "", "")]


def test_months_and_work_list(spark):
    got = [(str(r.m_start), str(r.m_end)) for r in normalize.month_ranges(spark.createDataFrame([("2013-12-15",), ("2013-08-30",)], "end string")).orderBy("m_start").collect()]
    assert got == [("2013-09-01", "2013-09-30"), ("2013-10-01", "2013-10-31"), ("2013-11-01", "2013-11-30"), ("2013-12-01", "2013-12-15")]
    work = normalize.work_list(["a", "b"], ["x"], "2013-10-10", spark).orderBy("position").collect()
    assert [(r.jurisdiction, str(r.m_start)) for r in work] == [("a", "2013-10-01"), ("a", "2013-09-01"), ("b", "2013-10-01"), ("b", "2013-09-01")]


def test_all_noise_rules_over_whole_texts(spark, tmp_path):
    """Each rule just below and at its length, by the queries over all documents and by their SQL."""
    import duckdb

    from docmill.plans import catalogue

    marks = [("ART. 280", 2000), ("artículo 280", 2000), ("Desestímase", 1500), ("dase por desistido", 1500), ("caducidad de instancia", 1500), ("nada", 500)]
    rows = [(i, m + "x" * (n - len(m)), "en", "s") for i, (m, n) in enumerate((m, most - less) for m, most in marks for less in (0, 1))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, n in (("quality_filter", 12), ("auto_inadmissible", 6)):
        got = catalogue.queries()[name](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == n
    told = {r.doc_id: r.noise_reason for r in catalogue.queries()["quality_filter"](spark, str(tmp_path)).collect()}
    assert sorted(i for i, r in told.items() if r) == [1, 3, 5, 7, 9, 11]


def test_records_are_parsed_once(spark):
    """Filters and columns on what is read from a record don't make the plan parse it again."""
    from docmill.operators import normalize

    rows = spark.createDataFrame([('{"texto": "' + "x" * 120 + '", "guid": "a"}',), ('{"texto": "short"}',), ("{bad",), (None,)], "value string")
    docs = normalize.normalize_variant(rows)
    assert docs._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert [r.source_id for r in docs.collect()] == ["a"]


def test_json_lines_of_wrong_types(spark, tmp_path):
    """A field of a wrong type is empty and the others stay; lines that are no JSON fall out."""
    from docmill.sources import jsonl

    (tmp_path / "a.jsonl").write_text('{"id": "1", "voces": "x", "chunk_index": "y", "texto": 5}\n{"id": "2", "voces": ["a", null]}\n{"id": "3"} rest\n\n{"id": null}\n', encoding="utf-8")
    found = {r.id: (r.voces, r.chunk_index, r.texto) for r in jsonl.documents(spark, str(tmp_path)).collect()}
    assert found == {"1": ([], 0, "5"), "2": (["a", None], 0, ""), "": ([], 0, "")}
