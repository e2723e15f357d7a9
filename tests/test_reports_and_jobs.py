"""Report texts, page parsers and the batch jobs."""

import json

from pyspark.sql import functions as F

from docmill import jobs
from docmill.engine import Engine
from docmill.functions import report
from docmill.operators import analyze, usage


def test_synthesis_report(spark):
    row = spark.createDataFrame([(2, 1, 1, 50.0, "Demandar", [("despido", 66.6, 3)] * 7, ["r1"], [f"n{i}" for i in range(12)], "N/D")], "total_analizados int, favorables int, desfavorables int, porcentaje_favorable double, recomendacion_estrategica string, estrategias_exitosas array<struct<estrategia:string,tasa_exito:double,frecuencia:int>>, riesgos array<string>, normas_clave array<string>, rango_quantum string")
    text = row.select(report.synthesis_report(row.columns)).first()[0]
    assert text.startswith("ESTADÍSTICAS: 2 fallos analizados\n  Favorables: 1 | Desfavorables: 1 | Parciales: 0 | Inadmisibles: 0\n  Probabilidad favorable: 50%\n\nRECOMENDACIÓN ESTRATÉGICA:\nDemandar\n\nESTRATEGIAS EXITOSAS:\n  • despido (éxito: 67%, 3 casos)")
    assert text.count("•") == 6 and "n9" in text and "n10" not in text and "MONTOS" not in text and text.endswith("RIESGOS:\n  • r1")
    assert row.select(F.lit("").alias("x")).select(report.synthesis_report(["x"])).first()[0] == "Síntesis completada."


def test_narrative(spark):
    row = spark.createDataFrame([("A", "T", "2020", "parcial", "amparo", ["l1", "l2"], "unánime", "N/D")], "caratula string, tribunal string, fecha string, resultado string, via_procesal string, normas_citadas array<string>, votos string, quantum string")
    assert row.select(report.narrative(dict(row.dtypes))).first()[0] == 'Analicé "A" (T, 2020).\n\nResultado: PARCIALMENTE favorable.\nLlegó al tribunal por: amparo.\n\nNormas invocadas: l1, l2.'


def test_page_parsers(spark):
    df = spark.createDataFrame([('<option value="1">Uno</option><option value="2" selected>Dos</option> 1.234 resultados',), ("",)], "h string")
    rows = df.select(report.options(F.col("h")).alias("o"), report.result_total(F.col("h")).alias("n")).collect()
    assert [tuple(x) for x in rows[0].o] == [("1", "Uno"), ("2", "Dos")] and rows[0].n == 1234 and rows[1].n is None


def test_jobs(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = [{"texto": f"T{i} " * 300, "guid": f"g{i}", "descriptores": "laboral"} for i in range(3)] + [{"texto": "short"}]
    (raw / "dataset.jsonl").write_text("\n".join(map(json.dumps, lines)))
    clean, chunks, texts, stored, mark = (str(tmp_path / x) for x in ("clean", "chunks", "texts", "stored", "mark"))
    jobs.main(["normalize", "--source", str(raw), "--out", clean])
    assert spark.read.json(clean).count() == 3
    jobs.main(["chunk", "--source", clean, "--out", chunks])
    jobs.main(["store", "--source", clean, "--out", texts])
    assert spark.read.parquet(chunks).count() == 3 and spark.read.parquet(texts).count() == 3
    for _ in range(2):
        jobs.main(["ingest", "--source", clean, "--out", stored, "--checkpoint", mark])
    assert jobs.status(spark, stored).first().n == 3
    jobs.main(["status", "--out", stored])
    synced, history = str(tmp_path / "synced"), str(tmp_path / "history")
    for _ in range(2):
        jobs.main(["sync", "--source", clean, "--out", synced, "--checkpoint", str(tmp_path / "mark2"), "--history", history])
    assert [(r.previous_total, r.new_total, r.new_written) for r in spark.read.parquet(history).orderBy("at").collect()] == [(0, 3, 3), (3, 3, 0)]
    index, queries, marks = (str(tmp_path / x) for x in ("index", "queries.jsonl", "marks"))
    (tmp_path / "queries.jsonl").write_text("\n".join(map(json.dumps, [{"query_id": 1, "q": "laboral", "kw": ["t1", "nope"]}, {"query_id": 2, "q": "absent", "kw": ["t1"]}])))
    jobs.main(["index", "--source", clean, "--out", index])
    jobs.main(["benchmark", "--source", clean, "--index", index, "--queries", queries, "--out", marks])
    assert [(r.query_id, round(r.precision), r.n) for r in spark.read.parquet(marks).orderBy("query_id").collect()] == [(1, 33, 3), (2, 0, 0)]


def test_chamber_entries_by_the_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"uuid": "u1", "expediente": "e", "texto": "x" * 300, "caratula": "A", "tribunal": "T", "fecha": "01/02/2020", "jurisdiccion": "13-18"}, {"uuid": "", "expediente": "", "texto": "x" * 300, "jurisdiccion": "q"}, {"uuid": "u2", "expediente": "", "texto": "short", "jurisdiccion": ""}]
    (tmp_path / "in" / "c.json").write_text("\n".join(map(json.dumps, rows)))
    jobs.main(["normalize", "--source", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--kind", "chamber"])
    assert [(r.source_id, r.jurisdiccion, r.caratula) for r in spark.read.json(str(tmp_path / "out")).collect()] == [("u1", "San Juan", "A")]


def test_ruling_summary(spark):
    rows = spark.createDataFrame([(1, '{"hechos": "h", "articulos_citados": ["a"]}'), (2, '{"hechos": "h'), (3, None), (4, "[1]")], "id int, answer string")
    got = {r.id: r.summary for r in analyze.ruling_summary(rows, F.col("answer")).collect()}
    assert got[1].hechos == "h" and got[1].articulos_citados == ["a"] and got[1].resolucion == ""
    assert all(got[i].hechos == "Error al procesar el fallo" and got[i].articulos_citados == [] for i in (2, 3, 4))


def test_ingest_stats_with_time(spark):
    rows = spark.createDataFrame([("written",)] * 30 + [("skipped",)] * 30, "status string")
    got = usage.ingest_stats(rows, total=240, elapsed=30.0).first()
    assert (got.processed, got.percent, got.per_second, got.eta_minutes) == (60, 25.0, 2.0, 1.5)
    assert usage.ingest_stats(rows, elapsed=30.0).first().eta_minutes is None


def test_analysis_in_steps(spark):
    docs = spark.createDataFrame([(str(i), f"despido {i}", "despido sin causa " * 60, "T", "laboral", "2020", [1.0, float(i)]) for i in range(5)], "id string, caratula string, texto string, tribunal string, materia string, fecha string, embedding array<double>").withColumn("sumario", F.lit("")).withColumn("source", F.lit("s"))
    read = []
    reader = lambda df: read.append(1) or df.select(F.col("id").alias("source_id"), F.lit("favorable").alias("resultado"), F.array(F.lit("l")).alias("normas_citadas"))
    steps = Engine(spark, docs, docs, docs, lambda texts: [[1.0, 0.0]] * len(texts)).analyze_stream("despido sin causa", reader)
    assert next(steps)[0] == "hits" and next(steps)[0] == "saving" and not read
    rest = dict(steps)
    assert list(rest) == ["readings", "analyses", "counts", "favourable", "norms", "contradictions", "synthesis"] and len(read) == 1
    assert rest["counts"].first().favorable == 5
