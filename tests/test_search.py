"""Search, funnel stages, stores, analytics, streaming and the facade."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from docmill.engine import Engine, embed, overlap_score, read_rulings
from docmill.operators import analyze, evaluate, keyword, keyword_index, quality, rank, store, usage, vector
from docmill.sources import jsonl
from docmill.streaming import ingest

DOCS = [
    (1, "Ley 24.557 de riesgos", "La acción por accidente según ley 24.557 y el daño"), (2, "Despido", "despido sin causa; el despido fue injusto. 24 horas y 557 pesos"), (3, "Contrato", "contrato de locación y daño"),
    (4, "Acción", "acción de amparo. ACCION"), (5, "Otro", "nada que ver aquí con el daño"), (6, "Vacío", ""),
]


def test_bm25_matches_fts5(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body)")
    db.executemany("INSERT INTO f(rowid, title, body) VALUES (?, ?, ?)", DOCS)
    queries = {1: "accion por daño", 2: "24.557 despido", 3: "despido contrato nada", 4: "el la de"}
    hits = keyword.bm25(spark.createDataFrame(DOCS, "doc_id int, title string, body string"), spark.createDataFrame(list(queries.items()), "query_id int, q string"), 10, columns=("title", "body")).collect()
    for k, q in queries.items():
        match = " OR ".join(f'"{w}"' for w in q.split() if len(w) > 2)
        want = {r: -s for r, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,))} if match else {}
        got = {h.doc_id: h.score for h in hits if h.query_id == k}
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)


def cands(spark, rows, schema):
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], schema + ", input_rank int")


def ids(df, col="id"):
    return [r[col] for r in df.orderBy("input_rank").collect()]


def test_funnel_stages(spark):
    a = cands(spark, [("x", 0.9), ("y", 0.8)], "id string, score double")
    b = cands(spark, [("y", 0.85), ("z", 0.85)], "id string, score double")
    both = rank.union_dedup(a, b)
    assert [(r.id, r.score, r._source) for r in both.orderBy("input_rank").collect()] == [("x", 0.9, "vector"), ("y", 0.8, "vector"), ("z", 0.85, "fts")]
    titles = cands(spark, [("a", "T" * 60 + "1"), ("b", " " + "t" * 59), ("c", "T" * 60 + "2"), ("d", ""), ("e", None)], "id string, caratula string")
    assert ids(rank.title_dedup(titles)) == ["a", "b", "d", "e"]
    scored = lambda *s: cands(spark, [(str(i), x) for i, x in enumerate(s)], "id string, rerank_score double")
    assert ids(rank.threshold(scored(0.1, 0.0999, 0.2))) == [] and ids(rank.threshold(scored(0.1, 0.3, 0.2))) == ["0", "1", "2"]
    assert ids(rank.threshold(scored(0.01), None)) == ["0"]
    assert ids(rank.rerank_pool(scored(*[0.5] * 300), 10)) == [str(i) for i in range(100)]
    dated = cands(spark, [("2024-01-01", 0.0), ("01/02/1994", 0.0), ("1993", 0.0), ("2025", 0.0), ("x", 0.0), ("1900", 0.0), ("1901", 0.0)], "fecha string, rerank_score double")
    boosts = {r.fecha: r.final_score for r in rank.recency(dated, 2024).collect()}
    assert boosts == {"2024-01-01": 0.15, "01/02/1994": 0.0, "1993": 0.0, "2025": 0.0, "x": 0.0, "1900": 0.0, "1901": 0.0}
    groups = cands(spark, [(str(i), g) for i, g in enumerate(["A"] * 9 + [" A "] + ["", None, "B"])], "id string, tribunal string")
    assert ids(rank.diversity(groups, 10)) == ["0", "1", "2", "3", "4", "10", "11", "12", "5", "6"]
    fused = {r.id: r.rrf_score for r in rank.rrf([spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int"), spark.createDataFrame([("b", 1)], "id string, rank int")]).collect()}
    assert fused == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62 + 1 / 61)}
    assert (rank.fetch_size(10), rank.fetch_size(300), rank.clamp_top_k(3), rank.cap_of(30)) == (30, 500, 10, 10)


def test_lookup_keeps_or_loses_chunks(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, rank int")
    chunks = spark.createDataFrame([("a", "t"), ("b_c0", "u"), ("b_c1", "v")], "id string, texto string")
    assert {r.id for r in rank.lookup_hits(hits, chunks).collect()} == {"a"}
    assert {r.id for r in rank.lookup_hits(hits, chunks, fix_chunk_ids=True).collect()} == {"a", "b_c0", "b_c1"}


def test_stores(spark):
    raw = spark.createDataFrame([("a", "one", "2", 0), ("a", "first", "1", 5), ("", "x", "1", 1), ("b", None, "1", 2)], "id string, texto string, file string, line int")
    kept = store.fulltext_store(raw)
    assert [(r.id, r.texto) for r in kept.collect()] == [("a", "first")]
    hits = spark.createDataFrame([("a_c0", "fir"), ("a_c1", "first"), ("a", "much longer"), ("q", "z")], "id string, texto string")
    assert {r.id: r.texto for r in store.enrich(hits, kept).collect()} == {"a_c0": "first", "a_c1": "first", "a": "much longer", "q": "z"}
    pages = spark.createDataFrame([("u", "e", 1, 0), ("u", "f", 2, 0), ("", "e", 2, 1), ("", "e", 2, 2), ("", "", 2, 3), ("", "", 2, 4)], "uuid string, expediente string, page int, position int")
    assert store.merge_pages(pages).count() == 4
    up = vector.latest_by_id(spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"))
    assert {r.id: r.v for r in up.collect()} == {"a": 1, "b": 2, "c": 2}


def test_usage_and_outcomes(spark):
    logs = spark.createDataFrame([(i, None if i % 3 == 0 else "" if i % 3 == 1 else "economy", 0.5, i) for i in range(101)], "id int, tier string, cost_usd double, created_at int")
    assert {r.tier: r.n for r in usage.usage_summary(logs).collect()} == {"premium": 67, "economy": 33}
    assert sum(r.n for r in usage.usage_summary(logs, None).collect()) == 101
    calls = spark.createDataFrame([(usage.SMALL, 1_000_000, 200_000), ("none", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert usage.cost_of_calls(calls, usage.prices(spark)).first().total_cost_usd == 2.0
    none = spark.createDataFrame([], "resultado string")
    assert analyze.favourable_all(none).first()[0] == 0 and analyze.favourable_on_merits(none).first()[0] is None
    rows = spark.createDataFrame([("favorable",), ("inadmisible",), ("otro",)], "resultado string")
    assert (analyze.favourable_all(rows).first()[0], analyze.favourable_on_merits(rows).first()[0]) == (33.3, 50.0)
    tie = spark.createDataFrame([("favorable", 0.5, 2, "late"), ("favorable", 0.5, 1, "early")], "resultado string, score double, input_rank int, caratula string")
    assert analyze.best_per_outcome(tie, ["caratula"]).first().caratula == "early"
    line = spark.createDataFrame([("2|10|x|1.5|" + "l" * 200,), ("",)], "s string").select(usage.status_line(F.col("s")).alias("r")).collect()
    assert (line[0].r.running, line[0].r.count if not callable(line[0].r.count) else line[0].r["count"], line[0].r.errors, len(line[0].r.log), line[1].r.running) == (2, 10, 0, 150, 0)
    hits = spark.createDataFrame([(1, "C", "T", "F", "R", "Q")], "input_rank int, caratula string, tribunal string, fecha string, resumen string, cita_textual string")
    assert analyze.drafting_context(hits).first()[0].startswith("\n1. C (T, F)") and analyze.drafting_context(hits.where("false")).first()[0].startswith("(No se")
    res = spark.createDataFrame([(0, "a"), (1, "b")], "input_rank int, id string")
    told = spark.createDataFrame([(None, True), (1, False), (7, True)], "index int, relevante boolean")
    assert [r.id for r in analyze.match_by_position(res, told).collect()] == ["a"]
    items = spark.createDataFrame([("1", "u", "analisis"), ("2", "v", "bad")], "id string, user_id string, type string")
    assert usage.valid_items(items).count() == 1 and usage.without_item(items, "u", "2").count() == 2 and usage.without_item(items, "u", "1").count() == 1


def test_precision(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    r = spark.createDataFrame([(1, "Uno dos", ["uno", "x", "y"]), (1, "nada", ["uno", "x", "y"])], "query_id int, texto string, kw array<string>")
    assert {(x.query_id, x.precision, x.n) for x in evaluate.precision(q, evaluate.relevant(r)).collect()} == {(1, 50.0, 2), (2, 0.0, 0)}
    edges = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (40.0,), (39.9,)], "precision double")
    assert {x.rating: x.n for x in evaluate.rating_histogram(edges).collect()} == {"EXCELENTE": 1, "BUENA": 2, "ACEPTABLE": 1, "MALA": 1}


def test_jsonl(spark, tmp_path):
    lines = ["﻿" + json.dumps({"id": "a", "texto": "x", "new": 1}), "", "[1]", "{bad", json.dumps({"id": "b", "texto": "y", "voces": ["v"]})]
    (tmp_path / "src.jsonl").write_text("\n".join(lines), encoding="utf-8")
    got = {r.id: r for r in jsonl.documents(spark, str(tmp_path), source="src").collect()}
    assert set(got) == {"a", "b"} and got["a"].voces == [] and got["b"].sumario == "" and got["a"].chunk_index == 0
    assert jsonl.bad_lines(spark, str(tmp_path)).first().n == 1
    jsonl.write_documents(jsonl.documents(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    events = spark.createDataFrame([('data: {"step": 1}',), ("event: x",), ("data: {oops",)], "value string")
    assert [r.event for r in jsonl.event_lines(events).collect()] == ['{"step": 1}']


def test_incremental_ingestion(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    source.mkdir()
    put = lambda name, rows: (source / name).write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in rows))
    schema = spark.createDataFrame([], "id string, v int").schema
    run = lambda: ingest.ingest(ingest.new_files(spark, str(source), schema), out, mark).awaitTermination()
    put("a.json", [("x", 1), ("y", 1), ("x", 1)])
    run()
    assert {(r.id, r.v) for r in ingest.read_store(spark, out).collect()} == {("x", 1), ("y", 1)}
    put("b.json", [("y", 2), ("z", 2)])
    run()
    run()
    assert {(r.id, r.v) for r in ingest.read_store(spark, out).collect()} == {("x", 1), ("y", 1), ("z", 2)}


def test_event_folds(spark):
    rows = spark.createDataFrame([(1, 0, "active"), (2, 0, "done"), (3, -1, "active"), (4, None, "x")], "seq int, agent_id int, status string")
    assert {r.agent_id: r.status for r in ingest.agent_states(rows).collect()} == {0: "done", -1: "active"}
    numbered = spark.range(20).select(F.col("id").alias("position"), (F.col("id") % 5).cast("string").alias("key"))
    assert ingest.has_new(numbered, 10) and not ingest.has_new(numbered, 11)
    assert ingest.from_key(numbered, "key", "3").count() == 17 and ingest.from_key(numbered, "key", "q").count() == 20
    assert ingest.hourly(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_engine(spark):
    bag = lambda texts: [[float(t.lower().count(w)) + 0.01 for w in ("despido", "daño", "contrato", "accidente")] for t in texts]
    long = " relleno" * 70
    docs = spark.createDataFrame([(str(i), t, b + long, "", "T", "m", "2020", "s") for i, t, b in DOCS], "id string, caratula string, texto string, sumario string, tribunal string, materia string, fecha string, source string")
    chunks = embed(docs, "texto", bag)
    engine = Engine(spark, chunks, docs, docs.select("id", "texto"), bag, least=None)
    top = engine.search("despido sin causa", 10).orderBy("input_rank").collect()
    assert top[0].id == "2" and top[0].rerank_score > 0
    reader = lambda df: read_rulings(df.select("caratula", "texto"), lambda p: p.assign(resultado="favorable", normas_citadas=[["ley 1"]] * len(p))[["caratula", "resultado", "normas_citadas"]], "caratula string, resultado string, normas_citadas array<string>")
    out = engine.analyze("despido sin causa", reader, 10)
    assert out["counts"].first().n == out["analyses"].count() > 0
    assert engine.tiers().count() == 3 and engine.ingest_status().count() == 1
    assert docs.select(overlap_score("despido causa", "texto").alias("s")).where("s = 1").count() == 1
    good, noise = quality.split_quality(docs)
    assert good.count() + noise.count() == docs.count()


def test_vector_search(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "a"), (4, None, "a"), (5, [0.0, 0.0], "a")], "id int, embedding array<float>, label string")
    assert [r.id for r in vector.top_k(df, [1.0, 0.1], 3).collect()] == [1, 2, 3]
    assert [r.id for r in vector.top_k(df, [1.0, 0.1], 9, label="a").collect()][:2] == [1, 3]
    assert vector.top_k_relaxed(df, [1.0, 0.1], 2, label="zzz").count() == 2


def test_ties_beyond_k_go_to_the_smallest_ids(spark):
    """Scores that differ in their last bits alone, as sums of the same parts in another order do."""
    scores = spark.createDataFrame([(1, d, 1.0 + 1e-13 * d) for d in range(100)], "query_id int, doc_id int, score double")
    assert sorted(r.doc_id for r in keyword._best(scores, 10).collect()) == list(range(10))
    near = spark.createDataFrame([(i, [1.0, 1e-6 * (100 - i)]) for i in range(100)], "id int, embedding array<double>")
    assert sorted(r.id for r in vector.top_k(near, [1.0, 0.0], 10, digits=6).collect()) == list(range(10))


def test_heavy_rows_are_not_gathered(spark, sf):
    """No single window over a whole table, no text in a conversation's row."""
    from docmill.plans import catalogue

    plan = lambda n: catalogue.queries()[n](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan("relevance_threshold_min3") and "text" not in plan("strip_heavy_fields").split("Aggregate")[1].split("\n")[0]


def test_index_gives_what_bm25_gives(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("title", F.substring("text", 1, 30))
    first = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    words = docs.where("doc_id < 20").select((F.col("doc_id") + 10_000).alias("query_id"), F.regexp_replace(F.substring("text", 1, 60), r"(\\w+) (\\w+)", "$1.$2").alias("q"))
    none = spark.createDataFrame([(-1, "a b"), (-2, "zzzqqq"), (-3, None)], "query_id long, q string")
    queries = first.unionByName(words).unionByName(none)
    keyword_index.build_index(docs, str(tmp_path / "index"), columns=("title", "text"), buckets=7)
    show = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    got = show(keyword_index.search_index(spark, str(tmp_path / "index"), queries, 5))
    assert got == show(keyword.bm25(docs, queries, 5, columns=("title", "text"))) and len(got) > 100
    assert min(q for q, *_ in got) >= 0


def test_index_of_nothing(spark, sf, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    keyword_index.build_index(none, str(tmp_path / "index"))
    assert keyword_index.search_index(spark, str(tmp_path / "index"), spark.createDataFrame([(0, "alpha")], "query_id int, q string"), 5).count() == 0


def test_more_terms_than_are_listed(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    queries = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    show = lambda f: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in f(docs, queries, 5).collect())
    want = [show(keyword.bm25), show(keyword.okapi)]
    monkeypatch.setattr(keyword, "LISTED_TERMS", 3)
    assert [show(keyword.bm25), show(keyword.okapi)] == want
