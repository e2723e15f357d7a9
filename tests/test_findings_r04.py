"""The search of the engine reads whole texts."""

import duckdb
from pyspark.sql import functions as F

from docmill.engine import KEYWORD_COLUMNS, Engine
from docmill.operators import keyword_index, store
from docmill.plans import catalogue
from docmill.session import scratch_path


def test_search_finds_words_at_the_end_of_long_texts(spark):
    """Of 60 rulings those that hold the case in their last words alone: none is near by its vector, and the reranker sees the words as well; with an index too."""
    held = {7, 23, 41, 59}
    rows = [(i, f"title {i}", "relleno " * 2500 + ("usucapion quinquenal" if i in held else "nada"), "x" * 400 + (" inmueble" if i in held else ""), float(1000 if i in held else i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "n int, caratula string, texto string, sumario string, y double").select(
        F.col("n").cast("string").alias("id"), "caratula", "texto", "sumario", F.lit("").alias("tribunal"), F.lit("m").alias("materia"), F.lit("").alias("fecha"), F.array(F.lit(1.0), "y").alias("embedding")
    )
    index = scratch_path(spark, "words")
    keyword_index.build_index(store.index_rows(docs), index, "doc_id", KEYWORD_COLUMNS)
    for keywords in (None, index):
        engine = Engine(spark, docs, docs, docs.select("id", "texto"), lambda texts: [[1.0, 0.0]] * len(texts), keywords=keywords)
        got = engine.search("usucapion quinquenal inmueble", 10).collect()
        assert {(r.id, r._source, r.rerank_score) for r in got} == {(str(i), "fts", 1.0) for i in held}


def test_search_end_to_end_on_long_texts(spark, tmp_path):
    """Against SQL: what is near by its vector has one title and no word of the case, so the rows are documents that hold its words behind their first 2,000 characters."""
    asked = "alpha beta gamma delta epsilon"
    words = lambda i: " ".join(f"w{k}" for k in range(400 + i)) + " " + " ".join(asked.split()[: i % 6])
    texts = [f"the same beginning of all texts that are near {i}" for i in range(300)] + [f"{i} {words(i)}" for i in range(300, 400)] + [None, ""]
    spark.createDataFrame([(i, t, "en", f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(402)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, asked), (1, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.queries()["search_end_to_end"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.execute(catalogue.oracle_sql()["search_end_to_end"]).fetchall())
    assert {(i, s) for i, _, s in got} == {(str(i), i % 6 / 5) for i in range(300, 400) if i % 6}
    assert all(texts[int(i)].index("alpha") > 2000 for i, _, _ in got)
