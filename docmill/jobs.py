"""Batch jobs: python -m docmill.jobs normalize|chunk|store|index|ingest|sync|benchmark|status ... ; run them with spark-submit on a cluster."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.engine import KEYWORD_COLUMNS
from docmill.operators import chunk, evaluate, keyword_index, normalize, quality, store
from docmill.schema import DOCUMENT
from docmill.sources import jsonl
from docmill.streaming import ingest


def run_normalize(spark: SparkSession, source: str, out: str, kind: str) -> None:
    """Raw JSON lines as clean documents."""
    if kind == "variant":
        docs = normalize.normalize_variant(jsonl.raw_lines(spark, source))
    else:
        raw = spark.read.option("recursiveFileLookup", "true").json(source)
        docs = {"rulings": normalize.normalize_rulings, "records": normalize.normalize_records, "chamber": normalize.normalize_chamber}[kind](raw)
    jsonl.write_documents(docs, out)


def run_chunk(spark: SparkSession, source: str, out: str) -> None:
    """Clean documents as the rows of a vector store, without those that are too short."""
    docs = quality.ingest_gate(jsonl.documents(spark, source, "*.json*"))
    chunk.chunk_documents(docs.drop("file")).write.mode("overwrite").parquet(out)


def run_store(spark: SparkSession, source: str, out: str) -> None:
    """The full-text store of clean documents; of one id the first line of the file that sorts first wins."""
    docs = jsonl.documents(spark, source, "*.json*", places=True)
    store.fulltext_store(docs, order=("file", "block", "line")).drop("block", "line").write.mode("overwrite").parquet(out)


def run_ingest(spark: SparkSession, source: str, out: str, checkpoint: str) -> None:
    """Store what arrived in `source` since the last run."""
    ingest.ingest(ingest.new_files(spark, source, DOCUMENT), out, checkpoint).awaitTermination()


def run_index(spark: SparkSession, source: str, out: str) -> None:
    """The keyword index of clean documents."""
    keyword_index.build_index(store.index_rows(jsonl.documents(spark, source, "*.json*")), out, "doc_id", KEYWORD_COLUMNS)


def run_sync(spark: SparkSession, source: str, out: str, checkpoint: str, history: str) -> None:
    """run_ingest(), and a row in the history of syncs: at, previous_total, new_total, new_written, elapsed_seconds."""
    count = lambda: 0 if (found := ingest.read_store(spark, out)) is None else found.count()
    before, began = count(), time.time()
    run_ingest(spark, source, out, checkpoint)
    after = count()
    row = spark.createDataFrame([(before, after, after - before, round(time.time() - began, 1))], "previous_total long, new_total long, new_written long, elapsed_seconds double")
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(history)


def run_benchmark(spark: SparkSession, source: str, index: str, queries: str, out: str) -> None:
    """Precision of keyword searches, at ten hits each: JSON lines (query_id, q, kw) against the index of the documents in `source`."""
    asked = spark.read.schema("query_id long, q string, kw array<string>").json(queries)
    texts = store.fulltext_store(jsonl.documents(spark, source, "*.json*", places=True), order=("file", "block", "line")).select(F.col("id").alias("doc_id"), "texto")
    hits = keyword_index.search_index(spark, index, asked, 10).join(texts, "doc_id").join(asked, "query_id")
    evaluate.precision(asked, evaluate.relevant(hits)).write.mode("overwrite").parquet(out)


def status(spark: SparkSession, out: str) -> DataFrame | None:
    found = ingest.read_store(spark, out)
    return found and found.groupBy("source").agg(F.count("*").alias("n"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["normalize", "chunk", "store", "index", "ingest", "sync", "benchmark", "status"])
    parser.add_argument("--source")
    parser.add_argument("--out", required=True)
    parser.add_argument("--kind", choices=["variant", "rulings", "records", "chamber"], default="variant")
    for name in ("--checkpoint", "--history", "--index", "--queries"):
        parser.add_argument(name)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "normalize":
        run_normalize(spark, a.source, a.out, a.kind)
    elif a.job == "chunk":
        run_chunk(spark, a.source, a.out)
    elif a.job == "store":
        run_store(spark, a.source, a.out)
    elif a.job == "index":
        run_index(spark, a.source, a.out)
    elif a.job == "sync":
        run_sync(spark, a.source, a.out, a.checkpoint, a.history)
    elif a.job == "benchmark":
        run_benchmark(spark, a.source, a.index, a.queries, a.out)
    elif a.job == "ingest":
        run_ingest(spark, a.source, a.out, a.checkpoint)
    elif (found := status(spark, a.out)) is not None:
        found.show(1000, truncate=False)


if __name__ == "__main__":
    main()
