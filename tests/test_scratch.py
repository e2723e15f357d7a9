"""What the writes of scratch tables leave on disk and send to Python workers."""

import glob
import os
import time

import pyarrow as pa
from pyspark.sql import functions as F

from docmill.llm import pipeline
from docmill.session import WRITING, bounded_batches, discard, saved, settings

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])


def long_texts(spark):
    return spark.range(0, 400, 1, 1).select(F.repeat(F.lit("some words "), 5000).alias("text"))


def test_workers_get_batches_of_a_few_mb(spark):
    """22 MB of texts in fewer rows than a batch may have; no row is lost and the session's settings stay."""
    before = spark.conf.get(BATCH, None)
    got = saved(long_texts(spark).mapInArrow(sizes, "n long, size long"), "sizes")
    assert got.agg(F.sum("n")).first()[0] == 400 and got.agg(F.max("size")).first()[0] < 6 << 20
    assert spark.conf.get(BATCH, None) == before
    discard(got)


def test_pipeline_bounds_the_batches_of_the_session(spark, sf):
    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.unset(BATCH)
        pipeline.substring_dedup_cut(spark, spark.createDataFrame([(1, "a b c", 5)], "doc_id long, text string, n_chars long"), sf)
        assert spark.conf.get(BATCH) == WRITING[BATCH]
        assert max(r["size"] for r in long_texts(spark).mapInArrow(sizes, "n long, size long").collect()) < 6 << 20
        spark.conf.set(BATCH, "123456")
        bounded_batches(spark)
        assert spark.conf.get(BATCH) == "123456"
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def test_settings_are_put_back_after_an_error(spark):
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        with settings(spark, WRITING):
            assert spark.conf.get(BATCH) == WRITING[BATCH]
            raise ValueError
    except ValueError:
        pass
    assert {k: spark.conf.get(k, None) for k in WRITING} == before


def shuffled(spark):
    """The shuffle files of the session's application."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(os.path.join(d, "*", "shuffle_*.data"))}


def test_shuffle_files_go_with_the_write(spark):
    """Files of a written table's shuffles don't stay for as long as the driver keeps its plan."""
    before = shuffled(spark)
    df = spark.range(200_000).select((F.xxhash64("id") % 1000).alias("k"), "id").repartition(4, "k").groupBy("k").agg(F.collect_set("id").alias("ids"))
    got = saved(df, "grouped")
    for _ in range(50):  # they go in the background
        if not (left := [f for f in shuffled(spark) - before if os.path.exists(f) and os.path.getsize(f) > 100_000]):
            break
        time.sleep(0.1)
    assert not left
    assert got.select(F.explode("ids")).count() == 200_000
    discard(got)
