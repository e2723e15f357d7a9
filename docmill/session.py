"""Session settings, table loading and scratch tables in the shared folder, for queries, tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: While a table is written its shuffle files go at the end, not when the driver happens to collect its garbage, and Python workers get batches of a few MB however long the texts are.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_own: dict[str, str] = {}
#: The tables of the innermost scratch() of this thread.
_open: ContextVar[list[DataFrame] | None] = ContextVar("open", default=None)


def session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session to the operators instead."""
    cpus = cpus or os.cpu_count() or 1
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cpus}]").config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where it is read by fewer tasks than there are cores, as a small file of one row group is; for work that takes far longer than a shuffle of the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < 4 * cores and len(df.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder in local mode, as in tests; on a cluster an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set; with master {master} it must name a folder that all machines share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-docmill-")
    return _own[app]


def file_system(spark: SparkSession, path: str):
    """The path for Hadoop, and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted at the latest when the application ends."""
    path = f"{shared_dir(spark)}/docmill-{name}-{uuid.uuid4().hex}"
    where, files = file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Tables that saved() writes inside are deleted at its end, but for those given to the function that it yields."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _open.set(own)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _open.reset(token)
        discard(*(df for df in own if not any(df is k for k in kept)))
        if (outer := _open.get()) is not None:
            outer += kept


def bounded_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get batches of a few MB, as while a table is written, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, WRITING[key])


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings are these inside, and at its end what they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet (with the writer's options) into the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, name)}/rows"
    with settings(spark, WRITING):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if (own := _open.get()) is not None:
        own.append(out)
    return out


def delete(spark: SparkSession, path: str) -> None:
    where, files = file_system(spark, path)
    files.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of saved() that nothing reads any more. What a result still reads stays until the application ends."""
    for df in tables:
        delete(df.sparkSession, df._scratch)
