"""Incremental ingestion with Structured Streaming, and the fold of progress events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from docmill.operators.upsert_log import UpsertLog


def new_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the rows of JSON files as they arrive; the query's checkpoint knows which files are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest(stream: DataFrame, store: str, checkpoint: str, id_col: str = "id", prepare: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 16) -> StreamingQuery:
    """Store what arrived since the last run, one row for each id not stored yet, then stop.

    Each batch is a version of an upsert log by its number, so one that runs again after a failure stores nothing twice, and it opens only the
    stored files that may hold its ids. What is read is counted as the observed metric "ingest". Read the store with read_store().
    """
    log = UpsertLog(stream.sparkSession, store, id_col, buckets)
    counted = stream.observe("ingest", F.count(F.lit(1)).alias("read"), F.count_if(F.col(id_col).isNull()).alias("without_id"))
    return counted.writeStream.foreachBatch(lambda batch, number: log.insert(prepare(batch), number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str) -> DataFrame | None:
    """The stored rows; None while there are none."""
    return UpsertLog(spark, store).read()


class ProgressLog(StreamingQueryListener):
    """The progress of a session's streams as rows: query, batch, input_rows, rows_per_second, and the observed metrics by name as JSON. Add it with spark.streams.addListener()."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        told = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.rows.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond, json.dumps(told)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, batch long, input_rows long, rows_per_second double, observed string")

    def write(self, spark: SparkSession, path: str) -> None:
        """Append what was seen so far to a table, and forget it."""
        self.table(spark).write.mode("append").parquet(path)
        self.rows.clear()


def has_new(df: DataFrame, done: int, position: str = "position", least: int = 10) -> bool:
    """Whether at least `least` rows lie behind the offset; reads no further than needed."""
    return df.where(F.col(position) >= done).limit(least).count() >= least


def after_offset(df: DataFrame, done: int, position: str = "position") -> DataFrame:
    return df.where(F.col(position) >= done)


def from_key(df: DataFrame, key_col: str, key, position: str = "position") -> DataFrame:
    """Rows from the first one that has the key on, that one included; all rows if none has it."""
    start = df.where(F.col(key_col) == key).agg(F.min(position)).first()[0]
    return df if start is None else df.where(F.col(position) >= start)


def agent_states(events: DataFrame, order: str = "seq") -> DataFrame:
    """The last status of each agent; works on a stream in update mode as well."""
    return events.where("agent_id IS NOT NULL").groupBy("agent_id").agg(F.max_by("status", order).alias("status"), F.count("*").alias("n_events"))


def agent_counts(events: DataFrame, order: str = "seq") -> DataFrame:
    """The number of agents in each status."""
    return agent_states(events, order).groupBy("status").agg(F.count("*").alias("n"))


def hourly(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Events and value by hour and type, with a watermark for late rows."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")
