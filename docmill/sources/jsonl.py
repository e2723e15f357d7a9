"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import json_value, once, or_empty, strip
from docmill.schema import DOCUMENT


def raw_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """value, file, block, line (a number that grows within a block): lines that may hold an object; blank lines, other lines and byte-order marks fall out."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    value = strip(F.ltrim("value", F.lit("﻿")))
    return lines.select(value.alias("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where(F.col("value").startswith("{"))


def documents(spark: SparkSession, path: str, glob: str = "*.jsonl", source: str | None = None, places: bool = False) -> DataFrame:
    """Documents of clean files; bad JSON falls out, unknown keys are dropped, absent ones are empty. `source` picks the file of that stem; `places` adds where each stood (block, line)."""
    where = ["file", "block", "line"] if places else ["file"]
    rows = raw_lines(spark, path, f"{source}.jsonl" if source else glob).select(once(json_value(F.col("value"))).alias("v"), *where).where("v IS NOT NULL")
    blank = {"string": or_empty, "array<string>": lambda c: F.coalesce(c, F.array().cast("array<string>")), "int": lambda c: F.coalesce(c, F.lit(0))}
    field = lambda f: blank[f.dataType.simpleString()](F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString())).alias(f.name)
    return rows.select(*map(field, DOCUMENT.fields), *where)


def bad_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, n: how many lines of each file look like an object and aren't JSON."""
    return raw_lines(spark, path, glob).where(json_value(F.col("value")).isNull()).groupBy("file").agg(F.count("*").alias("n"))


def write_documents(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def event_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """The JSON of 'data: ' lines of an event stream; other lines and malformed ones fall out."""
    body = lines.where(F.col(value_col).startswith("data: ")).select(F.substring(value_col, 7, 1 << 30).alias("event"))
    return body.where(F.try_parse_json("event").isNotNull())
