"""Scratch tables in the shared folder, and small column helpers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.session import bounded_batches, delete, discard, saved, scratch, scratch_path, shared_dir  # noqa: F401  the operators take them from here
from docmill.session import file_system as _file_system  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sliced(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices of a few rows, so that a worker doesn't hold what it makes of a whole batch."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a table of ids and hashes, 100 bytes each at most, that may be broadcast.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A written table of ids and hashes, with the hint to broadcast it if it has BROADCAST_ROWS at most; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
