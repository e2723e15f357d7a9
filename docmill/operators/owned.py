"""Saved items and usage logs of one user: an accessor that can't be opened without its owner."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import usage
from docmill.schema import ITEM_TYPES, TIERS
from docmill.session import file_system

ITEM = "id string, user_id string, type string, title string, data string, created_at timestamp, gone boolean"
USAGE = "id string, user_id string, tool string, tier string, rulings int, cost_usd decimal(18,6), created_at timestamp"


class OwnedRows:
    """What one user has saved and used, in Parquet files under `path`. Every read is bound to the owner, every row written is the owner's.

    Items and logs are appended; a deletion is an appended row as well, so nothing that another user has is ever rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str):
        if not owner or not owner.strip():
            raise ValueError("rows can't be opened without an owner")
        self._spark, self._path, self._owner = spark, path, owner

    def _own(self, name: str, schema: str) -> DataFrame:
        where, files = file_system(self._spark, f"{self._path}/{name}")
        rows = self._spark.read.schema(schema).parquet(f"{self._path}/{name}") if files.exists(where) else self._spark.createDataFrame([], schema)
        return rows.where(F.col("user_id") == self._owner)

    def _append(self, name: str, schema: str, row: dict) -> str:
        row = {"id": uuid.uuid4().hex} | row | {"user_id": self._owner}
        values = self._spark.createDataFrame([row], ", ".join(c for c in schema.split(", ") if c.split()[0] in row)).withColumn("created_at", F.current_timestamp())
        kinds = [c.split() for c in schema.split(", ")]
        values.select(*(F.col(n).cast(k).alias(n) if n in values.columns else F.lit(None).cast(k).alias(n) for n, k in kinds)).write.mode("append").parquet(f"{self._path}/{name}")
        return row["id"]

    def save(self, kind: str, title: str, data: str = "{}") -> str:
        """Save an item and return its id; a type that isn't known is an error."""
        if kind not in ITEM_TYPES:
            raise ValueError(f"an item's type is one of {', '.join(ITEM_TYPES)}, not {kind}")
        return self._append("items", ITEM, {"type": kind, "title": title, "data": data, "gone": False})

    def delete(self, item_id: str) -> None:
        """Delete an own item; an id that isn't the owner's is an error."""
        if self.items().where(F.col("id") == item_id).isEmpty():
            raise KeyError(item_id)
        self._append("items", ITEM, {"id": item_id, "gone": True})

    def items(self, kind: str | None = None) -> DataFrame:
        """The own items, newest first; of one type if asked."""
        rows = self._own("items", ITEM)
        gone = rows.where("gone").select("id")
        return usage.saved_items(rows.where("NOT gone").join(gone, "id", "left_anti").drop("gone"), self._owner, kind)

    def log(self, tool: str, tier: str | None, rulings: int, cost_usd: str | float) -> str:
        """Log a use; a tier that is not known and a cost below zero are errors; no tier counts as premium."""
        if tier not in (None, "", *TIERS):
            raise ValueError(f"a tier is one of {', '.join(TIERS)}, not {tier}")
        if float(cost_usd) < 0:
            raise ValueError("a cost can't be below zero")
        return self._append("usage", USAGE, {"tool": tool, "tier": tier or "premium", "rulings": rulings, "cost_usd": Decimal(str(cost_usd)).quantize(Decimal("0.000001"))})

    def usage(self, most: int = 100) -> DataFrame:
        """The newest own logs."""
        return usage.usage_list(self._own("usage", USAGE), self._owner, most)

    def usage_by_tier(self, limit_rows: int | None = 100) -> DataFrame:
        return usage.usage_summary(self._own("usage", USAGE), limit_rows)
