"""A keyed store of immutable files in buckets: a batch opens only the files that may hold its ids, by their Bloom filters."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.store import first_wins
from docmill.session import delete, file_system, saved, scratch

#: Bits of a filter for each id, and how many of them an id sets: about one id in a hundred passes by chance.
BITS, HASHES = 10, 7
_MANIFEST = "bucket int, file string, n long, bloom binary"


def _places(h: np.ndarray, g: np.ndarray, bits: int) -> np.ndarray:
    """The bits (ids, HASHES) of ids by two 64-bit hashes."""
    h, g = h.astype(np.uint64)[:, None], (g.astype(np.uint64) | np.uint64(1))[:, None]
    return ((h + g * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def bloom(h: np.ndarray, g: np.ndarray) -> bytes:
    bits = np.zeros(-(-max(8, BITS * len(h)) // 8) * 8, np.uint8)
    bits[_places(h, g, len(bits))] = 1
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which ids a filter lets pass."""
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bits[_places(h, g, len(bits))].all(1)


class UpsertLog:
    """Rows by id under `path`, in `buckets` by the id's hash. Each batch writes new files; the manifest of a version lists the files that count.

    Of rows with one id in a batch the first counts (by the columns `order`), and a later batch replaces what is stored. Files of a bucket
    whose filter lets none of the batch's ids pass stay as they are; the others are written anew without those ids. A version that
    was not finished leaves no manifest and counts for nothing; the same batch number again does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "id", buckets: int = 64):
        self.spark, self.path, self.id_col, self.buckets = spark, path, id_col, buckets

    # ---- versions

    def versions(self) -> list[int]:
        """The finished versions, oldest first."""
        where, files = file_system(self.spark, f"{self.path}/manifest")
        found = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n[2:]) for n in found if n.startswith("v=") and files.exists(where.suffix(f"/{n}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> DataFrame:
        """bucket, file, n, bloom of the files that count, of the last version or of an older one."""
        known = self.versions() if version is None else [version]
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={known[-1]}") if known else self.spark.createDataFrame([], _MANIFEST)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The stored rows, of some buckets if asked; None before the first batch."""
        own = self.manifest(version)
        files = [r.file for r in (own if buckets is None else own.where(F.col("bucket").isin(buckets))).select("file").distinct().collect()]
        return self._rows(files).drop("__b") if files else None

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/data/{f}" for f in files))

    # ---- writing

    def _keyed(self, df: DataFrame) -> DataFrame:
        key = F.col(self.id_col)
        return df.withColumn("__h", F.xxhash64(key)).withColumn("__g", F.xxhash64(key, F.lit(1))).withColumn("__b", F.pmod("__h", F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        """Write rows as the files name/__b=<bucket>, and what the manifest says of them."""
        keyed = self._keyed(df).repartition("__b")
        keyed.drop("__h", "__g").write.partitionBy("__b").parquet(f"{self.path}/data/{name}")

        def filters(table: pa.Table) -> pa.Table:
            h, g = (table.column(c).to_numpy() for c in ("__h", "__g"))
            b = int(table.column("__b")[0].as_py())
            return pa.table({"bucket": pa.array([b], pa.int32()), "file": [f"{name}/__b={b}"], "n": pa.array([len(h)], pa.int64()), "bloom": pa.array([bloom(h, g)], pa.binary())})

        stored = self._keyed(self._rows([name])).select("__h", "__g", "__b")
        return stored.groupBy("__b").applyInArrow(filters, _MANIFEST)

    def _opened(self, batch: DataFrame, manifest: DataFrame) -> DataFrame:
        """file: those that may hold an id of the batch. Ids and filters meet by bucket."""

        def probe(ids: pa.Table, filters: pa.Table) -> pa.Table:
            if not len(ids) or not len(filters):
                return pa.table({"file": pa.array([], pa.string())})
            h, g = (ids.column(c).to_numpy() for c in ("__h", "__g"))
            return pa.table({"file": pa.array([r["file"] for r in filters.select(["file", "bloom"]).to_pylist() if may_hold(r["bloom"], h, g).any()], pa.string())})

        ids = self._keyed(batch).select("__b", "__h", "__g").groupBy("__b")
        return ids.cogroup(manifest.withColumnRenamed("bucket", "__b").groupBy("__b")).applyInArrow(probe, "file string")

    def upsert(self, batch: DataFrame, number: int, order: tuple[str, ...] = ()) -> bool:
        """Store a batch as version `number`; whether it was new. Rows without an id fall out."""
        known = self.versions()
        if known and number <= known[-1]:
            return False
        with scratch():
            rows = batch.where(F.col(self.id_col).isNotNull())
            fresh = first_wins(rows.withColumn("__at", F.monotonically_increasing_id()), self.id_col, *order, "__at").drop("__at")
            fresh = saved(fresh, "batch")
            if fresh.isEmpty():
                self._commit(self.manifest(), number)
                return True
            before = self.manifest()
            opened = [r.file for r in self._opened(fresh, before).distinct().collect()]
            kept, parts = before.where(~F.col("file").isin(opened)) if opened else before, []
            if opened:
                left = self._rows(opened).join(fresh.select(self.id_col), self.id_col, "left_anti").drop("__b")
                if not (left := saved(left, "left")).isEmpty():
                    parts.append(self._write(left, f"{number}-{uuid.uuid4().hex}-kept"))
            parts.append(self._write(fresh, f"{number}-{uuid.uuid4().hex}"))
            for p in parts:
                kept = kept.unionByName(p)
            self._commit(kept, number)
        return True

    def insert(self, batch: DataFrame, number: int, order: tuple[str, ...] = ()) -> bool:
        """As upsert(), but a row whose id is stored already falls out; no stored file is written anew."""
        known = self.versions()
        if known and number <= known[-1]:
            return False
        with scratch():
            rows = batch.where(F.col(self.id_col).isNotNull()).withColumn("__at", F.monotonically_increasing_id())
            fresh, before = saved(first_wins(rows, self.id_col, *order, "__at").drop("__at"), "batch"), self.manifest()
            if opened := [r.file for r in self._opened(fresh, before).distinct().collect()]:
                fresh = saved(fresh.join(self._rows(opened).select(self.id_col), self.id_col, "left_anti"), "fresh")
            parts = before if fresh.isEmpty() else before.unionByName(self._write(fresh, f"{number}-{uuid.uuid4().hex}"))
            self._commit(parts, number)
        return True

    def _commit(self, manifest: DataFrame, number: int) -> None:
        manifest.repartitionByRange("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")

    def compact(self, number: int, files: int = 4) -> int:
        """Write the buckets of more than `files` files as one each, as version `number`; how many buckets these were."""
        before = self.manifest()
        many = [r.bucket for r in before.groupBy("bucket").count().where(F.col("count") > files).collect()]
        if many:
            rows = self.read(buckets=many)
            self._commit(before.where(~F.col("bucket").isin(many)).unionByName(self._write(rows, f"{number}-{uuid.uuid4().hex}-compact")), number)
        return len(many)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests but for the last `keep`, and data folders that none of those names; how many folders these were."""
        versions = self.versions()
        for v in versions[:-keep]:
            delete(self.spark, f"{self.path}/manifest/v={v}")
        used = {r.file.split("/")[0] for v in versions[-keep:] for r in self.manifest(v).select("file").collect()}
        where, files = file_system(self.spark, f"{self.path}/data")
        old = [n for n in (x.getPath().getName() for x in files.listStatus(where)) if n not in used] if files.exists(where) else []
        for n in old:
            delete(self.spark, f"{self.path}/data/{n}")
        return len(old)
