"""Line dedup: documents probe sharded minimal perfect hashes of the repeated lines instead of joining their lines."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, saved

STRIPPED = b" \t\n\x0b\x0c\r"
#: Keys in a shard, and bytes of arrays that may be broadcast; beyond those the probes are routed to the shards.
SHARD_KEYS, BROADCAST_BYTES, GROUP_ROWS = 1 << 18, 64 << 20, 200_000
#: Stands for a null id, below any other.
NO_ID = -(1 << 63)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: in each level keys that fall alone on a bit own it, the others go on.

    The index of a key is the rank of its bit over all levels. `index` of any other key is -1 or some key's index.
    """

    def __init__(self, keys: np.ndarray, load: float = 2.0):
        self.levels, base = [], 0
        while len(keys) and len(self.levels) < 48:
            m = -(-max(64, int(len(keys) * load)) // 64) * 64
            at = self._place(keys, len(self.levels), m)
            alone = np.bincount(at, minlength=m) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.uint32) + np.uint32(base)
            self.levels.append((m, words, before))
            base += int(alone.sum())
            keys = keys[~alone[at]]
        self.rest = {int(k): base + i for i, k in enumerate(np.unique(keys))}  # only keys that agree in every level
        self.size = base + len(self.rest)

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, m)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = before[at[hit] >> 6] + np.bitwise_count(low[hit])
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get(int(keys[i]), -1)
        return out


def _key(line: bytes, least: int) -> bytes | None:
    """The line's key if it has at least `least` code points."""
    key = line.strip(STRIPPED).lower()
    if len(key) < least or (len(key) < 4 * least and not key.isascii() and len(key.decode()) < least):
        return None
    return key


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each key: one half places it, the other is its fingerprint."""
    one, two = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
    return np.array([one(k) for k in keys], np.uint64), np.array([two(k) for k in keys], np.uint64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """id, h1, h2 for each distinct key of each row."""

    def emit(batches):
        for b in batches:
            ids, owners, keys = _ids(b.column(0)), [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                own = {k for line in (text or "").encode().split(b"\n") if len(line) >= least and (k := _key(line, least)) is not None}
                keys += own
                owners += [i] * len(own)
            h1, h2 = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owners] if owners else np.zeros(0, np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "h1", "h2"])

    return docs.mapInArrow(emit, "id long, h1 long, h2 long")


def _shard_of(h1, bits: int):
    return h1 >> np.uint64(64 - bits) if bits else h1 & np.uint64(0)


def build_shards(keys: DataFrame, bits: int) -> DataFrame:
    """One row a shard: the pickled perfect hash and its arrays of fingerprints, counts and keepers."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64)
        mixed = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15))
        order, table = np.zeros(len(pdf), np.int64), PerfectHash(mixed)
        order[table.index(mixed)] = np.arange(len(pdf))
        arrays = (table, h2[order], np.minimum(pdf["n_docs"].to_numpy(np.int64), 0xFFFFFFFF).astype(np.uint32)[order], pdf["keep_id"].to_numpy(np.int64)[order])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "arrays": [pickle.dumps(arrays)]})

    shard = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
    return keys.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard long, arrays binary")


def probe(arrays: tuple, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, least_docs: int) -> np.ndarray:
    """Which lines go: those whose fingerprint is listed with a count of enough documents, but for the document that keeps them."""
    table, prints, counts, keepers = arrays
    at = table.index(h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15)))
    return (at >= 0) & (prints[at] == h2) & (counts[at] >= least_docs) & (keepers[at] != ids)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, text (what stays, joined by a line feed).

    Lines end at line feeds; a null or empty text is one empty line. A line's key is the line with ASCII white space
    stripped at both ends and A-Z lower-cased. Keys of `least_chars` code points or more that `least_docs` rows or more
    hold lose all their lines, except in the row with the largest id that holds them. Ids are integers; a null id is
    smaller than any other, and rows that tie on the largest id all keep their lines. Other columns are ignored.

    Distinct keys are counted by hash with a partial step in each task. Those of two documents or more are dealt to shards
    by hash prefix, each with a minimal perfect hash over its keys and arrays of fingerprints, counts and keepers; a
    probe reads the count. While all arrays fit `broadcast_bytes`, every task probes them as it reads documents. Beyond
    that, line hashes are routed to the shards, salted by document so that no task gets more than its share of a
    shard's lines, however hot one is, and only hits come back to the documents.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashes = _line_hashes(docs, least_chars)
    keys = saved(hashes.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keep_id")).where(F.col("n_docs") >= min(least_docs, 2)), "line-keys")
    n = keys.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / SHARD_KEYS)))
    shards = build_shards(keys, bits)
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_lines long, n_dropped long, text string"

    def cut(b: pa.RecordBatch, drop) -> pa.RecordBatch:
        """b with its lines cut; drop tells by the batch's line hashes, their rows' ids and rows which ones go."""
        ids, owners, places, keys, lines = _ids(b.column(0)), [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            lines.append(own := (text or "").encode().split(b"\n"))
            for j, line in enumerate(own):
                if len(line) >= least_chars and (k := _key(line, least_chars)) is not None:
                    keys.append(k)
                    owners.append(i)
                    places.append(j)
        n_lines, dropped = [len(x) for x in lines], [0] * len(lines)
        if keys:
            h1, h2 = _hashes(keys)
            owners = np.array(owners)
            for x in np.flatnonzero(drop(h1, h2, ids[owners], owners)):
                lines[owners[x]][places[x]] = None
                dropped[owners[x]] += 1
        texts = [b"\n".join([x for x in own if x is not None]).decode() for own in lines]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["id", "n_lines", "n_dropped", "text"])

    if n * 24 <= broadcast_bytes:
        tables = df.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in shards.collect()})
        discard(keys)
        loaded: dict = {}

        def whole(batches):
            if not loaded:
                loaded.update({k: pickle.loads(v) for k, v in tables.value.items()})

            def drop(h1, h2, ids, _):
                out, at = np.zeros(len(h1), bool), _shard_of(h1, bits)
                for s in np.unique(at) if loaded else ():
                    if int(s) in loaded:
                        own = np.flatnonzero(at == s)
                        out[own] = probe(loaded[int(s)], h1[own], h2[own], ids[own], least_docs)
                return out

            for b in batches:
                yield cut(b, drop)

        out = docs.mapInArrow(whole, schema)
    else:
        # Rows get numbers of their own here, so that neither null nor repeated ids gather the hits of several documents.
        numbered = saved(docs.withColumn("row", F.monotonically_increasing_id()), "line-rows")
        hashes = saved(_line_hashes(numbered.select("row", "text"), least_chars).withColumnRenamed("id", "row"), "line-hashes")
        salts = max(1, math.ceil(hashes.count() / (1 << bits) / GROUP_ROWS))
        shard = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
        owners = numbered.select("row", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"))
        routed = hashes.join(owners, "row").select("*", shard.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
        spread = shards.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))

        def hit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return left[["row", "h1", "h2"]].iloc[:0]
            h1, h2 = left["h1"].to_numpy().view(np.uint64), left["h2"].to_numpy().view(np.uint64)
            return left.loc[probe(pickle.loads(right["arrays"].iloc[0]), h1, h2, left["id"].to_numpy(), least_docs), ["row", "h1", "h2"]]

        hits = routed.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(hit, "row long, h1 long, h2 long")
        gone = saved(hits.groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("gone")), "gone-lines")  # a row's own lines at most
        discard(keys, hashes)
        both = numbered.join(gone, "row", "left").select("id", "text", "gone")

        def listed(batches):
            for b in batches:
                sets = [{(x["h1"], x["h2"]) for x in own or ()} for own in b.column(2).to_pylist()]

                def drop(h1, h2, _, owners):
                    a, c = h1.view(np.int64).tolist(), h2.view(np.int64).tolist()
                    return np.array([(x, y) in sets[o] for x, y, o in zip(a, c, owners.tolist())], bool)

                yield cut(b, drop)

        out = both.mapInArrow(listed, schema)
    return out.withColumnRenamed("id", id_col)
