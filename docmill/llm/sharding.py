"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split further."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import saved, scratch

#: Bits of the hash that can be used; sizes are gathered for STEP bits at a time.
HASH_BITS, STEP = 60, 12


def _hash(cols: list[Column]) -> Column:
    """60 bits of an MD5 over the key columns; a null key hashes as an empty string."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.shiftright(h, HASH_BITS - depth) if isinstance(depth, int) else F.expr(f"shiftright(h, {HASH_BITS} - depth)")


def directory(hashed: DataFrame, limit: int) -> DataFrame:
    """The leaves: depth, prefix (the first depth bits), shard_bytes, shard_rows, from rows of h and n_bytes.

    A bucket is a leaf once it fits `limit`; any other splits on the next bit. Each round sums bytes for the next bits of
    the buckets that are still too large (STEP at first, then as many as their mean size asks for, STEP at most), at
    every depth in between, by a partial and a final aggregate, so no bucket's rows meet in one task. Rounds end when all leaves fit or the bits are used up: rows whose 60 bits agree
    (repeated keys, or one row over the limit) cannot be parted and form a leaf of their own.
    """
    leaves, open_, depth, step = None, None, 0, STEP
    while True:
        top = min(depth + step, HASH_BITS)
        part = hashed if open_ is None else hashed.join(open_, _prefix(hashed["h"], depth) == open_["prefix"], "left_semi")
        fine = part.groupBy(_prefix(F.col("h"), top).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))
        levels = F.sequence(F.lit(depth + (depth > 0)), F.lit(top))
        sums = (
            fine.select(F.explode(levels).alias("depth"), "p", "n_bytes", "n_rows")
            .groupBy("depth", F.expr(f"shiftright(p, {top} - depth)").alias("prefix"))
            .agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_rows").alias("shard_rows"))
        )
        sums = saved(sums, "directory")
        over = sums.where(F.col("shard_bytes") > limit)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        split = sums.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left_semi").drop("parent")
        roots = sums.where(F.col("depth") == depth + (depth > 0))
        reached = split.unionByName(roots) if depth == 0 else split.where(F.col("depth") > depth + 1).unionByName(roots)
        fits = reached.where((F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS))
        leaves = fits if leaves is None else leaves.unionByName(fits)
        open_ = over.where(F.col("depth") == top).select("prefix")
        mean = over.where(F.col("depth") == top).agg(F.avg("shard_bytes")).first()[0]
        depth = top
        if depth == HASH_BITS or mean is None:
            return leaves
        step = min(STEP, math.ceil(math.log2(mean / limit)) + 2)


def directory_bits(leaves: int, deepest: int) -> int:
    """Bits of a directory that has a few slots for each leaf: a row meets the leaf of its slot alone, but in the rare slots of deeper leaves."""
    return min(deepest, max(1, 8 * leaves).bit_length() - 1)


def shard(df: DataFrame, limit: int, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The key columns with n_bytes, shard (the prefix as bits), depth, shard_bytes, shard_rows; one row per input row.

    Only built-in functions run. n_bytes is the text's UTF-8 length, 0 for null. No shard is over `limit` bytes, but for
    one whose rows share one key hash: a single larger row, or repeated rows, which are never parted. An empty table
    gives no rows; a table that fits gives one shard with the empty prefix. Null and repeated keys are hashed like any
    other; extra columns are ignored. Rows find their leaf by an equality join on the slots of the directory.
    """
    hashed = df.select(*key_cols, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), _hash([F.col(c) for c in key_cols]).alias("h"))
    with scratch() as keep:
        keep(hashed := saved(hashed, "hashed"))  # so that texts are read once
        leaves = saved(directory(hashed.select("h", "n_bytes"), limit), "leaves")
        n, deepest = leaves.agg(F.count("*"), F.max("depth")).first()
        top = directory_bits(n, deepest or 0)
        first, past = F.expr(f"shiftleft(prefix, greatest({top} - depth, 0))"), F.expr(f"shiftleft(prefix + 1, greatest({top} - depth, 0)) - 1")
        slots = F.when(F.col("depth") > top, F.array(F.expr(f"shiftright(prefix, greatest(depth - {top}, 0))"))).otherwise(F.sequence(first, past))
        keep(entries := saved(leaves.withColumn("slot", F.explode(slots)), "slots"))  # so that Spark knows its size
    if not n:
        return hashed.select(*key_cols, "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows")).limit(0)
    rows = hashed.withColumn("slot", _prefix(F.col("h"), top))
    found = rows.join(entries, (rows["slot"] == entries["slot"]) & (_prefix(F.col("h"), F.col("depth")) == F.col("prefix")))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return found.select(*key_cols, "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def write_shards(df: DataFrame, path: str, limit: int, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> None:
    """df, all rows and columns, as one Parquet folder per shard; rows are dealt by shard, so a shard is written by one task and stays within its limit.

    Null keys and texts and repeated rows are written as they are; an empty table writes no shard. A column called shard is replaced.
    """
    with scratch():
        ids = saved(shard(df, limit, key_cols, text_col).select(*(F.col(c).alias(f"__{c}") for c in key_cols), F.col("shard").alias("__shard")).distinct(), "shard-ids")
        on = [df[c].eqNullSafe(ids[f"__{c}"]) for c in key_cols]
        own = [df[c] for c in df.columns if c.lower() != "shard"]
        df.join(ids, on).select(*own, F.col("__shard").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
