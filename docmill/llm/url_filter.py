"""URL filters: a blocked Bloom filter of listed prefixes lets possible hits through to an exact hash join."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, PROBES = 512, 6
#: Stands between the host and the path of a rule, as no host has it.
BETWEEN = "/"
#: The filter never takes more bytes than this, however long the list; beyond it more false hits reach the exact join.
MAX_FILTER_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _places(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key and its bits within the block."""
    h = np.array([xxhash.xxh64_intdigest(k.encode()) for k in keys], dtype=np.uint64)
    g = np.array([xxhash.xxh64_intdigest(k.encode(), 1) for k in keys], dtype=np.uint64)
    bits = np.stack([(g >> np.uint64(9 * i)) % np.uint64(BLOCK_BITS) for i in range(PROBES)], 1) if len(keys) else np.zeros((0, PROBES), np.uint64)
    return (h % np.uint64(blocks)).astype(np.int64), bits.astype(np.int64)


def bloom_of(rules: DataFrame, blocks: int) -> np.ndarray:
    """The filter's bits, blocks x BLOCK_BITS / 8 bytes; tasks set the bits, the driver gets one row for each block that has any."""

    def fill(batches):
        for b in batches:
            at, bits = _places(list(b["rule"]), blocks)
            out = {}
            for block, own in zip(at.tolist(), bits.tolist()):
                out[block] = out.get(block, 0) | sum(1 << x for x in set(own))
            yield pd.DataFrame({"block": list(out), "bits": [v.to_bytes(BLOCK_BITS // 8, "little") for v in out.values()]})

    words = BLOCK_BITS // 64
    lanes = [F.bit_or(F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("long")).alias(f"w{i}") for i in range(words)]
    found = rules.select("rule").mapInPandas(fill, "block long, bits binary").groupBy("block").agg(*lanes).toPandas()
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for i in range(words):  # the words were read big-endian, eight bytes each
        out[found["block"].to_numpy(), 8 * i : 8 * i + 8] = found[f"w{i}"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
    return out


def filter_urls(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """df with the columns host, path, rule and verdict (they replace columns of those names).

    rules has host, path and verdict (allow or block). A rule fits its host and all subdomains if the url's path starts
    with the rule's path; the longest rule (host and path together) wins, then block over allow. A url that no rule
    fits gets a null rule and `default`. Null urls and urls without :// have an empty host and path, which no rule with
    a host fits. Rules with a null or empty host, one with a slash, or a null path are ignored; repeated rules count once; an empty rule
    table leaves every url to `default`.

    A rule's host and path are compared apart. Each distinct url offers its possible prefixes to the filter: host suffixes
    of as many labels as any rule's host has at most, times the path lengths that rules have, so that very long urls cost
    no more than that; only those that pass are joined, by equality, with the rules. The filter's size is bounded; rules and urls
    meet in a plain join, which Spark broadcasts or shuffles by their sizes and may split where a url is hot.
    """
    own = [F.col("host"), F.col("path")]
    rules = rules.where("host != '' AND path IS NOT NULL AND NOT contains(host, '/')").groupBy(F.concat_ws(BETWEEN, *own).alias("rule")).agg(F.max("verdict").alias("ruled"), F.max(F.concat(*own)).alias("shown"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("length"))
    n, lengths, most = rules.agg(F.count("*"), F.collect_set("length"), F.max("labels")).first()
    blocks = max(1, min(math.ceil(n * 12 / BLOCK_BITS), max_filter_bytes * 8 // BLOCK_BITS))
    bits = df.sparkSession.sparkContext.broadcast(bloom_of(rules, blocks))
    lengths, most = sorted(lengths), most or 1

    @F.pandas_udf("array<string>")
    def possible(host: pd.Series, path: pd.Series) -> pd.Series:
        table, keys, owner = bits.value, [], []
        for i, (h, p) in enumerate(zip(host, path)):
            labels = h.rsplit(".", most)[-most:] if h.count(".") >= most else h.split(".")
            tails = [".".join(labels[j:]) for j in range(len(labels))] if h else []
            heads = [p[:k] for k in lengths if k <= len(p)]
            for tail in tails:
                for head in heads:
                    keys.append(tail + BETWEEN + head)
                    owner.append(i)
        at, own = _places(keys, blocks)
        hit = ((table[at[:, None], own >> 3] >> (own & 7).astype(np.uint8)) & 1).all(1)
        out = [[] for _ in range(len(host))]
        for i in np.flatnonzero(hit):
            out[owner[i]].append(keys[i])
        return pd.Series(out)

    urls = df.select(F.col(url_col).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    split = urls.select("__url", host_of(F.col("__url")).alias("h"), path_of(F.col("__url")).alias("p")).where("h != ''")
    hits = split.select("__url", F.explode(possible("h", "p")).alias("rule")).join(rules, "rule")
    best = hits.groupBy("__url").agg(F.max(F.struct(F.length("shown").alias("n"), "ruled", "shown")).alias("best"))
    best = best.select("__url", F.col("best.shown").alias("__rule"), F.col("best.ruled").alias("__ruled"))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    return df.join(best, df[url_col] == best["__url"], "left").select(
        *(df[c] for c in kept),
        host_of(df[url_col]).alias("host"),
        path_of(df[url_col]).alias("path"),
        best["__rule"].alias("rule"),
        F.coalesce(best["__ruled"], F.lit(default)).alias("verdict"),
    )
