"""Embedding near-dedup: NN-descent refines a neighbour graph, exact cosines decide on its edges, components follow."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import saved, scratch
from docmill.llm.jaccard import components
from docmill.llm.vectors import whole

COSINE = 0.95
#: Neighbours in a list at first; sorted tables and rows of a block for the first graph; updates that a row may get from a list besides those that may link.
LIST, TABLES, BLOCK, NEAREST = 16, 4, 256, 3
#: Rounds of a descent at most; from the second on it ends when no more than this share of the edges that may link are new.
ROUNDS, SETTLED = 6, 0.02
#: Before a descent dense places become balls while these take at least this share of the nodes.
WORTH = 0.01
#: What the cosine of two codes may be off by. Guard of exact angles in radians.
MARGIN, GUARD = 0.03, 1e-7
#: Vectors whose links are counted against all others, the share of them that must be found, and how often lists and tables are doubled for it.
AUDITED, RECALL, ATTEMPTS = 1024, 0.95, 3
#: Rows of a side where the members of two balls meet.
SIDE = 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of any size but zero, to length one; no square of theirs overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes_of(x: np.ndarray) -> np.ndarray:
    """The direction of each row in bytes."""
    return np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)


def _by_length(lists: list) -> Iterator[tuple[np.ndarray, int]]:
    """Places of the lists of each length, and that length."""
    sizes = np.array([len(v) for v in lists], np.int64)
    for d in np.unique(sizes).tolist():
        yield np.flatnonzero(sizes == d), d


def _coded(rows: list[bytes], d: int) -> np.ndarray:
    """Codes as rows of length one."""
    x = np.frombuffer(b"".join(rows), np.int8).reshape(-1, d).astype(np.float32)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, and where each group starts; rows come sorted by their first `keys` columns, all integers."""
    held: list[pa.RecordBatch] = []

    def cut(b: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(b.num_rows - 1, 0), bool)
        for k in range(keys):
            x = b.column(k).to_numpy(zero_copy_only=False)
            change |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for b in batches:
        if not b.num_rows:
            continue
        whole_ = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        starts = cut(whole_)
        if len(starts) > 1:
            yield whole_.slice(0, int(starts[-1])), starts[:-1]
        held = [whole_.slice(int(starts[-1]))]
    if held:
        yield held[0], np.zeros(1, np.int64)


_UPDATE = "a long, b long, s float, k int"


def _edges(a: list, b: list, s: list, k: list) -> pa.RecordBatch:
    many = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
    return pa.RecordBatch.from_arrays([many(a, pa.int64()), many(b, pa.int64()), many(s, pa.float32()), many(k, pa.int32())], ["a", "b", "s", "k"])


def _first_graph(nodes: DataFrame, tables: int) -> DataFrame:
    """Edges between rows that stand near one another in the order of sign patterns on random planes, in several such orders.

    Ranges of an order go to tasks, so a dense region is many blocks; no bucket grows with it.
    """

    def patterns(batches):
        for b in batches:
            rows = b.column(1).to_pylist()
            key = np.empty((len(rows), tables), np.int64)
            for at, d in _by_length(rows):
                planes = np.random.default_rng([11, d]).standard_normal((d, tables * 62)).astype(np.float32)
                signs = (_coded([rows[i] for i in at], d) @ planes > 0).reshape(len(at), tables, 62)
                key[at] = (signs.astype(np.int64) << np.arange(61, -1, -1)).sum(2)
            n = np.repeat(np.arange(len(rows)), tables)
            t = np.tile(np.arange(tables), len(rows))
            cols = [pa.array(t, pa.int32()), pa.array([len(rows[i]) for i in n], pa.int32()), pa.array(key.reshape(-1)), b.column(0).take(pa.array(n)), b.column(1).take(pa.array(n)), b.column(2).take(pa.array(n))]
            yield pa.RecordBatch.from_arrays(cols, ["t", "dims", "key", "node", "code", "k"])

    def near(batches):
        for b, starts in _groups(batches, 2):
            ends = [*starts[1:].tolist(), b.num_rows]
            node, rows, k = (b.column(c).to_pylist() if c == 4 else b.column(c).to_numpy() for c in (3, 4, 5))
            out: tuple[list, ...] = ([], [], [], [])
            for start, end in zip(starts.tolist(), ends):
                for at in range(start, end, BLOCK):
                    own = slice(at, min(at + BLOCK, end))
                    x = _coded(rows[own], len(rows[at]))
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    m = min(LIST // 2, len(x) - 1)
                    if m < 1:
                        continue
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m].reshape(-1)
                    i = np.repeat(np.arange(len(x)), m)
                    for own_, col in zip(out, (node[own][i], node[own][best], s[i, best], k[own][i])):
                        own_.append(col)
            yield _edges(*out)

    seats = nodes.select("node", "code", "k").mapInArrow(patterns, "t int, dims int, key long, node long, code binary, k int")
    order = ["t", "dims", "key", F.xxhash64("node", "t")]
    return seats.repartitionByRange(*order).sortWithinPartitions("t", "dims", "key").mapInArrow(near, _UPDATE)


def _local_join(batches):
    """Rows (v, u, fresh, k, worst, code) by v: edges between the neighbours u of one v, new ones against all, that enter the list of their first end."""
    for b, starts in _groups(batches, 1):
        u, fresh, k, worst = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4))
        rows = b.column(5).to_pylist()
        sizes = np.diff([*starts, b.num_rows])
        wide = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        out: tuple[list, ...] = ([], [], [], [])
        for d in {len(r) for r in rows}:
            for size in np.unique(wide[[len(rows[i]) == d for i in starts]]).tolist():
                some = np.flatnonzero((wide == size) & np.array([len(rows[i]) == d for i in starts]))
                step = max(1, (1 << 22) // (size * max(size, d)))
                for g in range(0, len(some), step):
                    part = some[g : g + step]
                    at = starts[part][:, None] + np.arange(size)
                    there = np.arange(size) < sizes[part][:, None]
                    at = np.where(there, at, starts[part][:, None])
                    used, inverse = np.unique(at, return_inverse=True)
                    x = _coded([rows[i] for i in used], d)[inverse.reshape(at.shape)]
                    s = x @ x.transpose(0, 2, 1)
                    new = fresh[at].astype(bool)
                    ok = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (u[at][:, :, None] != u[at][:, None, :]) & (s > worst[at][:, :, None])
                    s[~ok] = -2
                    keep = ok & (s >= COSINE - MARGIN)
                    m = min(NEAREST, size)
                    best = np.argpartition(-s, m - 1, axis=2)[:, :, :m]
                    np.put_along_axis(keep, best, np.take_along_axis(ok, best, 2), 2)
                    q, i, j = np.nonzero(keep)
                    for own, col in zip(out, (u[at[q, i]], u[at[q, j]], s[q, i, j], k[at[q, i]])):
                        own.append(col)
        yield _edges(*out)


def _best(edges: DataFrame, most: int) -> DataFrame:
    """The k nearest of each node, each once; an edge that was there before isn't new. `most` is the greatest k."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return once.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= F.col("k")).drop("place")


def _descended(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The graph after NN-descent: in each round the neighbours and (as many) inverse neighbours of every node are joined with one another."""
    for n in range(ROUNDS):
        back = edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "fresh")
        place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("u", "v", F.lit(n))))
        back = back.withColumn("place", place).where(F.col("place") <= most).drop("place")
        around = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh").unionByName(back).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        last = edges.groupBy(F.col("a").alias("u")).agg(F.min("s").alias("s"), F.count("*").alias("c"))
        told = nodes.select(F.col("node").alias("u"), "code", "k").join(last, "u", "left")
        told = told.select("u", "k", F.when(F.col("c") >= F.col("k"), F.col("s")).otherwise(F.lit(-1.5).cast("float")).alias("worst"), "code")
        seats = around.join(told, "u").select("v", "u", "fresh", "k", "worst", "code").repartition("v").sortWithinPartitions("v")
        found = seats.mapInArrow(_local_join, _UPDATE).withColumn("fresh", F.lit(True))
        edges = saved(_best(edges.withColumn("fresh", F.lit(False)).select("a", "b", "s", "k", "fresh").unionByName(found), most), "edges")
        near = F.col("s") >= COSINE - MARGIN
        new, all_ = edges.agg(F.count_if(near & F.col("fresh")), F.count_if(near)).first()
        if n and new <= SETTLED * all_:
            break
    return edges


def _angles(df: DataFrame, a: str, b: str, name: str = "angle") -> DataFrame:
    """df without the vectors a and b (arrays of doubles of one length), and the angle between them."""
    kept = [c for c in df.columns if c not in (a, b)]

    def run(batches):
        for batch in batches:
            x, y = (batch.column(k) for k in (len(kept), len(kept) + 1))
            out = np.zeros(batch.num_rows)
            left, right = x.to_pylist(), y.to_pylist()
            for at, _ in _by_length(left):
                p, q = (unit(np.array([side[i] for i in at], np.float64)) for side in (left, right))
                out[at] = np.arccos(np.clip((p * q).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out)], [*kept, name])

    rows = df.select(*kept, a, b)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{kinds}, {name} double")


def _as_nodes(pivots: DataFrame, k: int) -> DataFrame:
    """node, code, angle, k of pivots (node, p, angle, w)."""

    def run(batches):
        for b in batches:
            rows = b.column(1).to_pylist()
            out: list = [b""] * len(rows)
            for at, d in _by_length(rows):
                for i, c in zip(at.tolist(), codes_of(np.array([rows[i] for i in at], np.float64))):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["node", "code", "angle"])

    return pivots.select("node", "p", "angle").mapInArrow(run, "node long, code binary, angle double").withColumn("k", F.lit(k))


def _reach(a: str, b: str, theta: float):
    """The least cosine of the codes of two pivots whose balls may hold linked vectors."""
    return F.cos(F.least(F.lit(theta) + F.col(a) + F.col(b), F.lit(math.pi))) - MARGIN


def _saturated(edges: DataFrame, nodes: DataFrame, theta: float) -> DataFrame:
    """Nodes whose list is full of neighbours that may link, so that there may be more."""
    widest = nodes.agg(F.max("angle")).first()[0] or 0.0
    full = edges.groupBy("a").agg(F.count("*").alias("c"), F.min("s").alias("s"))
    own = nodes.select("node", "angle", "k", F.lit(widest).alias("widest")).join(full, F.col("node") == F.col("a"))
    return own.where((F.col("c") >= F.col("k")) & (F.col("s") >= _reach("angle", "widest", theta))).select("node")


def _balls(edges: DataFrame, full: DataFrame, classes: DataFrame, theta: float) -> DataFrame:
    """node, ball, angle, mean: vectors in dense places, within half the threshold's angle of the mean of their place, so that any two of a ball link.

    Places are the components of saturated nodes (single vectors all). ball is the least node of it.
    """
    some = lambda c: edges.join(full.select(F.col("node").alias(c)), c, "left_semi")
    dense = some("a").join(full.select(F.col("node").alias("b")), "b", "left_semi").where(F.col("s") >= COSINE).select("a", "b")
    labels = components(dense).withColumnRenamed("node", "member")
    own = saved(labels.join(classes.select(F.col("node").alias("member"), "p", "w"), "member"), "dense")

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            label, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, _ in _by_length(rows):
                for i, v in zip(at.tolist(), unit(np.array([rows[i] for i in at], np.float64))):
                    sums[label[i]] = sums.get(label[i], 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["label", "sums"])

    parts = own.select("label", "p").mapInArrow(added, "label long, sums array<double>").select("label", F.posexplode("sums").alias("j", "x"))
    mean = parts.groupBy("label", "j").agg(F.sum("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("m"))
    mean = mean.select("label", F.transform("m", lambda z: z["x"]).alias("mean")).where(F.exists("mean", lambda x: x != 0))
    inside = saved(_angles(own.join(mean, "label").select("label", "member", "w", "p", "mean"), "p", "mean").where(F.col("angle") <= theta / 2 - GUARD), "inside")
    about = inside.groupBy("label").agg(F.min("member").alias("ball"), F.max("angle").alias("angle"), F.sum("w").alias("w"), F.count("*").alias("c")).where("c > 1")
    return saved(inside.drop("angle", "w").join(about.join(mean, "label"), "label").select(F.col("member").alias("node"), "ball", "angle", "w", "mean"), "balls")


def _explored(classes: DataFrame, k: int, tables: int, theta: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pivots (node, p, angle, w), members (node, ball) of balls of several, and edges of the pivots' graph that may link.

    Saturated lists are made enough in two ways: vectors of a dense place become one ball, as they link anyway; where there is no
    such ball, lists are doubled and the descent goes on.
    """
    pivots = classes.select("node", "p", F.lit(0.0).alias("angle"), "w")
    members = classes.select("node", F.col("node").alias("ball")).where("false")
    while True:
        nodes, most = saved(_as_nodes(pivots, k), "nodes"), k
        edges = saved(_best(_first_graph(nodes, tables).withColumn("fresh", F.lit(True)), most), "edges")
        descended = False
        while True:
            full = saved(_saturated(edges, nodes, theta), "saturated")
            if not full.isEmpty():  # dense places fill the lists of the first graph already
                single = full.join(nodes.where("angle = 0").select("node"), "node", "left_semi")
                balls = _balls(edges, single, classes, theta)
                if not balls.isEmpty() if descended else balls.count() > WORTH * nodes.count():
                    break
            elif descended:
                return pivots, members, edges.join(nodes.select(F.col("node").alias("a"), F.col("angle").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("angle").alias("y")), "b").where(F.col("s") >= _reach("x", "y", theta)).select("a", "b")
            if not descended:
                edges, descended = _descended(nodes, edges, most), True
                continue
            most *= 2
            nodes = saved(nodes.join(full.withColumn("again", F.lit(True)), "node", "left").select("node", "code", "angle", F.when(F.col("again"), F.col("k") * 2).otherwise(F.col("k")).alias("k")), "nodes")
            own = nodes.select(F.col("node").alias("a"), F.col("k").alias("own"))
            edges = saved(edges.join(own, "a").select("a", "b", "s", (F.col("own") > F.col("k")).alias("fresh"), F.col("own").alias("k")), "edges")
            edges = _descended(nodes, edges, most)
        rest = pivots.join(balls.select("node"), "node", "left_anti")
        made = balls.groupBy("ball").agg(F.first("mean").alias("p"), F.first("angle").alias("angle"), F.first("w").alias("w")).select(F.col("ball").alias("node"), "p", "angle", "w")
        pivots = saved(rest.unionByName(made), "pivots")
        members = members.unionByName(balls.select("node", "ball"))


def _verdict(angle: str, own: str, other: str, theta: float, cosine: float):
    """1 where all pairs of two balls link, 0 where none does, null where that is open; two single vectors are decided by their cosine."""
    c, r = F.col(angle), F.col(own) + F.col(other)
    return F.when(r == 0, (F.cos(c) >= cosine).cast("int")).when(c + r <= theta - GUARD, 1).when(c - r > theta + GUARD, 0)


def _met(seats: DataFrame, cosine: float) -> DataFrame:
    """lo, hi, m, n, of seats sorted by (lo, hi, i, j): how many vectors of the other side (with their copies) a member links with."""

    def run(batches):
        for b, starts in _groups(batches, 4):
            lo, hi, side, m, w = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 4, 5, 6))
            rows = b.column(7).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                x, s = unit(np.array(rows[start:end], np.float64)), side[start:end]
                linked = (x[s == 0] @ x[s == 1].T) >= cosine
                for which, n in ((0, linked @ w[start:end][s == 1]), (1, linked.T @ w[start:end][s == 0])):
                    for own, col in zip(out, (lo[start:end][s == which], hi[start:end][s == which], m[start:end][s == which], n)):
                        own.append(col)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in out], ["lo", "hi", "m", "n"])

    return seats.repartition("lo", "hi", "i", "j").sortWithinPartitions("lo", "hi", "i", "j").mapInArrow(run, "lo long, hi long, m long, n long").where("n > 0")


def _linked(classes: DataFrame, pivots: DataFrame, members: DataFrame, edges: DataFrame, theta: float, cosine: float) -> tuple[DataFrame, DataFrame]:
    """links a, b between pivots, and node, n: with how many vectors (copies counted) of other balls each class links.

    Whole balls are decided by the angle of their pivots; where that leaves it open, each member by its angle to the other pivot;
    members that are open on both sides meet, SIDE by SIDE. No pairs are rows.
    """
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda own, p: pivots.select(F.col("node").alias(own), F.col("p").alias(p), F.col("angle").alias(f"angle_{own}"), F.col("w").alias(f"w_{own}"))
    pairs = _angles(ends.join(side("a", "pa"), "a").join(side("b", "pb"), "b"), "pa", "pb").withColumn("all", _verdict("angle", "angle_a", "angle_b", theta, cosine)).where("all IS NULL OR all = 1")
    pairs = saved(pairs.drop("angle"), "pairs")
    sure = pairs.where("all = 1")
    links = sure.select("a", "b")
    by_ball = sure.select(F.col("a").alias("ball"), F.col("w_b").alias("n")).unionByName(sure.select(F.col("b").alias("ball"), F.col("w_a").alias("n"))).groupBy("ball").agg(F.sum("n").alias("n"))
    own = classes.select("node", "p", "w").join(members, "node", "left").select("node", F.coalesce("ball", "node").alias("ball"), "p", "w")
    parts = [own.select("node", "ball").join(by_ball, "ball").select("node", "n")]
    open_ = pairs.where("all IS NULL")
    if not open_.isEmpty():
        asks = open_.select(F.col("a").alias("ball"), F.col("b").alias("other")).unionByName(open_.select(F.col("b").alias("ball"), F.col("a").alias("other")))
        asked = asks.join(own, "ball").join(side("other", "q"), "other").withColumn("own_angle", F.lit(0.0)).withColumn("v", F.col("p"))
        told = saved(_angles(asked, "p", "q").withColumn("all", _verdict("angle", "own_angle", "angle_other", theta, cosine)).where("all IS NULL OR all = 1"), "told")
        full = told.where("all = 1")
        parts.append(full.select("node", F.col("w_other").alias("n")))
        from_ = full.groupBy(F.col("other").alias("ball"), F.col("ball").alias("other")).agg(F.sum("w").alias("n"))
        unsure = told.where("all IS NULL")
        parts.append(unsure.join(from_, ["ball", "other"]).select("node", "n"))
        sizes = unsure.groupBy("ball", "other").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("mine"))
        both = sizes.join(sizes.select(F.col("ball").alias("other"), F.col("other").alias("ball"), F.col("mine").alias("yours")), ["ball", "other"])
        chunk, all_ = F.pmod(F.xxhash64("node"), F.col("mine")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("yours") - 1))
        met = unsure.join(both, ["ball", "other"]).select("*", chunk.alias("x"), all_.alias("y"))
        first = F.col("ball") < F.col("other")
        seats = met.select(F.least("ball", "other").alias("lo"), F.greatest("ball", "other").alias("hi"), F.when(first, F.col("x")).otherwise(F.col("y")).alias("i"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("j"), F.when(first, 0).otherwise(1).alias("side"), F.col("node").alias("m"), "w", "v")
        counted = saved(_met(seats, cosine), "met")
        parts.append(counted.select(F.col("m").alias("node"), "n"))
        links = links.unionByName(full.select(F.col("ball").alias("a"), F.col("other").alias("b"))).unionByName(counted.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    inner = own.join(members.select("ball").distinct().join(pivots.select(F.col("node").alias("ball"), F.col("w").alias("total")), "ball"), "ball", "left").select("node", "ball", (F.coalesce("total", "w") - 1).alias("n"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("more"))
    return links.distinct(), inner.join(counts, "node", "left").select("node", "ball", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def _recall(classes: DataFrame, counts: DataFrame, cosine: float, audited: int) -> float:
    """The share of the links of `audited` vectors (or of all) that were found; those are all true, as each was decided exactly."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(audited).select("node", "p").collect()
    names = np.array([r[0] for r in sample], np.int64)
    asked = [(names[at], unit(np.array([sample[i][1] for i in at], np.float64))) for at, _ in _by_length([r[1] for r in sample])]
    shared = classes.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        known = {x.shape[1]: (n, x, np.zeros(len(n), np.int64)) for n, x in shared.value}
        for b in batches:
            w, rows = b.column(0).to_numpy(), b.column(1).to_pylist()
            for at, d in _by_length(rows):
                if d in known:
                    for k in range(0, len(at), 1024):
                        own = at[k : k + 1024]
                        known[d][2][:] += ((known[d][1] @ unit(np.array([rows[i] for i in own], np.float64)).T) >= cosine) @ w[own]
        for n, _, c in known.values():
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(c)], ["node", "c"])

    true = classes.select("w", "p").mapInArrow(run, "node long, c long").groupBy("node").agg((F.sum("c") - 1).alias("c"))
    found, wanted = true.join(counts, "node").agg(F.sum("n"), F.sum("c")).first()
    shared.unpersist()
    return found / wanted if wanted else 1.0


def near_groups(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, audited: int = AUDITED, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id (the smallest id reachable by links, its own included), kept, recall.

    Two vectors of one length link if the graph brings them together and their cosine, in doubles, is `cosine` or more; none below it
    links, and equal vectors always do. Vectors that are null, of zeros only or empty, or that hold null or non-finite
    components, link with nothing. kept is whether the id is its component's. Rows that share an id are vectors of their own; null
    ids count after all others, and a component of null ids alone has a null one and keeps its rows. Other columns are ignored. An empty table
    gives no rows.

    NN-descent over codes of a byte a component: the first graph has neighbours in a few orders of sign patterns; in each round
    neighbours of neighbours are joined, new ones only, and each node keeps its nearest. Where a list is full of neighbours that
    may link, its dense place becomes one ball (any two vectors of it link by the triangle inequality of angles) or, where there
    is none, lists are doubled. Edges that may link are decided by exact cosines, whole balls by bounds where these hold.
    `audited` vectors are then counted against all; unless they have found the share `recall` of their links, the graph is
    made again with twice the lists and tables, ATTEMPTS times at most. The share that was found is the column recall.

    A list is bounded, as is what comes from inverse neighbours; copies are one class with a count. A dense place without balls, such
    as a chain of places each of which has more vectors than a list, takes lists of its size.
    """
    theta = math.acos(cosine)
    c = F.col
    nothing = F.lit(0.0).cast(df.schema[vector_col].dataType.elementType)
    usable = whole(c(vector_col)) & F.exists(c(vector_col), lambda x: x != nothing)
    rows = df.select(c(id_col).alias("id"), c(vector_col).alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    with scratch() as keep:
        same = rows.where("usable").groupBy("v").agg(F.count("*").alias("w"), F.min("id").alias("least"))
        classes = saved(same.select(F.monotonically_increasing_id().alias("node"), "v", c("v").cast("array<double>").alias("p"), "w", "least"), "vectors")
        k, tables = LIST, TABLES
        for attempt in range(ATTEMPTS):
            links, counts = _linked(classes, *_explored(classes, k, tables, theta), theta, cosine)
            links, counts = saved(links, "links"), saved(counts, "counts")
            found = _recall(classes, counts, cosine, audited)
            if found >= recall:
                break
            k, tables = 2 * k, 2 * tables
        labels = components(links)
        labelled = counts.join(labels.select(c("node").alias("own"), "label"), c("ball") == c("own"), "left").select("node", "n", F.coalesce("label", "ball").alias("label")).where("n > 0")
        named = saved(labelled.join(classes.select("node", "v", "least"), "node"), "named")
        least = named.groupBy("label").agg(F.min("least").alias("component"))
        keep(known := saved(named.join(least, "label").select(c("v").alias("own"), "n", "component"), "known"))
    out = rows.join(known, c("usable") & (c("v") == c("own")), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(c("n").isNull(), c("id")).otherwise(c("component")).alias("component"))
    return out.select(c("id").alias(id_col), c("n").alias("n_links"), c("component").alias("component_id"), c("id").eqNullSafe(c("component")).alias("kept"), F.lit(float(found)).alias("recall"))
