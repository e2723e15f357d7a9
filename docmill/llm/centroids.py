"""Centroid clustering by kd-tree filtering: exact k-means over integers, with trees over the rows of each partition."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import saved, scratch
from docmill.llm.vectors import components, packed, scaled, squared_distances, sums_of, unpacked, whole

K, ROUNDS, SCALE, DIMS, SALT = 16, 3, 64, 64, "1"
#: Rows of a leaf at most, and bytes of the 64-bit components of a tree.
LEAF, TREE_BYTES = 32, 8 << 20


@dataclass
class Tree:
    """A kd-tree over rows: level l has 2**l nodes, node i of it the rows from n * i >> l on. Boxes and sums go from the root's level to the leaves'."""

    rows: np.ndarray
    order: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]


def edges(n: int, level: int) -> np.ndarray:
    return (n * np.arange((1 << level) + 1)) >> level


def levels_of(n: int) -> int:
    return max(0, (-(-n // LEAF) - 1).bit_length())


def build(x: np.ndarray) -> Tree:
    """The tree of the rows (one at least): each node is halved at the median of its widest coordinate."""
    n, deepest = len(x), levels_of(len(x))
    order = np.arange(n)
    for level in range(deepest):
        at = edges(n, level).tolist()
        half = edges(n, level + 1).tolist()[1::2]
        for start, mid, end in zip(at, half, at[1:]):
            own = order[start:end]
            points = x[own]
            widest = int((points.max(0) - points.min(0)).argmax())
            order[start:end] = own[np.argpartition(points[:, widest], mid - start)]
    rows, at = x[order], edges(n, deepest)[:-1]
    low, high, sums = ([f.reduceat(rows, at)] for f in (np.minimum, np.maximum, np.add))
    for _ in range(deepest):
        for own, f in ((low, np.minimum), (high, np.maximum), (sums, np.add)):
            own.insert(0, f(own[0][0::2], own[0][1::2]))
    return Tree(rows, order, low, high, sums)


def dominated(low: np.ndarray, high: np.ndarray, open_: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centres (nodes, centres) of those in `open_` a node's points can't belong to: another one is strictly nearer to the whole box.

    The one to compare with is the open centre nearest to the box's middle. A centre z is farther than it (z0) everywhere if it is
    so at the corner that lies farthest in the direction of z - z0.
    """
    norms = (centres * centres).sum(1)
    middle = squared_distances(low + high, 2 * centres)
    middle[~open_] = np.iinfo(np.int64).max
    best = middle.argmin(1)
    out = np.zeros(open_.shape, bool)
    for z in np.unique(best).tolist():
        own = np.flatnonzero(best == z)
        way = centres - centres[z]
        reach = high[own] @ np.maximum(way, 0).T + low[own] @ np.minimum(way, 0).T
        out[own] = norms - norms[z] - 2 * reach > 0
    return out & open_


def assign(tree: Tree, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centre of each row in the tree's order (-1 where a whole node went, see below), and n and the sums of the rows of each centre.

    From the root down dominated centres are left out. A node with one centre left is assigned by its count and its
    sums. In a leaf with several, exact distances decide, and the smaller number of equals.
    """
    n, k = len(tree.rows), len(centres)
    own, count, sums = np.full(n, -1, np.int64), np.zeros(k, np.int64), np.zeros((k, tree.rows.shape[1]), np.int64)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(len(tree.low)):
        at = edges(n, level)
        open_ = open_ & ~dominated(tree.low[level][nodes], tree.high[level][nodes], open_, centres)
        done = open_.sum(1) == 1
        went = open_[done].argmax(1)
        np.add.at(count, went, at[nodes[done] + 1] - at[nodes[done]])
        np.add.at(sums, went, tree.sums[level][nodes[done]])
        for node, z in zip(nodes[done].tolist(), went.tolist()):
            own[at[node] : at[node + 1]] = -2 - z
        nodes, open_ = nodes[~done], open_[~done]
        if level < len(tree.low) - 1:
            nodes, open_ = np.stack([2 * nodes, 2 * nodes + 1], 1).reshape(-1), np.repeat(open_, 2, 0)
    if len(nodes):
        size = at[nodes + 1] - at[nodes]
        rows = np.repeat(at[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
        far = squared_distances(tree.rows[rows], centres)
        far[~np.repeat(open_, size, 0)] = np.iinfo(np.int64).max
        best = far.argmin(1)
        own[rows] = best
        count += np.bincount(best, minlength=k)
        np.add.at(sums, best, tree.rows[rows])
    return np.where(own < -1, -2 - own, own), count, sums


def _stored(x: np.ndarray, ids: pa.Array) -> tuple[pa.Array, list[bytes]]:
    tree = build(x)
    return ids.take(pa.array(tree.order)), [packed(tree.rows), *(packed(np.concatenate(own)) for own in (tree.low, tree.high, tree.sums))]


def _loaded(rows: bytes, low: bytes, high: bytes, sums: bytes, dims: int) -> Tree:
    points = unpacked(rows, dims)
    cut = [(1 << level) - 1 for level in range(1, levels_of(len(points)) + 1)]
    return Tree(points, np.zeros(0, np.int64), *(np.split(unpacked(own, dims), cut) for own in (low, high, sums)))


_TREE = "points binary, low binary, high binary, sums binary"


def _trees(df: DataFrame, id_type: str, dims: int, scale: int) -> DataFrame:
    """ids and _TREE for each tree: a partition's rows (id, v), TREE_BYTES at a time."""
    most = max(LEAF, TREE_BYTES // (8 * dims))

    def run(batches):
        names = ["ids", "points", "low", "high", "sums"]

        def tree(held):
            ids, own = _stored(np.concatenate([x for _, x in held]), pa.concat_arrays([i for i, _ in held]))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in own)], names)

        held, size = [], 0
        for b in batches:
            for start in range(0, b.num_rows, most):
                part = b.slice(start, most)
                if size + part.num_rows > most:
                    yield tree(held)
                    held, size = [], 0
                held.append((part.column(0), scaled(components(part.column(1), dims), scale, dims)))
                size += part.num_rows
        if held:
            yield tree(held)

    return df.mapInArrow(run, f"ids array<{id_type}>, {_TREE}")


def _moved(trees: DataFrame, centres: np.ndarray, dims: int) -> np.ndarray:
    """The centres after a round: the floor of the mean of what each has. A task gives one row for each centre at most."""

    def run(batches):
        count, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                _, n, s = assign(_loaded(*row, dims), centres)
                count += n
                sums += s
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    out = centres.copy()
    for (z,), (n, s) in sums_of(trees.select("points", "low", "high", "sums").mapInArrow(run, "cluster long, n long, sums array<long>"), ["cluster"], dims).items():
        out[z] = [x // n for x in s]
    return out


def clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) for each vector, and the centres: k-means over floor(scale * x), exact in every step.

    Vectors with `dims` components, none of them null or non-finite, take part; other rows fall out. The centres start as the
    k vectors with the smallest sha256 of "salt:id", in that order; of fewer vectors each is one. Each round assigns all
    vectors to their nearest centre (squared distance, the smaller number of equals) and moves centres that have any to
    the floor of their mean. Rows with one id are assigned each by itself; as starting centres they go by their vectors, rows with
    a null id after all others. Other columns are ignored. A table without such vectors gives no rows and no
    centres. Components so large that squared distances don't fit 64 bits are an error.

    kd-trees over some thousand rows each are built in the tasks and written once; each round reads them. The driver
    holds k centres, and a task sends it k rows of counts and sums at most.
    """
    good = df.where(whole(F.col(vector_col)) & (F.size(vector_col) == dims)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    start = [r[0] for r in good.orderBy(F.asc_nulls_last(key), "v").limit(k).select("v").collect()]
    centres = scaled(np.array(start, np.float64).reshape(-1, dims), scale, dims)
    id_type = df.schema[id_col].dataType.simpleString()
    trees = saved(_trees(good, id_type, dims, scale), "trees")
    for _ in range(rounds if len(start) else 0):
        centres = _moved(trees, centres, dims)

    def run(batches):
        for b in batches:
            for at, row in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                tree = _loaded(*row, dims)
                own = assign(tree, centres)[0]
                far = ((tree.rows - centres[own]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0)[at].values, pa.array(own.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return trees.mapInArrow(run, f"id {id_type}, cluster int, distance long"), centres


def cluster_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia (sums of distances over the cluster and over all) and centroid_sha256 for each vector of clusters()."""
    with scratch() as keep:
        assigned, centres = clusters(df, id_col, vector_col, **options)
        keep(rows := saved(assigned, "clusters"))
        sums = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row for each centre
    said = [(z, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[z].tolist())).encode()).hexdigest()) for z, s in sums.items()]
    about = df.sparkSession.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
