"""Vector search: metadata filters, cosine scores, top-k."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.session import saved


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def where_equal(df: DataFrame, **conditions) -> DataFrame:
    """Rows that meet every condition whose value isn't None or empty; exact and case-sensitive."""
    for name, value in conditions.items():
        if value not in (None, ""):
            df = df.where(F.col(name) == F.lit(value))
    return df


def top_k(df: DataFrame, query: list[float], k: int, vector_col: str = "embedding", id_col: str = "id", digits: int | None = None, **conditions) -> DataFrame:
    """The k rows of the greatest cosine similarity with `query`: df's columns and score, rounded if `digits` are given; ties by id.

    Rows without a vector, or with one of zeros, have no score and come last. The query is a literal, so the scan
    scores and keeps k rows in each task before any meet.
    """
    target = F.array(*(F.lit(float(x)) for x in query))
    score = cosine(F.col(vector_col), target)
    scored = where_equal(df, **conditions).withColumn("score", score if digits is None else F.round(score, digits))
    return scored.orderBy(F.desc_nulls_last("score"), id_col).limit(k)


def with_ids(df: DataFrame, key: Column, ids: list) -> DataFrame:
    """The rows whose key is one of a few ids, as a condition that a join below them takes on to its inputs."""
    named = key.isin([i for i in ids if i is not None])
    return df.where(named | key.isNull() if None in ids else named)


def top_k_rows(df: DataFrame, query: list[float], k: int, vector_col: str = "embedding", id_col: str = "id", digits: int | None = None, **conditions) -> DataFrame:
    """top_k() of rows that are wide or come from a join: the ids are found by the vectors alone, then the rows of these ids are read and ranked. k is small."""
    narrow = where_equal(df, **conditions).select(id_col, vector_col)
    ids = [r[0] for r in top_k(narrow, query, k, vector_col, id_col, digits).select(id_col).collect()]
    return top_k(with_ids(df, F.col(id_col), ids), query, k, vector_col, id_col, digits, **conditions)


#: Queries that go to the tasks at a time, and scores that a worker makes at a time.
QUERY_BLOCK, CELLS = 1024, 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x.cast("double") != 0), F.lit(False))


def units(vectors: list, dims: int) -> np.ndarray:
    """Vectors of `dims` components as rows of length one."""
    x = np.array(vectors, np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def blocks_of_queries(queries: DataFrame, query_col: str, vector_col: str, dims: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of the queries, QUERY_BLOCK at a time; the driver holds one block."""
    names, vectors = [], []
    for name, v in queries.select(query_col, vector_col).toLocalIterator():
        names.append(name)
        vectors.append(v)
        if len(names) == QUERY_BLOCK:
            yield names, units(vectors, dims)
            names, vectors = [], []
    if names:
        yield names, units(vectors, dims)


def best_of_batch(b: pa.RecordBatch, asked: np.ndarray, k: int) -> pa.RecordBatch:
    """q, id, score of the k best rows (id, vector) of a batch for each of the asked unit vectors, ties by id; CELLS scores are made at a time."""
    dims = asked.shape[1]
    order = pc.sort_indices(b.column(0), null_placement="at_start").to_numpy()
    key, score = np.zeros((len(asked), 0), np.int64), np.zeros((len(asked), 0))  # of the best so far
    step = max(1, CELLS // len(asked))
    for start in range(0, len(order), step):
        rows = b.column(1).take(pa.array(order[start : start + step])).to_pylist()
        good = np.array([v is not None and len(v) == dims and None not in v and bool(np.isfinite(v).all()) and any(v) for v in rows], bool)
        s = np.full((len(asked), len(rows)), np.nan)
        if good.any():
            s[:, good] = asked @ units([v for v, g in zip(rows, good) if g], dims).T
        # one number orders a row: nine digits of its score, then its place among the ids; none comes after all scores
        own = np.where(np.isnan(s), -(1 << 31), np.rint(np.nan_to_num(s) * 1e9)).astype(np.int64) * (1 << 31) - np.arange(start, start + len(rows))
        key, score = np.hstack([key, own]), np.hstack([score, s])
        if key.shape[1] > k:
            best = np.argpartition(-key, k - 1, axis=1)[:, :k]
            key, score = np.take_along_axis(key, best, 1), np.take_along_axis(score, best, 1)
    at = pa.array(order[(-key % (1 << 31)).reshape(-1)])
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), key.shape[1]), pa.int32()), b.column(0).take(at), pa.array(score.reshape(-1), mask=np.isnan(score).reshape(-1))], ["q", "id", "score"])


def _block_best(df: DataFrame, names: list, asked: np.ndarray, k: int, kind: str, id_kind: str) -> DataFrame:
    """query_id, id, score: for each query of a block the k best rows of every batch of df (id, vector), by nine digits, ties by id."""
    shared = df.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for b in batches:
            yield best_of_batch(b, shared.value, k)

    told = df.sparkSession.createDataFrame(list(enumerate(names)), f"q int, query_id {kind}")
    return df.mapInArrow(run, f"q int, id {id_kind}, score double").join(F.broadcast(told), "q").select("query_id", "id", "score")


def top_k_each(df: DataFrame, queries: DataFrame, k: int, vector_col: str = "embedding", id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """query_id, id, score, rank for every row of queries (query_id and a vector): the k best rows, by nine digits of the score, ties by id.

    Rows without a direction (null, zeros, not finite) or of another length than the query have no score and come last, as all
    rows do for such a query. Queries go to the tasks in blocks of bounded size, one pass over df each; a batch of rows is scored by one
    matrix product and gives k rows a query, so no pair leaves a task that can't be among the best.
    """
    c = F.col
    rows = df.select(c(id_col).alias("id"), c(vector_col).alias("vector"))
    asked = queries.select(c(query_col).alias("query_id"), c(vector_col).alias("asked"))
    kind, id_kind = asked.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    good = asked.where(usable(c("asked")))
    parts = [
        _block_best(rows, names, x, k, kind, id_kind)
        for (dims,) in good.select(F.size("asked")).distinct().collect()  # as many as there are lengths of queries
        for names, x in blocks_of_queries(good.where(F.size("asked") == dims), "query_id", "asked", dims)
    ]
    lost = asked.where(~usable(c("asked"))).select("query_id")
    if not lost.isEmpty():  # the first rows by id, without a score
        parts.append(lost.join(rows.select("id").orderBy("id").limit(k), F.lit(True)).select("query_id", "id", F.lit(None).cast("double").alias("score")))
    found = functools.reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], f"query_id {kind}, id {id_kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("score", 9)), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(c("query_id").alias(query_col), c("id").alias(id_col), "score", "rank")


def top_k_relaxed(df: DataFrame, query: list[float], k: int, vector_col: str = "embedding", id_col: str = "id", **conditions) -> DataFrame:
    """top_k(), without the conditions if no row meets them."""
    found = saved(top_k(df, query, k, vector_col, id_col, **conditions), "relaxed")  # k rows, so that the scan is made once
    return top_k(df, query, k, vector_col, id_col) if found.isEmpty() else found


def latest_by_id(stored: DataFrame, batch: DataFrame, id_col: str = "id") -> DataFrame:
    """An upsert: stored rows whose id isn't in the batch, and the batch's rows, one for each id."""
    fresh = batch.dropDuplicates([id_col])
    return stored.join(fresh.select(id_col), id_col, "left_anti").unionByName(fresh, allowMissingColumns=True)
