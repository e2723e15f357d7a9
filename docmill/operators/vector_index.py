"""A stored vector index: buckets of trained centroids, residual codes, probes of few buckets and exact scores for few rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.operators.vector import CELLS, blocks_of_queries, top_k_each, units, usable, where_equal
from docmill.session import saved, scratch

#: Rows that centroids and codebooks are trained on, queries (rows of the table too) that the probes are measured with, and entries of a codebook.
SAMPLE, MEASURED, ENTRIES = 16_384, 200, 256
#: Candidates of a query that are scored exactly are MOST times k at most.
MOST = 64
#: Candidates that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


@dataclass
class Model:
    """What a search needs to know of an index: small, whatever the number of rows."""

    centroids: np.ndarray
    books: np.ndarray
    sizes: np.ndarray
    probes: int
    scored: int
    recall: float

    def rebuilt(self, bucket: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that the codes (rows, parts) of a bucket stand for."""
        parts, _, width = self.books.shape
        return self.centroids[bucket] + self.books[np.arange(parts), codes].reshape(-1, parts * width)

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Which buckets (queries, buckets) each query reads: the nearest ones."""
        near = np.argsort(-queries @ self.centroids.T, axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(queries), len(self.centroids)), bool)
        np.put_along_axis(out, near, True, 1)
        return out


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm over a sample, from k rows that are spread over it; empty ones take the rows farthest from theirs."""
    if len(x) <= k:
        return x.copy()
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d = (centres**2).sum(1) - 2 * x @ centres.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if len(empty := np.flatnonzero(n == 0)):
            centres[empty] = x[np.argsort(-(d[np.arange(len(x)), own] + (x**2).sum(1)))[: len(empty)]]
    return centres


def train(x: np.ndarray, lists: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (lists, dims) and codebooks of the residuals (parts, entries, dims / parts) from a sample of unit vectors."""
    centroids = _means(x, lists)
    rest = x - centroids[nearest(x, centroids)]
    books = [_means(part, ENTRIES) for part in np.split(rest, parts, axis=1)]
    return centroids, np.stack(books)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def build_index(df: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", columns: tuple[str, ...] = (), lists: int | None = None, parts: int = 16, sample: int = SAMPLE, k: int = 10, recall: float = 0.95) -> Model:
    """Write an index of df's vectors to the folder `path`, and return its model.

    Centroids (the square root of the number of rows, unless `lists` says how many) and codebooks are trained on `sample` rows, those
    of the smallest hashes of their ids. All rows are then assigned, coded and written by (bucket, id), sorted, so that a search
    reads the row groups of its buckets alone; ranges go to tasks, so a full bucket is spread over several. `columns` are
    kept for conditions. How many buckets a query probes and how many rows it scores exactly is what MEASURED rows of the table need to
    find the share `recall` of their k best; if no number of scored rows below MOST * k does, it is MOST * k, and the model says what
    was found. Vectors that are null, of zeros, not finite or of another length than the smallest id's are kept apart: they
    have no score.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *columns)
    first = rows.where(usable(F.col("vector"))).orderBy("id").select(F.size("vector")).first()
    dims = first[0] if first else parts
    parts = next(p for p in range(min(parts, dims), 0, -1) if dims % p == 0)
    good = usable(F.col("vector")) & (F.size("vector") == dims)
    trained = [r[0] for r in rows.where(good).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()]
    n = rows.where(good).count()
    centroids, books = train(units(trained, dims), lists or max(1, round(n**0.5)), parts) if trained else (np.zeros((0, dims)), np.zeros((parts, 0, dims // parts)))
    shared = spark.sparkContext.broadcast((centroids, books))

    def coded(batches):
        c, b = shared.value
        step = max(1, CELLS // max(len(c), ENTRIES))
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            x = units(batch.column(1).to_pylist(), dims)
            own = nearest(x, c)
            codes = np.stack([nearest(part, book) for part, book in zip(np.split(x - c[own], parts, axis=1), b)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([r.tobytes() for r in codes], pa.binary()), *batch.columns], ["bucket", "code", *batch.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.where(good).mapInArrow(coded, f"bucket int, code binary, {kinds}") if trained else rows.where("false").select(F.lit(0).alias("bucket"), F.lit(b"").alias("code"), "*")
    apart = rows.where(~good).select(F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("code"), "*")
    dealt.unionByName(apart).repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")
    sizes = np.zeros(len(centroids), np.int64)
    for bucket, c in spark.read.parquet(f"{path}/rows").where("bucket >= 0").groupBy("bucket").count().collect():
        sizes[bucket] = c
    model = _measured(spark, path, Model(centroids, books, sizes, len(centroids), MOST * k, 1.0), k, recall)
    about = (dims, parts, *(x.astype(np.float64).tobytes() for x in (centroids, books)), sizes.tobytes(), model.probes, model.scored, model.recall)
    spark.createDataFrame([about], "dims int, parts int, centroids binary, books binary, sizes binary, probes int, scored int, recall double").write.mode("overwrite").parquet(f"{path}/model")
    return model


def load(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(f"{path}/model").first()
    books = np.frombuffer(r.books).reshape(r.parts, -1, r.dims // r.parts)
    return Model(np.frombuffer(r.centroids).reshape(-1, r.dims), books, np.frombuffer(r.sizes, np.int64), r.probes, r.scored, r.recall)


def _measured(spark: SparkSession, path: str, model: Model, k: int, recall: float) -> Model:
    """The model with the fewest probes and exact scores that find the share `recall` of the k best of some of the index's own rows."""
    stored = spark.read.parquet(f"{path}/rows")
    asked = stored.where("bucket >= 0").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(MEASURED).select(F.col("id").alias("query_id"), "vector")
    with scratch():
        asked = saved(asked, "asked")
        true = saved(top_k_each(stored, asked, k, "vector").where("score IS NOT NULL").select("query_id", "id"), "true")
        wanted = true.count()
        found, probes = 1.0, 1
        while wanted:
            ranked = _candidates(spark, path, model, asked, probes, MOST * k).join(true, ["query_id", "id"]).select("place").collect()
            places = np.sort([r[0] for r in ranked])
            found = len(places) / wanted
            if found >= recall or probes >= len(model.centroids):
                model.scored = next((m for m in (k * 2**i for i in range(MOST.bit_length())) if np.searchsorted(places, m, "right") >= recall * wanted), MOST * k)
                found = float(np.searchsorted(places, model.scored, "right") / wanted)
                break
            probes = min(2 * probes, len(model.centroids))
    model.probes, model.recall = probes, found
    return model


def best_coded(batches: Iterator[pa.RecordBatch], model: Model, queries: np.ndarray, asks: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """q, bucket, id, near: of all rows (bucket, id, code) of a task the `most` best for each query that asks for their bucket.

    Scores are made CELLS at a time; of them only those stay that reach the query's bar, the least of its `most` best so far.
    """
    bar = np.full(len(queries), -np.inf)
    held: list[tuple] = []
    size = 0

    def trimmed() -> tuple:
        q, bucket, near = (np.concatenate([h[c] for h in held]) for c in (0, 1, 2))
        order = np.lexsort((-near, q))
        q = q[order]
        starts = np.searchsorted(q, np.arange(len(queries) + 1))
        place = np.arange(len(q)) - starts[q]
        last = place == most - 1
        bar[q[last]] = near[order[last]]
        kept = order[place < most]
        return q[place < most], bucket[kept], near[kept], pa.concat_arrays([h[3] for h in held]).take(pa.array(kept))

    step = max(1, CELLS // max(1, len(queries)))
    for b in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
        bucket, codes = b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        for own in np.unique(bucket).tolist():
            at, q = np.flatnonzero(bucket == own), np.flatnonzero(asks[:, own])
            s = queries[q] @ model.rebuilt(own, codes[at]).T
            i, k = np.nonzero(s >= bar[q, None])
            held.append((q[i].astype(np.int32), np.full(len(i), own, np.int32), s[i, k], b.column(1).take(pa.array(at[k]))))
            size += len(i)
        if size > CELLS:
            held = [trimmed()]
            size = -len(held[0][0])  # as many again and CELLS more, before they are gone through anew
    if held:
        q, bucket, near, ids = trimmed()
        for start in range(0, len(q), CELLS):
            end = start + CELLS
            yield pa.RecordBatch.from_arrays([pa.array(q[start:end]), pa.array(bucket[start:end]), ids[start:end], pa.array(near[start:end])], ["q", "bucket", "id", "near"])


def _candidates(spark: SparkSession, path: str, model: Model, queries: DataFrame, probes: int, most: int, **conditions) -> DataFrame:
    """query_id, bucket, id, place, coded: the `most` best rows of each query by the codes of the buckets that it probes, and how many rows those have."""
    kind = queries.schema["query_id"].dataType.simpleString()
    stored = where_equal(spark.read.parquet(f"{path}/rows"), **conditions).select("bucket", "id", "code")
    id_kind, found = stored.schema["id"].dataType.simpleString(), None
    for names, block in blocks_of_queries(queries, "query_id", "vector", model.centroids.shape[1]):
        probed = model.probed(block, probes)
        buckets = np.flatnonzero(probed.any(0)).tolist()
        coded = spark.createDataFrame([(i, int(c)) for i, c in zip(range(len(names)), probed @ model.sizes)], "q int, coded long")
        shared = spark.sparkContext.broadcast((model, block, probed))

        def run(batches, shared=shared):
            return best_coded(batches, *shared.value, most)

        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))
        near = stored.where(F.col("bucket").isin(buckets)).mapInArrow(run, f"q int, bucket int, id {id_kind}, near double").withColumn("place", place).where(F.col("place") <= most)
        told = spark.createDataFrame(list(enumerate(names)), f"q int, query_id {kind}").join(coded, "q")
        part = near.join(F.broadcast(told), "q").select("query_id", "bucket", "id", "place", "coded")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"query_id {kind}, bucket int, id {id_kind}, place int, coded long")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, query_col: str = "query_id", vector_col: str = "embedding", probes: int | None = None, scored: int | None = None, model: Model | None = None, **conditions) -> DataFrame:
    """query_id, id, score, rank, coded, scored: the k best rows of the index for every row of queries (query_id, a vector), ties of nine digits by id.

    A query reads the codes of its `probes` nearest buckets (coded: how many rows they have) and scores the `scored` best of
    them exactly (scored: how many these were); the model's measured numbers are the default. With as many probes as buckets and as many
    scored rows as there are it is exact. Queries that find fewer than k rows, as their buckets or the conditions
    (columns kept by the index) leave too few or as their own vector has no direction, are scored against all rows. Queries go to the tasks in blocks
    of bounded size; candidates are broadcast where they are few.
    """
    model = model or load(spark, path)
    stored = where_equal(spark.read.parquet(f"{path}/rows"), **conditions)
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(vector_col).alias("vector"))
    dims = model.centroids.shape[1]
    most = scored or model.scored
    with scratch() as keep:
        usable_ones = saved(asked.where(usable(F.col("vector")) & (F.size("vector") == dims)), "asked")
        cands = saved(_candidates(spark, path, model, usable_ones, probes or model.probes, most, **conditions), "candidates")
        few = cands.count() <= BROADCAST_ROWS
        own = (F.broadcast(cands) if few else cands).join(stored.select("bucket", "id", "vector"), ["bucket", "id"])
        pairs = own.join(usable_ones.withColumnRenamed("vector", "asked"), "query_id").select("query_id", "id", "coded", "vector", "asked")
        kind = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

        def run(batches):
            for b in (whole.slice(start, 1024) for whole in batches for start in range(0, whole.num_rows, 1024)):
                x, y = (units(b.column(c).to_pylist(), dims) for c in (3, 4))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((x * y).sum(1))], ["query_id", "id", "coded", "score"])

        exact = pairs.mapInArrow(run, f"query_id {kind['query_id']}, id {kind['id']}, coded long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
        best = exact.withColumn("rank", F.row_number().over(order)).withColumn("scored", F.count("*").over(Window.partitionBy("query_id"))).where(F.col("rank") <= k)
        keep(best := saved(best.select("query_id", "id", "score", "rank", "coded", "scored"), "best"))
        enough = best.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        keep(rest := saved(asked.join(enough, "query_id", "left_anti"), "rest"))
    if rest.isEmpty():
        return best
    everything = stored.count()
    exact = top_k_each(stored, rest, k, "vector").select("query_id", "id", "score", "rank", F.lit(0).cast("long").alias("coded"), F.lit(everything).cast("long").alias("scored"))
    return best.join(rest.select("query_id"), "query_id", "left_anti").unionByName(exact)
