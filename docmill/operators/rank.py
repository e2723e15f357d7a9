"""Stages of the ranking funnel. Each takes candidates in the order of input_rank and is meant for .transform().

Candidates are what searches have cut to a fetch size (500 at most), so a window over all of them is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import clean_markup, or_empty, present, strip, year_of
from docmill.operators.vector import with_ids

FTS_SCORE, THRESHOLD, MIN_RESULTS = 0.85, 0.1, 3


def fetch_size(top_k: int, most: int | None = 500) -> int:
    return min(3 * top_k, most) if most else 3 * top_k


def clamp_top_k(k: int) -> int:
    return max(10, min(k, 100))


def cap_of(top_k: int) -> int:
    return max(5, top_k // 3)


def rerank_pool_size(n: int, top_k: int) -> int:
    return min(n, max(2 * top_k, 100), 200)


def _dense(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("input_rank", F.row_number().over(Window.orderBy(*order)))


def lookup_hits(hits: DataFrame, chunks: DataFrame, most: int = 100, fix_chunk_ids: bool = False, score: float = FTS_SCORE) -> DataFrame:
    """Rows of the vector store for the first `most` distinct ids of keyword hits (id, rank), with a constant score.

    Hits are document ids, the store's are chunk ids: documents of several chunks are found only with fix_chunk_ids.
    The few ids are named in a condition, so that of chunks which come from a join no others go through it.
    """
    first = hits.groupBy("id").agg(F.min("rank").alias("input_rank")).orderBy("input_rank", "id").limit(most)
    rows = first.collect()
    first = hits.sparkSession.createDataFrame(rows, first.schema)
    key = F.regexp_replace("id", r"(?s)^(.+)_c\d+$", "$1") if fix_chunk_ids else F.col("id")
    own = with_ids(chunks, key, [r.id for r in rows]).withColumn("__key", key).join(F.broadcast(first.withColumnRenamed("id", "__hit")), F.col("__key") == F.col("__hit"))
    return own.drop("__key", "__hit").withColumn("score", F.lit(score))


def union_dedup(first: DataFrame, second: DataFrame, id_col: str = "id", names: tuple[str, str] = ("vector", "fts")) -> DataFrame:
    """Both lists, the first one's rows first; of one id the earliest row stays. Adds _source and a new input_rank."""
    both = first.withColumn("_source", F.lit(names[0])).withColumn("__list", F.lit(0)).unionByName(second.withColumn("_source", F.lit(names[1])).withColumn("__list", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(id_col).orderBy("__list", "input_rank")
    kept = both.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return _dense(kept, "__list", "input_rank").drop("__n", "__list")


def title_dedup(df: DataFrame, title_col: str = "caratula", key: Column | None = None) -> DataFrame:
    """Of rows whose titles begin alike (60 characters, without case and outer white space) the first stays; rows without a title all stay.

    Another `key` may say what is compared: rows whose key is empty all stay, and of those without one (null) the first.
    """
    named = df.withColumn("__key", F.lower(strip(F.substring(or_empty(F.col(title_col)), 1, 60))) if key is None else key)
    order = Window.partitionBy("__key").orderBy("input_rank")
    empty = F.col("__key").eqNullSafe("")
    first = named.where(~empty).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return first.unionByName(named.where(empty)).drop("__key")


def rerank_pool(df: DataFrame, top_k: int) -> DataFrame:
    """The first rows, as many as are reranked: rerank_pool_size(), whatever their number."""
    return df.orderBy("input_rank").limit(min(max(2 * top_k, 100), 200))


def rerank_passage() -> Column:
    """What a reranker reads of a ruling: its title, summary and text; N/D if there is nothing."""
    parts = F.concat_ws(" ", *(present(F.col(c)) for c in ("caratula", "sumario", "texto")))
    return F.coalesce(F.nullif(strip(parts), F.lit("")), F.lit("N/D"))


def rerank(df: DataFrame, score: Column, top_k: int | None = None) -> DataFrame:
    """Rows by a new rerank_score, greatest first, ties in their order; input_rank is renewed."""
    out = _dense(df.withColumn("rerank_score", score).withColumn("__old", F.col("input_rank")), F.desc("rerank_score"), "__old").drop("__old")
    return out.where(F.col("input_rank") <= top_k) if top_k else out


def threshold(df: DataFrame, least: float | None = THRESHOLD, min_results: int = MIN_RESULTS, score_col: str = "rerank_score") -> DataFrame:
    """Rows that score `least` or more, or none at all if fewer than `min_results` do. None lets every row pass."""
    if least is None:
        return df
    passing = df.where(F.col(score_col) >= least)
    enough = passing.agg(F.count("*").alias("__n")).where(F.col("__n") >= min_results)
    return passing.crossJoin(F.broadcast(enough)).drop("__n")


def boosted(df: DataFrame, as_of_year: int, date_col: str = "fecha", score_col: str = "rerank_score") -> DataFrame:
    """Adds final_score: up to 0.15 more the nearer the first year in the date is to as_of_year, nothing from 30 years on or for odd years."""
    year = year_of(F.col(date_col))
    boost = F.when((year > 1900) & (year <= as_of_year), F.greatest(F.lit(0.0), 0.15 * (1 - (as_of_year - year) / 30))).otherwise(0.0)
    return df.withColumn("final_score", F.col(score_col) + boost)


def recency(df: DataFrame, as_of_year: int, date_col: str = "fecha", score_col: str = "rerank_score") -> DataFrame:
    """boosted() in the order of final_score; input_rank is renewed."""
    return _dense(boosted(df, as_of_year, date_col, score_col).withColumn("__old", F.col("input_rank")), F.desc("final_score"), "__old").drop("__old")


def diversity(df: DataFrame, top_k: int, group_col: str = "tribunal") -> DataFrame:
    """top_k rows, of each group (by its stripped name) cap_of(top_k) at first; rows without a group are free, rows over the cap fill up."""
    group = strip(or_empty(F.col(group_col)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("input_rank"))
    over = F.when((group != "") & (place > cap_of(top_k)), 1).otherwise(0)
    return _dense(df.withColumn("__over", over).withColumn("__old", F.col("input_rank")), "__over", "__old").drop("__over", "__old").where(F.col("input_rank") <= top_k)


def rrf(lists: list[DataFrame], id_col: str = "id", c: int = 60) -> DataFrame:
    """id, rrf_score: the sum of 1 / (c + rank) over ranked lists (id, rank)."""
    parts = [x.select(id_col, (1 / (c + F.col("rank"))).alias("part")) for x in lists]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy(id_col).agg(F.sum("part").alias("rrf_score"))


def without_markup(df: DataFrame, columns: tuple[str, ...] = ("texto", "sumario", "caratula")) -> DataFrame:
    """df with clean texts in those of the columns that it has."""
    return df.withColumns({c: clean_markup(F.col(c)) for c in columns if c in df.columns})


def funnel(vector: DataFrame, keyword: DataFrame, score: Column, top_k: int, as_of_year: int, least: float | None = THRESHOLD) -> DataFrame:
    """The whole funnel over two lists of candidates; markup goes before titles are compared."""
    pool = union_dedup(vector, keyword).transform(without_markup).transform(title_dedup).transform(rerank_pool, top_k)
    return pool.transform(rerank, score).transform(threshold, least).transform(recency, as_of_year).transform(diversity, top_k)
