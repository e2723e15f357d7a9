"""Retrieval evaluation: precision by keywords, ratings, best and worst queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import or_empty

SHARE = 0.3


def relevant(results: DataFrame, text_col: str = "texto", keywords: str = "kw") -> DataFrame:
    """Adds relevant: whether SHARE of the row's keywords occur in its text, without regard to case."""
    text = F.lower(or_empty(F.col(text_col)))
    found = F.filter(keywords, lambda k: text.contains(F.lower(k)))
    return results.withColumn("relevant", F.coalesce(F.try_divide(F.size(found), F.size(keywords)) >= SHARE, F.lit(False)))


def precision(queries: DataFrame, results: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Percent of relevant results of each query, and their number; 0 for queries without results."""
    own = results.groupBy(id_col).agg(F.count("*").alias("n"), F.count_if("relevant").alias("r"))
    return queries.join(own, id_col, "left").select(id_col, F.coalesce(F.round(100.0 * F.col("r") / F.col("n"), 6), F.lit(0.0)).alias("precision"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rating(c: Column) -> Column:
    return F.when(c >= 80, "EXCELENTE").when(c >= 60, "BUENA").when(c >= 40, "ACEPTABLE").otherwise("MALA")


def rating_histogram(precisions: DataFrame) -> DataFrame:
    return precisions.groupBy(rating(F.col("precision")).alias("rating")).agg(F.count("*").alias("n"), F.round(F.avg("precision"), 6).alias("mean_precision"))


def top_bottom(precisions: DataFrame, k: int = 5, id_col: str = "query_id") -> DataFrame:
    """The k best and the k worst queries, ties by id."""
    end = lambda name, *order: precisions.orderBy(*order).limit(k).withColumn("list", F.lit(name))
    return end("top", F.desc("precision"), id_col).unionByName(end("bottom", "precision", F.desc(id_col)))
