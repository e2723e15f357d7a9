"""Exact dedup: rows meet by a 128-bit content hash, and the bytes decide inside a hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import ascii_lower, saved, scratch, small


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k (the 128-bit hash), sha, keep_id and group_size for each row."""
    texts = df.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm"))
    with scratch() as keep:
        keep(rows := saved(texts.select("id", content_hash(F.col("norm")).alias("k"), F.unhex(F.sha2("norm", 256)).alias("sha")), "hashes"))
        several = saved(rows.groupBy("k").count().where("count > 1").select(F.col("k").alias("several")), "repeated")
        same = texts.join(small(several), content_hash(F.col("norm")) == F.col("several")).groupBy("several", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        keep(groups := saved(same.where("group_size > 1").select(F.col("several").alias("k"), F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "exact"))
    alone = F.col("group_size").isNull()
    return rows.join(groups, ["k", "sha"], "left").select("id", "k", "sha", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after A-Z are lower-cased; null is the empty text. Of equal texts the
    row with the largest id stays. Null ids count as smaller than any other; where all ids of a group are null,
    keep_id is null and its rows stay. Rows that tie on the largest id are the same document and all stay. An empty
    table gives no rows; other columns are ignored.

    One scan hashes each text. Only texts whose hash repeats are read again and grouped by (hash, text), so Spark
    compares their bytes, with a partial step in every map task: a text that fills a third of the table reaches the
    shuffle once a task. What goes back to the rows is joined by both hashes, not by texts.
    """
    c = F.col
    out = _grouped(df, id_col, text_col)
    return out.select(c("id").alias(id_col), "keep_id", "group_size", c("id").eqNullSafe(c("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_groups() does not keep; all columns stay.

    A row goes by its id and its text, so other texts under the same id stay, as do rows with a null id. Rows that tie
    on a group's largest id all stay. An empty table gives no rows.
    """
    with scratch() as keep:
        gone = _grouped(df, id_col, text_col).where("id IS NOT NULL AND id <> keep_id").select(F.col("id").alias("__gone"), F.col("k").alias("__k"), F.col("sha").alias("__sha")).distinct()
        keep(gone := saved(gone, "exact-copies"))
    norm = ascii_lower(df[text_col])
    return df.join(small(gone), (df[id_col] == gone["__gone"]) & (content_hash(norm) == gone["__k"]) & (F.unhex(F.sha2(norm, 256)) == gone["__sha"]), "left_anti")
