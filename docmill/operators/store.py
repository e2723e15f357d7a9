"""Full-text store, index rows and incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import base_id, embedding_text, or_empty


def first_wins(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def fulltext_store(df: DataFrame, id_col: str = "id", text_col: str = "texto", order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Rows that have both an id and a text; of one id the row that comes first."""
    return first_wins(df.where((or_empty(F.col(id_col)) != "") & (or_empty(F.col(text_col)) != "")), id_col, *order)


def enrich(hits: DataFrame, store: DataFrame, id_col: str = "id", text_col: str = "texto") -> DataFrame:
    """hits with the stored text of their document, where that is longer than their own."""
    full = store.select(F.col(id_col).alias("__store_id"), F.col(text_col).alias("__full"))
    longer = F.length("__full") > F.length(or_empty(F.col(text_col)))
    return hits.join(full, base_id(hits[id_col]) == full["__store_id"], "left").withColumn(text_col, F.when(longer, F.col("__full")).otherwise(F.col(text_col))).drop("__store_id", "__full")


def index_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    """What a full-text index holds: doc_id, caratula, the whole text and summary (their first `most` characters, if it is given), tribunal, materia."""
    body = F.concat(or_empty(F.col("texto")), F.lit(" "), or_empty(F.col("sumario")))
    body = body if most is None else F.substring(body, 1, most)
    return df.where(or_empty(F.col("id")) != "").select(F.col("id").alias("doc_id"), or_empty(F.col("caratula")).alias("caratula"), body.alias("texto"), or_empty(F.col("tribunal")).alias("tribunal"), or_empty(F.col("materia")).alias("materia"))


def payload(df: DataFrame) -> DataFrame:
    """What a vector store holds of a document: the text to embed (8000 characters), the text (5000), the metadata."""
    keep = ["source", "source_id", "tribunal", "fecha", "caratula", "materia", "jurisdiccion", "provincia", "tipo_documento", "actor", "demandado", "sobre", "chunk_index", "total_chunks"]
    embed = embedding_text(*(F.col(c) for c in ("caratula", "materia", "voces", "tribunal", "sobre", "sumario", "texto")))
    return df.select("id", F.substring(embed, 1, 8000).alias("embed_text"), F.substring("texto", 1, 5000).alias("document"), F.substring(or_empty(F.col("sumario")), 1, 2000).alias("sumario"), F.array_join(F.slice("voces", 1, 10), ", ").alias("voces"), *keep)


def unseen(df: DataFrame, seen: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id isn't in `seen`."""
    return df.join(seen.select(F.col(id_col).alias("__seen")).distinct(), df[id_col] == F.col("__seen"), "left_anti")


def collect_merge(existing: DataFrame, new: DataFrame, id_col: str = "source_id", order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """existing and the first row of each id that it doesn't have yet."""
    return existing.unionByName(first_wins(unseen(new, existing, id_col), id_col, *order), allowMissingColumns=True)


def merge_pages(pages: DataFrame) -> DataFrame:
    """Rows of several result pages (page, position), one for each uuid, or expediente where that is empty; rows without either all stay."""
    key = F.coalesce(F.nullif(F.col("uuid"), F.lit("")), F.nullif(F.col("expediente"), F.lit("")), F.concat_ws("/", F.lit("\0"), "page", "position"))
    return first_wins(pages.withColumn("__key", key), "__key", "page", "position").drop("__key")


def tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows in the given order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)
