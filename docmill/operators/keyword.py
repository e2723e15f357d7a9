"""Keyword search: BM25 over all text columns with phrases, and the Okapi variant."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import or_empty, search_tokens
from docmill.session import saved

#: Query terms that are looked for inside the arrays of tokens, or named in a scan's filter; of more of them all tokens stay.
LISTED_TERMS = 5000
#: Queries that go to the tasks at a time, numbers in their matrix of weights, and in a matrix of scores.
QUERY_BLOCK, CELLS, MATRIX = 1024, 1 << 23, 1 << 22


def query_terms(queries: DataFrame, query_col: str = "q", id_col: str = "query_id") -> DataFrame:
    """query_id, term, n: each word of more than two characters as a phrase of its tokens (n of them), once."""
    raw = F.filter(F.split(or_empty(F.col(query_col)), r"\s+"), lambda w: F.length(w) > 2)
    phrases = queries.select(F.col(id_col).alias("query_id"), F.explode(raw).alias("w")).select("query_id", search_tokens(F.col("w")).alias("t")).where(F.size("t") > 0)
    return phrases.select("query_id", F.array_join("t", " ").alias("term"), F.size("t").alias("n")).distinct()


def _grams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    spots = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def _asked(terms: DataFrame, column: str = "term") -> list[str] | None:
    """The different terms, or None if there are more than LISTED_TERMS."""
    found = [r[0] for r in terms.select(column).distinct().limit(LISTED_TERMS + 1).collect()]
    return found if len(found) <= LISTED_TERMS else None


def quoted(words: list[str]) -> str:
    """The words as a list in SQL: one expression, where literals one by one would each be a call to the JVM."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def _only(df: DataFrame, column: str, asked: list[str] | None) -> DataFrame:
    """df with only the asked terms in a column of terms; all of them if there are too many to list."""
    return df if asked is None else df.withColumn(column, F.expr(f"filter({column}, w -> w IN ({quoted(asked)}))") if asked else F.expr(f"filter({column}, w -> false)"))


def _tokens(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """doc_id, the tokens t of each column, and their number dl."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.array(*(search_tokens(F.col(c)) for c in columns)).alias("t"))
    return out.withColumn("dl", F.size(F.flatten("t")).cast("long"))


def blocks_of_terms(terms: DataFrame) -> Iterator[dict]:
    """The terms of each query by its id, with a number for a term that it holds several times. A block has QUERY_BLOCK queries at most, and no more than CELLS pairs of its queries and its terms unless it is a single query."""
    block: dict = {}
    known: set[str] = set()
    for name, own in terms.groupBy("query_id", "term").agg(F.count("*").alias("c")).groupBy("query_id").agg(F.collect_list(F.struct("term", "c")).alias("own")).toLocalIterator():
        more = {r.term: r.c for r in own}
        if block and (len(block) == QUERY_BLOCK or (len(block) + 1) * len(known | more.keys()) > CELLS):
            yield block
            block, known = {}, set()
        block[name] = more
        known |= more.keys()
    if block:
        yield block


def _scored(seen: DataFrame, weights: DataFrame, terms: DataFrame, k: int, mean: float, k1: float, b: float) -> DataFrame:
    """query_id, doc_id, score, rank: the k best rows of seen (doc_id, dl, hits: its asked terms, as often as it has them) for each query.

    weights: term, weight. A batch of rows is a matrix of term parts, the queries of a block another one of weights; of their product each
    batch gives the k best rows a query. Rows without any term of a query are none of its hits.
    """
    spark, kind = seen.sparkSession, seen.schema["doc_id"].dataType.simpleString()
    query_kind = terms.schema["query_id"].dataType.simpleString()
    parts = []
    for block in blocks_of_terms(terms):
        place = {t: i for i, t in enumerate(dict.fromkeys(t for own in block.values() for t in own))}
        known = weights.where(F.expr(f"term IN ({quoted(list(place))})")) if len(place) <= LISTED_TERMS else weights.join(F.broadcast(spark.createDataFrame([(t,) for t in place], "term string")), "term")
        weight = dict(known.select("term", "weight").collect())
        if not weight:
            continue
        table = np.zeros((len(place), len(block)))
        for q, own in enumerate(block.values()):
            for t, c in own.items():
                table[place[t], q] = c * weight.get(t, 0.0)
        shared = spark.sparkContext.broadcast((place, table))

        def run(batches, shared=shared):
            place, table = shared.value
            vocabulary = pa.array(list(place), pa.string())
            ask = (table != 0).astype(np.float32)
            for whole in batches:
                step = max(1, MATRIX // max(table.shape))
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    at = pc.index_in(batch.column(2).flatten(), vocabulary)
                    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))[known]
                    tf = np.zeros((batch.num_rows, len(place)))
                    np.add.at(tf, (row, at.to_numpy(zero_copy_only=False)[known].astype(np.int64)), 1)
                    length = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]
                    score = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))) @ table
                    hit = ((tf > 0).astype(np.float32) @ ask) > 0
                    order = pc.sort_indices(batch.column(0)).to_numpy()
                    key = np.where(hit, np.rint(score * 1e9), -np.inf)[order]
                    best = np.argsort(-key, axis=0, kind="stable")[:k]
                    i, q = order[best].T.reshape(-1), np.repeat(np.arange(table.shape[1]), len(best))
                    there = hit[i, q]
                    yield pa.RecordBatch.from_arrays([pa.array(q[there], pa.int32()), batch.column(0).take(pa.array(i[there])), pa.array(score[i, q][there])], ["q", "doc_id", "score"])

        names = spark.createDataFrame(list(enumerate(block)), f"q int, query_id {query_kind}")
        found = seen.select("doc_id", "dl", "hits").mapInArrow(run, f"q int, doc_id {kind}, score double")
        parts.append(found.join(F.broadcast(names), "q").select("query_id", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"query_id {query_kind}, doc_id {kind}, score double, rank int")
    return _best(functools.reduce(DataFrame.unionByName, parts), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query, ties by id.

    A query is its words of more than two characters, or-ed; a phrase lies within one column. Term counts and lengths run
    over all columns; an inverse document frequency that isn't positive counts as 1e-6. Queries without such words and
    documents without any of them give no rows. Texts are split into tokens once; what stays of a document are its
    length and the terms that are asked for. To search the same documents often, use keyword_index.
    """
    terms = query_terms(queries)
    asked, lengths = _asked(terms), [r[0] for r in terms.select("n").distinct().collect()]  # a few small numbers
    grams = F.flatten("t") if lengths == [1] else F.flatten(F.transform("t", lambda t: F.flatten(F.array(*(_grams(t, n) for n in lengths or [1])))))
    seen = saved(_only(_tokens(docs, id_col, list(columns)).select("doc_id", "dl", grams.alias("hits")), "hits", asked), "keyword-hits")
    n, mean = seen.agg(F.count("*"), F.avg("dl")).first()
    df = seen.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("weight"))
    return _scored(seen, weights, terms.select("query_id", "term"), k, float(mean or 1), k1, b)


def okapi(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",), k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """As bm25(), by the Okapi formula over lower-case words between white space: a negative inverse document frequency counts as a quarter of the mean one.

    Two passes over the texts: one for the vocabulary, whose row without a term counts the documents and their words, and one for the terms that are asked for.
    """
    split = lambda *c: F.filter(F.split(F.lower(F.concat_ws(" ", *map(F.col, c))), r"(?U)\s+"), lambda w: w != "")
    words = docs.select(F.col(id_col).alias("doc_id"), split(*columns).alias("t")).withColumn("dl", F.size("t").cast("long"))
    each = words.select("dl", F.explode(F.array_append(F.array_distinct("t"), F.lit(None))).alias("term"))
    known = saved(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("words")), "vocabulary")
    n, total = known.where("term IS NULL").select(F.max("df"), F.max("words")).first()
    n, mean = n or 0, (total or 0) / (n or 1) or 1.0
    df = known.where("term IS NOT NULL").select("term", "df", F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    floor = df.agg(F.avg("idf")).first()[0] or 0.0
    terms = queries.select("query_id", F.explode(split("q")).alias("term"))
    seen = _only(words.select("doc_id", "dl", F.col("t").alias("hits")), "hits", _asked(terms))
    weights = df.select("term", F.when(F.col("idf") < 0, 0.25 * floor).otherwise(F.col("idf")).alias("weight"))
    return _scored(seen, weights, terms, k, float(mean), k1, b)


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query by the score to nine digits, ties by id: the last bits of a sum follow the order of its parts. Each task keeps k of its own before they meet."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
