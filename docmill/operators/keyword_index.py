"""A stored keyword index: postings in blocks with their greatest part of a score, so that blocks which can't reach the best are not opened."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.keyword import LISTED_TERMS, _asked, _best, _tokens, blocks_of_terms, query_terms, quoted
from docmill.session import saved, scratch

#: Postings in a block, and documents of a query's rarest terms whose scores set the bar for all others (as many times k).
BLOCK, SEEDS = 128, 20
#: Documents whose postings of a token go to the tasks as one list.
TOGETHER = 4096
#: Pairs of candidates and queries that may be broadcast; for more the forward table is shuffled.
BROADCAST_PAIRS = 500_000
#: A bound may be this much below what it bounds, as sums of the same numbers differ in their last bits.
SLACK = 1e-9


def part(tf, dl, mean: float, k1: float, b: float):
    """What a term adds to a document's score, for each unit of its weight."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def weight(df: int, n: int) -> float:
    idf = float(np.log((n - df + 0.5) / (df + 0.5)))
    return idf if idf > 0 else 1e-6


def _counted(tokens: DataFrame, kind: str) -> DataFrame:
    """doc_id, dl, words, tfs, places: the different tokens of each document with their counts and places; a place is that of the token among all, with a gap between columns."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part_ = b.slice(start, 256)
                lists = part_.column(2).flatten()
                per_list = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                words = lists.flatten().dictionary_encode()
                n_columns = len(lists) // part_.num_rows
                row = np.repeat(np.repeat(np.arange(part_.num_rows), n_columns), per_list)
                column = np.repeat(np.tile(np.arange(n_columns), part_.num_rows), per_list)
                first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part_.num_rows))])[row]
                place = np.arange(len(row)) - first + column
                code = words.indices.to_numpy()
                order = np.lexsort((place, code, row))
                code, row, place = code[order], row[order], place[order]
                starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
                edges = np.array([*starts, len(code)], np.int32)
                own = pa.array(np.searchsorted(row[starts], np.arange(part_.num_rows + 1)), pa.int32())
                each = [words.dictionary.take(pa.array(code[starts])), pa.array(np.diff(edges), pa.int32()), pa.ListArray.from_arrays(pa.array(edges), pa.array(place, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part_.column(0), part_.column(1), *(pa.ListArray.from_arrays(own, x) for x in each)], ["doc_id", "dl", "words", "tfs", "places"])

    return tokens.select("doc_id", "dl", "t").mapInArrow(run, f"doc_id {kind}, dl long, words array<string>, tfs array<int>, places array<array<int>>")


def _posted(counted: DataFrame, kind: str, buckets: int) -> DataFrame:
    """bucket, token, docs, dls, tfs, places: the postings of a token in up to TOGETHER documents, BLOCK in a row at most; places are those of all its documents in one list."""

    def run(batches):
        for b in (whole.slice(start, TOGETHER) for whole in batches for start in range(0, whole.num_rows, TOGETHER)):
            words = b.column(2).flatten().dictionary_encode()
            if not len(words):
                continue
            code = words.indices.to_numpy()
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
            order = np.argsort(code, kind="stable")
            starts = _starts(code[order])
            ends, docs, at = pa.array([*starts, len(code)], pa.int32()), pa.array(row[order]), pa.array(order)
            tfs, places = b.column(3).flatten().take(at), b.column(4).flatten().take(at)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (b.column(0).take(docs), b.column(1).take(docs).cast(pa.int32()), tfs)]
            of_row = np.concatenate([[0], np.cumsum(tfs.to_numpy())])[ends.to_numpy()]
            token = words.dictionary.take(pa.array(code[order][starts]))
            yield pa.RecordBatch.from_arrays([token, *lists, pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), places.flatten())], ["token", "docs", "dls", "tfs", "places"])

    rows = counted.mapInArrow(run, f"token string, docs array<{kind}>, dls array<int>, tfs array<int>, places array<int>")
    return rows.select(_bucket(F.col("token"), buckets).alias("bucket"), "*")


def _starts(tokens: np.ndarray) -> np.ndarray:
    """Where blocks start: at each new token of a sorted list, and BLOCK postings on."""
    edges = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [len(tokens)]])
    size = np.diff(edges)
    per = -(-size // BLOCK)
    return np.repeat(edges[:-1], per) + BLOCK * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


def _blocks(posted: DataFrame, kind: str, mean: float, k1: float, b: float) -> DataFrame:
    """Blocks of rows that come sorted by (bucket, token): BLOCK postings of one token, their documents, lengths, counts and places, and the greatest part of a score among them."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            per = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            docs, dls, tfs, flat = (batch.column(c).flatten() for c in (2, 3, 4, 5))
            places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tfs.to_numpy())]), pa.int32()), flat)
            starts = _starts(np.repeat(batch.column(1).dictionary_encode().indices.to_numpy(), per))
            ends = pa.array([*starts, len(docs)], pa.int32())
            best = np.maximum.reduceat(part(tfs.to_numpy().astype(float), dls.to_numpy(), mean, k1, b), starts)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (docs, dls.cast(pa.int64()), tfs, places)]
            row = pa.array(np.repeat(np.arange(batch.num_rows), per)[starts])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(np.diff([*starts, len(docs)]), pa.int32()), pa.array(best), *lists], ["bucket", "token", "n", "best", "docs", "dls", "tfs", "places"])

    return posted.mapInArrow(run, f"bucket int, token string, n int, best double, docs array<{kind}>, dls array<long>, tfs array<int>, places array<array<int>>")


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", columns: tuple[str, ...] = ("text",), buckets: int = 64, k1: float = 1.2, b: float = 0.75) -> None:
    """Write a keyword index of the documents to the folder `path`.

    postings: blocks of BLOCK postings, sorted by token in buckets. terms: for each token its number of documents and the
    greatest part of a score in any of its blocks. forward: the tokens (as hashes) and counts of each document. about: the number and mean length
    of the documents, and the formula's constants. Ids are not null and stand in one row each.

    The tokens of a document are counted where it is read, which gives its forward row. Postings go to the tasks as lists of a token's documents, one for
    TOGETHER documents or fewer, by ranges of (bucket, token, first document): the postings of a frequent token are spread over many tasks, and
    blocks end where a task's batch does. A clash of two tokens' hashes is an error.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    with scratch():
        counted = saved(_counted(_tokens(docs, id_col, list(columns)), kind), "counted", compression="zstd")
        n, mean = counted.agg(F.count("*"), F.avg("dl")).first()
        order = ["bucket", "token", F.col("docs")[0]]
        dealt = _posted(counted, kind, buckets).repartitionByRange(*order).sortWithinPartitions(*order)
        _blocks(dealt, kind, float(mean or 1), k1, b).write.mode("overwrite").option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(f"{path}/postings")
        terms = spark.read.parquet(f"{path}/postings").groupBy("bucket", "token").agg(F.sum("n").alias("df"), F.max("best").alias("best"), F.count("*").alias("blocks"))
        terms.withColumn("hash", F.xxhash64("token")).repartitionByRange("bucket", "token").sortWithinPartitions("bucket", "token").write.mode("overwrite").parquet(f"{path}/terms")
        pairs = F.array_sort(F.zip_with("words", "tfs", lambda w, tf: F.struct(F.xxhash64(w).alias("hash"), tf.alias("tf"))))
        forward = counted.where(F.size("words") > 0).select("doc_id", "dl", pairs.alias("x"))
        forward.select("doc_id", "dl", F.col("x.hash").alias("hashes"), F.col("x.tf").alias("tfs")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/forward")
        spark.createDataFrame([(n, float(mean or 1), buckets, k1, b)], "n long, mean double, buckets int, k1 double, b double").write.mode("overwrite").parquet(f"{path}/about")
    stored = spark.read.parquet(f"{path}/terms")
    if not stored.groupBy("hash").count().where("count > 1").isEmpty():
        raise ValueError("two tokens of the documents have one hash")


def _at_tokens(table: DataFrame, asked: list[str] | None, buckets: int) -> DataFrame:
    """The rows of the asked tokens: only their buckets and row groups are read. All rows where too many are asked for."""
    if asked is None:
        return table
    own = sorted({zlib.crc32(w.encode()) % buckets for w in asked})
    return table.where(F.expr(f"bucket IN ({', '.join(map(str, own))}) AND token IN ({quoted(asked)})") if asked else F.lit(False))


def _phrases(spark: SparkSession, path: str, terms: DataFrame, kind: str, about) -> DataFrame:
    """term, doc_id, part: for each phrase of several tokens the documents that hold it, and what it adds to their score with its weight."""
    words = terms.where("n > 1").select("term", "n").distinct().select("term", "n", F.posexplode(F.split("term", " ")).alias("i", "token"))
    stored = _at_tokens(spark.read.parquet(f"{path}/postings"), _asked(words, "token"), about.buckets)
    rows = stored.select("token", F.explode(F.arrays_zip("docs", "dls", "places")).alias("x")).select("token", F.col("x.docs").alias("doc_id"), F.col("x.dls").alias("dl"), F.explode("x.places").alias("place"))
    starts = rows.join(words, "token").groupBy("term", "n", "doc_id", "dl", (F.col("place") - F.col("i")).alias("start")).agg(F.count("*").alias("m")).where("m = n")
    tf = saved(starts.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf")), "phrases")
    idf = F.log((F.lit(float(about.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", F.when(idf > 0, idf).otherwise(1e-6).alias("weight"))
    return tf.join(df, "term").select("term", "doc_id", (F.col("weight") * part(F.col("tf"), F.col("dl"), about.mean, about.k1, about.b)).alias("part"))


class _Plan:
    """Which terms of a block of queries to open first, and which are left to be opened, by their bounds."""

    def __init__(self, block: dict, stats: dict, n: int, extra: np.ndarray):
        self.names, self.stats = list(block), stats
        self.own = [sorted(t for t in terms if t in stats) for terms in block.values()]
        self.weight = {t: weight(s.df, n) for t, s in stats.items()}
        self.bound = {t: self.weight[t] * s.best for t, s in stats.items()}
        #: What all single terms of a query, and its phrases, may add up to.
        self.most = np.array([sum(self.bound[t] for t in own) for own in self.own]) + extra

    def seeds(self, docs: int) -> dict[str, list[tuple[int, float]]]:
        """The rarest terms of each query, until they have `docs` documents: token to (query, least block bound)."""
        out: dict[str, list] = {}
        for q, own in enumerate(self.own):
            left = docs
            for t in sorted(own, key=lambda t: (self.stats[t].df, t)):
                if left <= 0:
                    break
                out.setdefault(t, []).append((q, -1.0))
                left -= self.stats[t].df
        return out

    def open(self, bar: np.ndarray) -> dict[str, list[tuple[int, float]]]:
        """Terms that some document above the bar may need: those left out can't reach it together. Their blocks must reach the bar with all that others may add."""
        out: dict[str, list] = {}
        for q, own in enumerate(self.own):
            left = self.most[q]
            for t in sorted(own, key=lambda t: (-self.bound[t], t)):
                if left < bar[q] - SLACK:
                    break
                out.setdefault(t, []).append((q, bar[q] - (self.most[q] - self.bound[t]) - SLACK))
                left -= self.bound[t]
        return out


def _opened(postings: DataFrame, wanted: dict[str, list[tuple[int, float]]], weights: dict[str, float], buckets: int, about, kind: str) -> DataFrame:
    """q, doc_id, opened: documents in the blocks that the queries of a term open (those whose bound is what they need), and with a null document how many these are."""
    spark = postings.sparkSession
    shared = spark.sparkContext.broadcast((wanted, weights))
    rows = _at_tokens(postings, list(wanted) if len(wanted) <= LISTED_TERMS else None, buckets).select("token", "best", "docs", "dls", "tfs")

    def run(batches):
        asks, w = shared.value
        for b in batches:
            opened: dict[int, int] = {}
            qs, at = [], []
            tokens, best = b.column(0).to_pylist(), b.column(1).to_numpy()
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))])
            docs, dls, tfs = (b.column(c).flatten() for c in (2, 3, 4))
            parts = part(tfs.to_numpy().astype(float), dls.to_numpy(), about.mean, about.k1, about.b)
            for i, t in enumerate(tokens):
                own = parts[edges[i] : edges[i + 1]]
                for q, least in asks.get(t, ()):
                    if w[t] * best[i] >= least:
                        opened[q] = opened.get(q, 0) + 1
                        found = edges[i] + np.flatnonzero(w[t] * own >= least)
                        at.append(found)
                        qs.append(np.full(len(found), q))
            q = np.concatenate([*qs, list(opened)]).astype(np.int32) if qs else np.zeros(0, np.int32)
            where = pa.array(np.concatenate([*at, np.zeros(len(opened))]).astype(np.int64), mask=np.concatenate([np.zeros(len(q) - len(opened), bool), np.ones(len(opened), bool)])) if len(q) else pa.array([], pa.int64())
            n = np.concatenate([np.zeros(len(q) - len(opened)), list(opened.values())]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q), docs.take(where), pa.array(n)], ["q", "doc_id", "opened"])

    found = rows.mapInArrow(run, f"q int, doc_id {kind}, opened long")
    return found.groupBy("q", "doc_id").agg(F.sum("opened").alias("opened"))


def _narrowed(forward: DataFrame, asked: np.ndarray, kind: str) -> DataFrame:
    """The forward table with the asked hashes (sorted) alone, so that a shuffle doesn't carry all tokens of all documents."""
    shared = forward.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for b in batches:
            h, tfs = (b.column(c).flatten() for c in (2, 3))
            hit = np.isin(h.to_numpy(), shared.value)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))[hit]
            ends, mask = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32()), pa.array(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.ListArray.from_arrays(ends, x.filter(mask)) for x in (h, tfs))], ["doc_id", "dl", "hashes", "tfs"])

    return forward.select("doc_id", "dl", "hashes", "tfs").mapInArrow(run, f"doc_id {kind}, dl long, hashes array<long>, tfs array<int>")


def _exact(spark: SparkSession, path: str, cands: DataFrame, plan: _Plan, about, kind: str) -> DataFrame:
    """q, doc_id, score of candidates (q, doc_id), by all single terms of their queries: documents come with what is stored of them, each once."""
    own = [(np.array([plan.stats[t].hash for t in terms], np.int64), np.array([plan.weight[t] for t in terms])) for terms in plan.own]
    shared = spark.sparkContext.broadcast(own)
    asked = saved(cands.groupBy("doc_id").agg(F.collect_list("q").alias("qs")), "asked")
    forward = spark.read.parquet(f"{path}/forward")
    few = (asked.agg(F.sum(F.size("qs"))).first()[0] or 0) <= BROADCAST_PAIRS
    joined = forward.join(F.broadcast(asked), "doc_id") if few else _narrowed(forward, np.unique(np.concatenate([h for h, _ in own])), kind).join(asked, "doc_id")
    rows = joined.select("doc_id", "qs", "dl", "hashes", "tfs")

    def run(batches):
        for b in batches:
            ids, score, at = [], [], []
            for i, (qs, dl, hashes, tfs) in enumerate(zip(b.column(1), b.column(2).to_pylist(), b.column(3), b.column(4))):
                h = hashes.values.to_numpy()
                p = part(tfs.values.to_numpy().astype(float), dl, about.mean, about.k1, about.b)
                for q in qs.values.to_numpy().tolist():
                    terms, w = shared.value[q]
                    where = np.minimum(np.searchsorted(h, terms), max(len(h) - 1, 0))
                    hit = h[where] == terms if len(h) else np.zeros(len(terms), bool)
                    ids.append(q)
                    at.append(i)
                    score.append(float((p[where[hit]] * w[hit]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), b.column(0).take(pa.array(at, pa.int64())), pa.array(score, pa.float64())], ["q", "doc_id", "score"])

    return rows.mapInArrow(run, f"q int, doc_id {kind}, score double")


def _search_block(spark: SparkSession, path: str, block: dict, phrases: DataFrame | None, k: int, about, kind: str) -> tuple[DataFrame, list]:
    """q, doc_id, score of documents among which the k best of each query of a block are, and (q, query id, blocks opened, blocks of its terms)."""
    postings = spark.read.parquet(f"{path}/postings")
    words = sorted({t for own in block.values() for t in own if " " not in t})
    wanted_words = set(words)
    stats = {r.token: r for r in _at_tokens(spark.read.parquet(f"{path}/terms"), words if len(words) <= LISTED_TERMS else None, about.buckets).toLocalIterator() if r.token in wanted_words}
    extra, held = np.zeros(len(block)), None
    if phrases is not None:
        wanted = spark.createDataFrame([(q, t) for q, own in enumerate(block.values()) for t in own if " " in t], "q int, term string")
        held = saved(phrases.join(F.broadcast(wanted), "term").groupBy("q", "doc_id").agg(F.sum("part").alias("extra")), "phrase-parts")
        for q, m in held.groupBy("q").agg(F.max("extra")).collect():
            extra[q] = m
    plan = _Plan(block, stats, about.n, extra)

    def scored(cands: DataFrame) -> DataFrame:
        out = _exact(spark, path, cands, plan, about, kind)
        if held is not None:
            out = out.join(held, ["q", "doc_id"], "left").select("q", "doc_id", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
        return saved(out, "scored")

    first = saved(_opened(postings, plan.seeds(SEEDS * k), plan.weight, about.buckets, about, kind), "seeds")
    known = scored((first if held is None else first.unionByName(held.select("q", "doc_id", F.lit(0).cast("long").alias("opened")))).where("doc_id IS NOT NULL").select("q", "doc_id").distinct())
    bar = np.zeros(len(block))
    for q, least in _best(known.withColumnRenamed("q", "query_id"), k).where(F.col("rank") == k).select("query_id", "score").collect():
        bar[q] = least
    later = saved(_opened(postings, plan.open(bar), plan.weight, about.buckets, about, kind), "opened")
    rest = scored(later.where("doc_id IS NOT NULL").join(known.select("q", "doc_id"), ["q", "doc_id"], "left_anti").select("q", "doc_id"))
    opened = dict(first.unionByName(later).where("doc_id IS NULL").groupBy("q").agg(F.sum("opened")).collect())
    told = [(q, name, opened.get(q, 0), sum(stats[t].blocks for t in plan.own[q])) for q, name in enumerate(block)]
    return known.unionByName(rest), told


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, report: bool = False) -> DataFrame:
    """keyword.bm25() from an index: query_id, doc_id, score, rank; with `report` also opened and blocks, how many blocks of its terms a query opened (the first ones and those that followed) and how many there are.

    The rarest terms of a query give some documents, whose exact scores set a bar: the k-th of them. Terms which together can't reach it are not
    opened, nor are blocks whose greatest part can't with all that the other terms may add; nor do single postings count that can't. What is left is
    scored exactly from the forward table, so the result is that of reading everything. Queries go in blocks of bounded size; the driver holds the
    terms of one block.
    """
    about = spark.read.parquet(f"{path}/about").first()
    kind = spark.read.parquet(f"{path}/forward").schema["doc_id"].dataType.simpleString()
    query_kind = queries.schema["query_id"].dataType.simpleString()
    out = None
    with scratch() as keep:
        terms = saved(query_terms(queries), "terms")
        phrases = saved(_phrases(spark, path, terms, kind, about), "phrase-docs") if not terms.where("n > 1").isEmpty() else None
        for block in blocks_of_terms(terms):
            found, told = _search_block(spark, path, block, phrases, k, about, kind)
            names = spark.createDataFrame(told, f"q int, query_id {query_kind}, opened long, blocks long")
            best = _best(found.join(F.broadcast(names), "q").drop("q"), k)
            keep(best := saved(best, "hits"))
            out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], f"query_id {query_kind}, doc_id {kind}, score double, opened long, blocks long, rank int")
    cols = ["query_id", "doc_id", "score", "rank"]
    return out.select(*cols, *(["opened", "blocks"] if report else []))
