"""Substring dedup: passages of enough words that repeat across the corpus go, but for their first place."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import discard, saved, scratch, sliced, unused
from docmill.llm.jaccard import PIECE, _mix, _word_hashes

#: Parts and words that a span has at least. A part is a word, so the greater of them counts.
RUN, RUN_WORDS = 3, 20
#: Words of an anchor: each span has one, the same wherever it stands.
ANCHOR = 8
#: Rows with a null id get keys from here on, above any id.
NO_ID = 1 << 62
#: Scripts without blanks between words: there each character counts as a word.
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1980-\u19df\u1a20-\u1aaf\u3001-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff"
_HAS_DENSE, _WORD = re.compile(f"[{_DENSE}]"), re.compile(rf"[{_DENSE}]|[^\s{_DENSE}]+")
_FACTORS = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))]


def words(text: str) -> list[str]:
    """The lower-cased words: what stands between white space; characters of scripts without blanks are words of their own."""
    if text.isascii() or not _HAS_DENSE.search(text):
        return text.lower().split()
    return [w.lower() for w in _WORD.findall(text)]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, [lower-cased word]) of the parts that make up the text: its words, each with the white space behind it.

    Cuts at every word are the only ones that part any passage alike, whatever stands around it. White space in front belongs to the first word.
    """
    starts = [m.start() for m in _WORD.finditer(text)]
    return [(a, z, [w]) for a, z, w in zip([0, *starts[1:]], [*starts[1:], len(text)], words(text))]


def _joined(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of every n neighbours in h, from those of 1, 2, 4, ... neighbours; one of two."""
    out, size, done = None, 1, 0
    left, right = _FACTORS[which]
    while True:
        if n & size:
            out = h if out is None else _mix(out[: len(h[done:])] * left + h[done : done + len(out)] * right)
            done += size
        if 2 * size > n:
            return out
        h, size = _mix(h[:-size] * left + h[size:] * right), 2 * size


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours in h."""
    size = 1
    while 2 * size <= n:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return np.minimum(h[: len(h) - (n - size)], h[n - size :])


def runs(texts: list[str], n: int):
    """For each text its number of words, both 64-bit hashes of all its spans of n words and the anchor of each span.

    An anchor is the least hash of a few neighbouring words within the span, so equal spans have equal anchors; neighbours mostly share theirs.
    """
    short = min(ANCHOR, n)
    piece: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        piece.append("\n".join(words(t)).encode("utf-8", "surrogatepass"))
        size += len(piece[-1])
        if size < PIECE and k < len(texts) - 1:
            continue
        h, counts = _word_hashes(piece)
        if len(h) >= n:
            spans, twins, anchors = _joined(h, n).view(np.int64), _joined(h, n, 1).view(np.int64), _least(_joined(h, short), n - short + 1).view(np.int64)
        else:
            spans = twins = anchors = np.zeros(0, np.int64)
        at = 0
        for c in counts.tolist():
            m = max(0, c - n + 1)
            yield c, spans[at : at + m], twins[at : at + m], anchors[at : at + m]
            at += c
        piece, size = [], 0


def _lists(own: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in own])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*own, np.zeros(0, np.int64)])))


def _repeated(lists: DataFrame, cols: list[str]) -> DataFrame:
    """key, first and the values of rows that several documents hold; first is the smallest of their keys."""
    several = lists.groupBy(*cols).agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select(*cols, "first")
    return lists.join(saved(several, "several"), cols)


def _later_spans(docs: DataFrame, n: int) -> DataFrame:
    """__gone_key, __gone: for each document of docs (key, text) that has any, the hashes of its spans that stand first elsewhere."""

    def emit_anchors(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([np.unique(x) for *_, x in runs(b.column(1).to_pylist(), n)])], ["key", "own"])

    def emit_spans(batches):
        for b in sliced(batches):
            one, two = [], []
            for (_, s, t, x), shared in zip(runs(b.column(1).to_pylist(), n), b.column(2).to_pylist()):
                own = np.isin(x, shared)
                at = np.unique(s[own], return_index=True)[1]
                one.append(s[own][at])
                two.append(t[own][at])
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(one), _lists(two)], ["key", "own", "twin"])

    with scratch() as keep:
        anchors = saved(docs.mapInArrow(emit_anchors, "key long, own array<long>"), "anchors")
        again = _repeated(anchors.select("key", F.explode("own").alias("value")), ["value"])
        shared = saved(again.groupBy(F.col("key").alias("shared_key")).agg(F.collect_set("value").alias("shared")), "shared-anchors")
        discard(anchors)
        some = docs.join(shared, F.col("key") == F.col("shared_key")).select("key", "text", "shared")
        spans = saved(some.mapInArrow(emit_spans, "key long, own array<long>, twin array<long>"), "spans")
        discard(shared)
        places = spans.select("key", F.explode(F.arrays_zip("own", "twin")).alias("x")).select("key", F.col("x.own").alias("value"), F.col("x.twin").alias("twin"))
        later = saved(_repeated(places, ["value", "twin"]).where("key > first").select("key", "value"), "later")
        discard(spans)  # before the next shuffle, so that what a document and a span take doesn't stand on disk together
        keep(gone := saved(later.groupBy(F.col("key").alias("__gone_key")).agg(F.collect_set("value").alias("__gone")), "gone-spans"))
    return gone


def _without(text: str, n_words: int, spans: np.ndarray, later: list[int] | None, n: int) -> tuple[str, int]:
    """The text without the words of spans in `later` and of spans that stand earlier in the text, and how many words went."""
    again = np.ones(len(spans), bool)
    again[np.unique(spans, return_index=True)[1]] = False
    if later:
        again |= np.isin(spans, later)
    found = np.flatnonzero(again)
    if not len(found):
        return text, 0
    step = np.bincount(found, minlength=n_words + 1) - np.bincount(found + n, minlength=n_words + 1)
    gone = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
    edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
    starts = [0, *[m.start() for m in _WORD.finditer(text)][1:], len(text)]
    kept = [text[starts[a] : starts[z]] for a, z in zip([0, *edges[1::2]], [*edges[::2], n_words])]
    return "".join(kept), int(gone.sum())


def _cut_spans(df: DataFrame, id_col: str, text_col: str, run: int, run_words: int) -> DataFrame:
    """df with its texts cut, and the columns __n_sentences and __n_removed."""
    n = max(run, run_words, 1)
    key = unused(df, "__key")
    keyed = df.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.monotonically_increasing_id()))
    if not df.where(F.col(id_col).isNull()).isEmpty():  # keys that were given out hold only where they are written
        keyed = saved(keyed, "keyed")
    gone = _later_spans(keyed.select(F.col(key).alias("key"), F.coalesce(text_col, F.lit("")).alias("text")), n)
    both = keyed.join(gone, keyed[key] == gone["__gone_key"], "left").select(*(keyed[c] for c in df.columns), gone["__gone"].alias(unused(df, "__gone")))
    added = [unused(df, "__n_sentences"), unused(df, "__n_removed")]
    names, at = [*df.columns, *added], df.columns.index(text_col)

    def cut(batches):
        for b in sliced(batches):
            own = [t or "" for t in b.column(at).to_pylist()]
            counts, texts, removed = [], [], []
            for text, later, (n_words, spans, *_) in zip(own, b.column(b.num_columns - 1).to_pylist(), runs(own, n)):
                left, k = _without(text, n_words, spans, later, n)
                counts.append(n_words)
                texts.append(left)
                removed.append(k)
            cols = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names)

    return both.mapInArrow(cut, T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in added)]))


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per input row: id, n_sentences, n_removed (both count parts, that is words), text (without the repeated words).

    A span is any run of words, at least `run` and `run_words` of them, compared without regard to case and white space. The
    first place of a span is in the row with the smallest id, there the earliest; words that any other place of a repeated
    span covers are removed, from its first word to its last. In a text that goes on repeating a few words within a span's length its places overlap, and
    the words remain once. Rows that share an id are one document and don't repeat one another; each row with a null id is
    a document of its own, after all others. Ids are integers below 2**62. A null text is empty; an empty table gives no rows. Nothing else in
    a text changes.

    First the anchors of every document's spans (about one for seven words) are grouped, with a partial step in each task; a
    span that repeats has an anchor that repeats. Only spans with such anchors are hashed one by one (to 128 bits), grouped for their
    smallest and largest id and joined back by equality, which Spark may split where a span is hot. Each document gets the
    list of its own hashes that stand first elsewhere; it is no longer than the document.
    """
    return _cut_spans(df.select(id_col, text_col), id_col, text_col, run, run_words).select(id_col, F.col("__n_sentences").alias("n_sentences"), F.col("__n_removed").alias("n_removed"), text_col)


def drop_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, run_words: int = RUN_WORDS) -> DataFrame:
    """df with all its rows and columns, its texts cut as by dedup_spans()."""
    return _cut_spans(df, id_col, text_col, run, run_words).select(*df.columns)
