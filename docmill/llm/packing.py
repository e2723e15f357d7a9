"""Packing: length patterns that fill a window, with repeat counts from non-negative least squares."""

from __future__ import annotations

import functools
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm import bpe
from docmill.llm.common import saved, scratch, sliced

WINDOW, QUANTUM, DEPTH, END_ID = 4096, 64, 4, 2


def patterns(window: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill `window` with at most `depth` lengths, each in ascending order; the window itself is not among them."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        low = head[-1] if head else 1
        if head and left >= low:
            out.append((*head, left))
        if len(head) < depth - 1:
            for x in range(low, left // 2 + 1):
                grow((*head, x), left - x)

    for x in range(1, window // 2 + 1):
        grow((x,), window - x)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by an active set: the steepest column enters, columns that would turn negative leave."""
    n, x, on = a.shape[1], np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-10 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[on] = -np.inf
        if n == 0 or slope.max() <= slack:
            break
        on[int(slope.argmax())] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            bad = on & (s <= 0)
            if not bad.any():
                break
            gap = x[bad] - s[bad]
            x += (x[bad] / np.where(gap > 0, gap, 1)).min() * (s - x)
            on &= x > slack
            x[~on] = 0
        x = s
    return x


def solve(hist: dict[int, int], window: int = WINDOW // QUANTUM, depth: int = DEPTH) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(pattern, repeats) that use up the histogram of lengths in quanta, and what no pattern took.

    Repeat counts come from least squares over all patterns, rounded down to what is there; then the largest
    remainders are matched greedily with any pattern that still fits.
    """
    left = Counter({k: v for k, v in hist.items() if v > 0})
    every = patterns(window, depth)
    a = np.zeros((window - 1, len(every)))
    for j, p in enumerate(every):
        for x in p:
            a[x - 1, j] += 1
    total = max(1, sum(left.values()))
    x = nnls(a, np.array([left[i + 1] / total for i in range(window - 1)]))
    out: Counter = Counter()
    for j in np.argsort(-x, kind="stable"):
        if x[j] <= 0:
            break
        need = Counter(every[j])
        if (k := min(int(x[j] * total + 1e-6), *(left[b] // m for b, m in need.items()))) > 0:
            out[every[j]] += k
            left.subtract({b: m * k for b, m in need.items()})
    for p in sorted(every, key=lambda p: (-p[-1], p)):
        need = Counter(p)
        if (k := min(left[b] // m for b, m in need.items())) > 0:
            out[p] += k
            left.subtract({b: m * k for b, m in need.items()})
    return list(out.items()), {k: v for k, v in left.items() if v > 0}


class Plan:
    """Where the r-th piece of each length goes. Its size depends on the window and the patterns alone, not on the corpus."""

    def __init__(self, hist: dict[int, int], tail_tokens: int, window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH):
        self.window, self.quantum = window, quantum
        units = window // quantum
        self.base_full = 0
        found, left = solve({k: v for k, v in hist.items() if k < units}, units, depth)
        base, taken = hist.get(units, 0), Counter()
        self.runs: dict[int, list] = {}
        for p, repeats in found:
            slots: dict[int, list[int]] = {}
            at = 0
            for x in p:
                slots.setdefault(x, []).append(at * quantum)
                at += x
            for x, offsets in slots.items():
                self.runs.setdefault(x, []).append((taken[x], taken[x] + repeats * len(offsets), offsets, base))
                taken[x] += repeats * len(offsets)
            base += repeats
        self.taken, self.stream_base, at = dict(taken), {}, 0
        for x in sorted(left):
            self.stream_base[x] = at
            at += left[x] * x * quantum
        self.tail_base, self.first_stream, total = at, base, at + tail_tokens
        #: The residual stream is cut at each window; what is left at its end goes to sequences of powers of two.
        self.full_stream, rest = total // window, total % window
        self.ends = [(self.full_stream * window, None)]
        for k in reversed(range(rest.bit_length())):
            if rest >> k & 1:
                self.ends.append((self.ends[-1][0] + (1 << k), 1 << k))

    def body(self, units: int, rank: int) -> tuple[int, int] | int:
        """(sequence, offset) of the rank-th piece of that length, or its place in the residual stream."""
        for low, high, offsets, base in self.runs.get(units, ()):
            if low <= rank < high:
                k, slot = divmod(rank - low, len(offsets))
                return base + k, offsets[slot]
        return self.stream_base[units] + (rank - self.taken.get(units, 0)) * units * self.quantum

    def cuts(self, at: int, length: int):
        """(sequence, offset, length) of the parts of a run of the residual stream."""
        while length > 0:
            if at < self.ends[0][0]:
                s, o = divmod(at, self.window)
                room = self.window - o
            else:
                s = next(i for i, (end, _) in enumerate(self.ends) if at < end)
                o, room = at - self.ends[s - 1][0], self.ends[s][0] - at
                s += self.full_stream - 1
            take = min(room, length)
            yield self.first_stream + s, o, take
            at, length = at + take, length - take


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    own = bpe.load(path)
    return own, Tokenizer.from_file(path).model, {}


def _ids_of(path: str, text: str | None) -> bytes:
    """Little-endian 32-bit ids of a text; the library encodes each distinct piece, which a worker keeps while it has room."""
    own, model, words = _library(path)
    text, out = text or "", []
    for k, part in enumerate(own.cut.split(text) if own.cut and "<" in text else (text,)):
        if k % 2:
            out.append(struct.pack("<I", own.special[part]))
            continue
        for w in own.pieces(part):
            if (ids := words.get(w)) is None:
                found = [t.id for t in model.tokenize(own.symbols(w))]
                ids = struct.pack(f"<{len(found)}I", *found)
                if len(w) <= bpe.CACHE_CHARS:
                    if len(words) >= bpe.CACHE_WORDS:
                        words.clear()
                    words[w] = ids
            out.append(ids)
    return b"".join(out)


def token_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, quantum: int = QUANTUM, end_id: int = END_ID) -> DataFrame:
    """id, n, ids, part and how many full windows, bodies of the same length and tail tokens came before in the part."""

    def run(batches):
        part, full, tails, bodies = TaskContext.get().partitionId(), 0, 0, Counter()
        for b in sliced(batches):
            cols: tuple[list, ...] = ([], [], [], [], [])
            for text in b.column(1).to_pylist():
                ids = _ids_of(path, text) + struct.pack("<I", end_id)
                n = len(ids) // 4
                units, tail = divmod(n % window, quantum)
                for c, v in zip(cols, (n, ids, full, bodies[units], tails)):
                    c.append(v)
                full, tails = full + n // window, tails + tail
                bodies[units] += 1
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds), pa.array([part] * b.num_rows, pa.int64())], ["id", "n", "ids", "full", "rank", "tails", "part"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, ids binary, full long, rank long, tails long, part long")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, quantum: int = QUANTUM, depth: int = DEPTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, packed into sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as bytes).

    A document's ids are the library's, then `end_id`; a null or empty text has that one id. Rows that repeat are packed
    each, those with a null id as well; an empty table has no pieces; other columns are ignored. Each id lies in exactly one piece; pieces lie gapless in their sequence. All
    sequences have `window` ids, but for a few at the end whose lengths are powers of two, so nothing is padded.

    A document gives full windows, a body of whole quanta and a tail of fewer ids than a quantum. The bodies' length
    histogram (window / quantum counts) goes to the driver, where least squares over shallow patterns says how often each
    is used; what no pattern takes and the tails make one residual stream, cut at each window. A piece's place follows
    from its rank among pieces of its length: ranks are counted within each task's part as it encodes, and parts are
    lined up by running sums over one row a part and length. Ids never move but for that last join by part, which
    is broadcast while the list of parts is small.
    """
    units = window // quantum
    with scratch() as keep:
        tokens = saved(token_table(df, path, id_col, text_col, window, quantum, end_id), "tokens")
        body = F.expr(f"CAST((n % {window}) DIV {quantum} AS INT)")
        kinds = tokens.select("part", F.explode(F.array(
            F.struct(body.alias("kind"), F.lit(1).cast("long").alias("v")),
            F.struct(F.lit(units).alias("kind"), F.expr(f"n DIV {window}").alias("v")),
            F.struct(F.lit(-1).alias("kind"), F.expr(f"n % {quantum}").alias("v")),
        )).alias("x")).groupBy("part", "x.kind").agg(F.sum("x.v").alias("v"))
        kinds = saved(kinds, "token-kinds")
        hist = {r["kind"]: r["v"] for r in kinds.groupBy("kind").agg(F.sum("v").alias("v")).collect()}
        plan = Plan({k: v for k, v in hist.items() if k > 0}, hist.get(-1, 0), window, quantum, depth)
        ahead = F.sum("v").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = kinds.select("part", "kind", F.coalesce(ahead, F.lit(0)).alias("ahead"))
        starts = saved(starts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("kind", "ahead"))).alias("ahead")).withColumnRenamed("part", "own_part"), "token-parts")
        keep(tokens, starts)
    rows = tokens.join(starts, tokens["part"] == starts["own_part"]).select(
        "id", "n", "ids", (F.col("full") + F.col("ahead")[units]).alias("full"), (F.col("rank") + F.col("ahead")[body]).alias("rank"), (F.col("tails") + F.col("ahead")[-1]).alias("tails")
    )

    def place(batches):
        for b in batches:
            owner, out = [], ([], [], [], [], [], [])
            pieces = []
            for i, (n, ids, full, rank, tails) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 6)))):
                at, spots = 0, []
                for k in range(n // window):
                    spots.append((full + k, 0, window))
                own, tail = divmod(n % window, quantum)
                if own:
                    spot = plan.body(own, rank)
                    spots += [(*spot, own * quantum)] if isinstance(spot, tuple) else plan.cuts(spot, own * quantum)
                spots += plan.cuts(plan.tail_base + tails, tail)
                for s, o, size in spots:
                    part = ids[4 * at : 4 * (at + size)]
                    owner.append(i)
                    for c, v in zip(out, (at, size, zlib.crc32(part), n, s, o)):
                        c.append(v)
                    pieces.append(part)
                    at += size
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = [b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in out)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pieces, pa.binary())] if with_ids else cols, [*names, "ids"] if with_ids else names)

    schema = f"id {tokens.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(place, schema).withColumnRenamed("id", id_col)
