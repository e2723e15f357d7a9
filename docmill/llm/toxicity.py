"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all overlapping windows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import sliced

#: Words in a window and between the starts of two windows; sizes of embeddings and of the recurrent state.
WINDOW, STRIDE, DIM, HIDDEN = 32, 16, 16, 12
WORD_ROWS, GRAM_ROWS, GRAMS = 1 << 14, 1 << 15, (3, 4, 5)
#: The bounded sample to learn from: rows of either class at most, and characters of a row at most.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1000, 2000, 100_000
#: Words whose inputs a worker keeps, words taken up at a time, windows scored at a time.
KEPT_WORDS, TAKEN_WORDS, BATCH = 150_000, 60_000, 2048
_SPACES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Longer words are cut into pieces of so many characters, a new one after every half.
LONG = 24
#: Scripts without blanks between words, and what besides them shows that bytes alone don't tell a text's words.
_DENSE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1980-\u19df\u1a20-\u1aaf\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9df\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_ODD, _WORD = re.compile(f"[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u1680\u2000-\u2bff\u2e00-\u2e7f\u3000-\u3040\ufe10-\ufe6f\uff00-\uff0f\uff1a-\uff20{_DENSE}]"), re.compile(rf"[{_DENSE}]+|[^\W_{_DENSE}]+")


_HAS_DENSE = re.compile(f"[{_DENSE}]")


def _pieces(word: str, size: int) -> list[bytes]:
    """A word of more than `size` characters as overlapping pieces that take its place."""
    return [word[k : k + size].encode("utf-8", "surrogatepass") for k in range(0, max(1, len(word) - size // 2), max(1, size // 2))]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words. White space and punctuation part them; in scripts without blanks each two characters are a word, and longer words than LONG are cut."""
    text = (text or "").lower()
    if text.isascii() or not _ODD.search(text):
        out = text.encode("utf-8", "surrogatepass").translate(_SPACES).split()
        if max(map(len, out), default=0) <= LONG:
            return out
        return [p for w in out for p in ([w] if len(w) <= LONG else _pieces(w.decode("utf-8", "surrogatepass"), LONG))]
    return [p for w in _WORD.findall(text) for p in (_pieces(w, 2) if _HAS_DENSE.match(w) else [w.encode()] if len(w) <= LONG else _pieces(w, LONG))]


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row of each word, the rows of its character n-grams (with both ends marked), their owners and the factor of each word's sum."""
    rows = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) % np.uint64(WORD_ROWS)
    text = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    found, owners = [], []
    for n in GRAMS:
        if len(text) >= n:
            h = np.zeros(len(text) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(1099511628211) + text[k : len(text) - n + 1 + k] + np.uint64(n)
            own = owner[: len(h)] == owner[n - 1 :]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append(((h >> np.uint64(33)) % np.uint64(GRAM_ROWS))[own].astype(np.int64))
            owners.append(owner[: len(h)][own])
    grams, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(owners, minlength=len(words))))
    return rows.astype(np.int64), grams[order], owners[order], scale.astype(np.float32)


def starts_of(n: int) -> list[int]:
    """Where the windows over n words start: every STRIDE words, the last so that it ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    p = {"word": draw(WORD_ROWS, DIM, scale=0.1), "gram": draw(GRAM_ROWS, DIM, scale=0.1)}
    for d in "fb":
        p |= {f"w{d}": draw(DIM, 3 * HIDDEN, scale=0.3), f"u{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"a": draw(2 * HIDDEN, HIDDEN, scale=0.3), "a0": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, scale=0.3), "o": draw(2 * HIDDEN, scale=0.3), "o0": np.zeros(1, np.float32)}


def embed(p: dict, words: list[bytes]) -> tuple[np.ndarray, tuple]:
    rows, grams, owners, scale = inputs = grams_of(words)
    counts = np.bincount(owners, minlength=len(words))  # each word has a gram, and its sum is made of its own grams alone
    own = np.add.reduceat(p["gram"][grams], np.cumsum(counts) - counts, axis=0)
    return p["word"][rows] + own * scale[:, None], inputs


def _gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States by (time, row, unit) of a gated recurrent layer; x: what the input adds to the update, reset and candidate gates."""
    steps, rows, _ = x.shape
    n, h, out = HIDDEN, np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32)
    full = bool(mask.all())
    for t in reversed(range(steps)) if back else range(steps):
        g = h @ u
        zr = _sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
        c = np.tanh(x[t, :, 2 * n :] + zr[:, n:] * g[:, 2 * n :])
        new = h + zr[:, :n] * (c - h)
        if not full:
            new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((t, h, zr, c, g[:, 2 * n :]))
        h = out[t] = new
    return out


def forward(p: dict, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window; attention pools the states of both directions."""
    f, b = ([], []) if keep is not None else (None, None)
    hs = np.concatenate([_gru(xf, p["uf"], mask, False, f), _gru(xb, p["ub"], mask, True, b)], 2)
    s = np.tanh(hs @ p["a"] + p["a0"])
    e = np.where(mask, s @ p["v"], np.float32(-1e9))
    w = np.exp(e - e.max(0))
    w *= mask
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", w, hs)
    if keep is not None:
        keep |= {"f": f, "b": b, "hs": hs, "s": s, "w": w, "pooled": pooled}
    return pooled @ p["o"] + p["o0"][0]


def _gru_grads(keep: list, dh: np.ndarray, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, dx, du, carry = HIDDEN, np.zeros((*dh.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros(dh.shape[1:], np.float32)
    for t, h, zr, c, gc in reversed(keep):
        total = carry + dh[t]
        live = mask[t][:, None]
        d = total * live
        z, r = zr[:, :n], zr[:, n:]
        dc = d * z * (1 - c * c)
        dz = d * (c - h) * z * (1 - z)
        dr = dc * gc * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], 1)
        dg = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ dg
        carry = total * ~live + d * (1 - z) + dg @ u.T
    return dx, du


def grads(p: dict, words: list[bytes], at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean log loss and its gradients. at: (time, row) indexes into words."""
    x, (rows, grams, owners, scale) = embed(p, words)
    xs, keep = x[at], {}
    logit = forward(p, xs @ p["wf"] + p["cf"], xs @ p["wb"] + p["cb"], mask, keep)
    prob = _sigmoid(logit)
    loss = float(-np.mean(np.log(np.where(y == 1, prob, 1 - prob) + 1e-7)))
    g = {"o0": None}
    dl = ((prob - y) / len(y)).astype(np.float32)
    g["o"], g["o0"] = keep["pooled"].T @ dl, np.array([dl.sum()], np.float32)
    dp = dl[:, None] * p["o"]
    hs, s, w = keep["hs"], keep["s"], keep["w"]
    dw = np.einsum("tbh,bh->tb", hs, dp)
    de = w * (dw - (w * dw).sum(0))
    ds = de[:, :, None] * p["v"] * (1 - s * s)
    g["v"], g["a0"], g["a"] = np.einsum("tb,tbh->h", de, s), ds.sum((0, 1)), np.einsum("tbi,tbj->ij", hs, ds)
    dhs = w[:, :, None] * dp + ds @ p["a"].T
    dxs = np.zeros_like(xs)
    for d, own in (("f", dhs[:, :, :HIDDEN]), ("b", dhs[:, :, HIDDEN:])):
        dx, g[f"u{d}"] = _gru_grads(keep[d], own, p[f"u{d}"], mask)
        g[f"w{d}"], g[f"c{d}"] = np.einsum("tbi,tbj->ij", xs, dx), dx.sum((0, 1))
        dxs += dx @ p[f"w{d}"].T
    dwords = np.zeros_like(x)
    np.add.at(dwords, at.ravel(), dxs.reshape(-1, DIM))
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], rows, dwords)
    np.add.at(g["gram"], grams, (dwords * scale[:, None])[owners])
    return loss, g


class Adam:
    def __init__(self, p: dict, rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, 5.0 / max(norm, 1e-9))
        for k, x in g.items():
            x = x * shrink
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= (self.rate / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


class Scorer:
    """Scores documents with trained parameters; keeps the inputs of words it has met."""

    def __init__(self, p: dict):
        self.p, self.known, self.table = p, {}, np.zeros((KEPT_WORDS, 6 * HIDDEN), np.float32)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        if len(new) > len(self.table):
            self.table = np.zeros((len(new), 6 * HIDDEN), np.float32)
        for k in range(0, len(new), 20_000):
            own = new[k : k + 20_000]
            x, _ = embed(self.p, own)
            at = len(known)
            self.table[at : at + len(own)] = np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], 1)
            known.update(zip(own, range(at, at + len(own))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def windows(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """The logits of every window of each document."""
        if not docs:
            return []
        rows = self._rows([w for d in docs for w in d] or [b" "])
        firsts, lengths, counts, at = [], [], [], 0
        for d in docs:
            own = starts_of(len(d))
            counts.append(len(own))
            firsts += [at + s for s in own]
            lengths += [min(WINDOW, len(d))] * len(own)
            at += len(d)
        firsts, lengths = np.array(firsts), np.array(lengths)
        out = np.empty(len(firsts), np.float32)
        for short in (True, False):
            chosen = np.flatnonzero((lengths < WINDOW) == short)
            for k in range(0, len(chosen), BATCH):
                own = chosen[k : k + BATCH]
                steps = np.arange(max(1, lengths[own].max()))[:, None]
                mask = steps < lengths[own]
                x = self.table[rows[np.minimum(firsts[own] + steps, len(rows) - 1)]]
                out[own] = forward(self.p, x[:, :, : 3 * HIDDEN], x[:, :, 3 * HIDDEN :], mask)
        return np.split(out, np.cumsum(counts)[:-1])

    def scores(self, texts: list[str | None]) -> list[float]:
        """The greatest probability of a window of each text, to six places (matrix products of a batch may round the last one apart); a text without words has one window of nothing."""
        out: list[float] = []
        taken, size = [], 0
        for k, t in enumerate(texts):
            taken.append(words_of(t))
            size += len(taken[-1])
            if size >= TAKEN_WORDS or k == len(texts) - 1:
                out += [round(float(_sigmoid(np.float64(x.max()))), 6) for x in self.windows(taken)]
                taken, size = [], 0
        return out


def _told_by_odds(docs: list[list[bytes]], y: np.ndarray) -> list[int]:
    """For each document its word with the greatest log odds of toxic documents, by words and character n-grams of the sample."""
    counts = np.zeros((2, WORD_ROWS + GRAM_ROWS))
    for d, label in zip(docs, y.tolist()):
        rows, grams, _, _ = grams_of(d)
        counts[label, np.unique(np.concatenate([rows, grams + WORD_ROWS]))] += 1
    odds = np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - y).sum() + 1))
    odds[counts.sum(0) < 3] = 0
    best = []
    for d in docs:  # made again, as all n-grams of a sample at once would fill the memory
        rows, grams, owners, _ = grams_of(d)
        score = odds[rows] + np.bincount(owners, odds[grams + WORD_ROWS], len(rows)) / np.maximum(1, np.bincount(owners, minlength=len(rows)))
        best.append(int(score.argmax()))
    return best


def train(texts: list[str | None], labels: list[int], rounds: int = 3, epochs: int = 3, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters learnt from whole labelled texts.

    A label holds for the text, not for each window: first the window around each text's most telling word is learnt,
    then in each round the windows that the network itself scores highest, of toxic texts the one, of clean texts two. The same texts in the same order give the same parameters.
    """
    rng, p, y = np.random.default_rng(seed), initial(seed), np.array(labels, np.int64)
    same: dict[bytes, bytes] = {}
    docs = [[same.setdefault(w, w) for w in words_of(t)] or [b" "] for t in texts]
    if not docs or y.min() == y.max():
        return p | {"o": p["o"] * 0, "o0": np.array([-3.0 if not docs or y[0] == 0 else 3.0], np.float32)}
    adam = Adam(p)
    chosen = []
    for i, at in enumerate(_told_by_odds(docs, y)):
        last = max(0, len(docs[i]) - WINDOW)
        chosen.append((i, min(last, max(0, at - int(rng.integers(4, WINDOW - 4))))))
        if y[i] == 0:
            chosen.append((i, int(rng.integers(0, last + 1))))
    for r in range(rounds):
        size = 64
        for _ in range(epochs + 2 * (r == 0)):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), size):
                own = [chosen[j] for j in order[k : k + size]]
                cut = [docs[i][s : s + WINDOW] for i, s in own]
                vocabulary = list(dict.fromkeys(w for c in cut for w in c))
                index = {w: n for n, w in enumerate(vocabulary)}
                at, mask = np.zeros((WINDOW, len(cut)), np.int64), np.zeros((WINDOW, len(cut)), bool)
                for b, c in enumerate(cut):
                    at[: len(c), b] = [index[w] for w in c]
                    mask[: len(c), b] = True
                adam.step(grads(p, vocabulary, at, mask, y[[i for i, _ in own]])[1])
        if r < rounds - 1:
            scorer, chosen = Scorer(p), []
            for k in range(0, len(docs), 200):
                for i, logits in enumerate(scorer.windows(docs[k : k + 200]), k):
                    starts = starts_of(len(docs[i]))
                    top = np.argsort(-logits)[: 1 if y[i] else 2].tolist()
                    chosen += [(i, starts[t]) for t in top]
    return p


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> tuple[list, list]:
    """Texts and labels of the sample: rows whose crc32(id as text) mod 5 is not 0, of either class those with the smallest hashes."""
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("own")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    told = told.where(~held_out(F.col("own")))
    cut = lambda y, n: told.where(F.col("y") == y).orderBy(F.xxhash64("own"), "own").limit(n)
    some = cut(1, toxic_rows).unionByName(cut(0, clean_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("own")).where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
    least = rows.select("id", "y", "text").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(toxic_rows + clean_rows)
    found = sorted((r["id"], r["y"], r["text"] or "") for r in least.collect())
    return [t for *_, t in found], [y for _, y, _ in found]


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def score(df: DataFrame, params: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted (1 if score >= 0.5).

    The score is the greatest over all overlapping windows of the whole text; a null, empty or wordless text is one
    empty window. Equal texts get equal scores, but for a unit in the sixth place. held_out: crc32(id as text) mod 5 is 0; a null id counts as "". No
    shuffle: each task scores the rows it reads, so an empty table gives no rows and other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(params)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()), pa.float64())], ["id", "score"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> dict[str, np.ndarray]:
    """Parameters learnt from the labelled sample alone; without labels of both classes every text gets one constant score."""
    return train(*labelled_sample(docs, labels, id_col, text_col, **bounds))


def drop_toxic(df: DataFrame, params: dict[str, np.ndarray], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """df without the rows whose text scores `threshold` or more; all columns stay."""
    shared, at = df.sparkSession.sparkContext.broadcast(params), df.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in sliced(batches):
            yield b.filter(pa.array([s < threshold for s in scorer.scores(b.column(at).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)
