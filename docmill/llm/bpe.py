"""BPE encoding by dynamic programming over prefixes, with decoding."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept with their ids in a Python worker, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 500_000, 64, 2_000_000
#: Characters whose properties agree in all Unicode versions at hand; texts with others are cut up by the library itself.
SETTLED = re.compile("[\x00-\x1b\x20-\u0557\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3]*")
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character for each byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary file: NFC, white space, lower case, word pieces, byte symbols, merges with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {v: k for k, v in self.vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = r
            self.halves.setdefault(whole, (left, right, r))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {v: k for k, v in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pieces = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.wide = regex.compile(pieces)
        self.narrow = re.compile(r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\x0b\x0c\ra-z0-9]+")
        table = byte_symbols()
        self.to_symbols = {b: table[b] for b in range(256)}
        self.to_byte = {c: b for b, c in enumerate(table)}
        self.path, self.library = path, None
        self.found = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if i in self.halves or len(token.removesuffix(END)) == 1:
                self.found.add_word(token.removesuffix(END) + "\0" * token.endswith(END), (i, len(token.removesuffix(END))))
        self.found.make_automaton()
        self.spines: dict[tuple[int, int], list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple] = {}

    def pieces(self, text: str) -> list[str]:
        """The word pieces of text without special tokens."""
        if text.isascii():
            return self.narrow.findall(text.lower())
        if SETTLED.fullmatch(text):
            return self.wide.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.to_byte[c] for c in piece).decode() for piece, _ in found]

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.to_symbols)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along one edge (0: left, 1: right) of token's merge tree, each with the rank of the merge that takes it."""
        if (own := self.spines.get((token, side))) is None:
            own, at, taken = [], token, float("inf")
            while True:
                own.append((at, taken))
                if at not in self.halves:
                    break
                taken = self.halves[at][2]
                at = self.halves[at][side]
            self.spines[token, side] = own
        return own

    def crossed(self, left: int, right: int, below: float) -> bool:
        """Whether some merge of rank under `below` joins the two tokens' edges before either edge is taken by its own token.

        Of equal ranks the leftmost pair goes first: the left token's own merge before the crossing one, that before the right's.
        """
        rank = self.rank
        for a, a_taken in self.spine(left, 1):
            for b, b_taken in self.spine(right, 0):
                r = rank.get((a, b))
                if r is not None and r < below and r < a_taken and r <= b_taken:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of left and right encodes as just these two."""
        if (ok := self.pairs.get((left, right))) is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            ok = self.pairs[left, right] = not self.crossed(left, right, float("inf"))
        return ok

    def whole(self, token: int) -> bool:
        """Whether the token's own text encodes as the token."""
        if token not in self.halves:
            return True
        if (ok := self.pairs.get((token, -1))) is None:
            left, right, r = self.halves[token]
            ok = self.pairs[token, -1] = self.whole(left) and self.whole(right) and not self.crossed(left, right, r)
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece. last[j] is the one token that ends the encoding of the first j symbols; back-pointers give the ids."""
        text = self.symbols(word)
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.found.iter(text + "\0"):
            j = min(end + 1, n)
            if (end == n - 1) or last[j] >= 0:  # the last symbol counts only with the word's end
                continue
            i = j - length
            if (i == 0 or (last[i] >= 0 and self.compatible(last[i], token))) and self.whole(token):
                last[j], size[j] = token, length
        out, j = [], n
        while j > 0:
            if last[j] < 0:
                raise ValueError(f"the vocabulary has no encoding of {word!r}")
            out.append(last[j])
            j -= size[j]
        return out[::-1]

    def known(self, word: str) -> tuple:
        """(number of ids, decimal ids, tokens, ids as bytes), each joined; kept for words that come again."""
        if (own := self.words.get(word)) is None:
            ids = self.encode_word(word)
            own = (len(ids), " ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids), struct.pack(f"<{len(ids)}I", *ids))
            if len(word) <= CACHE_CHARS:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = own
        return own

    def encoded(self, text: str | None) -> list[tuple]:
        """known() of each piece and special token of the text."""
        text, out, get, known = text or "", [], self.words.get, self.known
        for k, part in enumerate(self.cut.split(text) if self.cut and "<" in text else (text,)):
            if k % 2:
                i = self.special[part]
                out.append((1, str(i), self.tokens[i], struct.pack("<I", i)))
            elif part:
                out += [get(w) or known(w) for w in self.pieces(part)]
        return out


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int), decoded (the tokens joined by spaces). Null is the empty text: no ids, an empty string."""

    def run(batches):
        bpe = load(path)
        for b in batches:
            rows = [bpe.encoded(t) for t in b.column(1).to_pylist()]
            ids = [[int(i) for x in own for i in x[1].split(" ")] for own in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([" ".join([x[2] for x in own]) for own in rows], pa.string())], ["id", "ids", "decoded"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with n_tokens and SHA-256 digests made in the task in place of the ids (decimal, joined by a space) and the decoded text.

    One row per input row, repeated ones and those with a null id as well. A null text is empty: no tokens, and both digests
    are those of the empty string. An empty table gives no rows; other columns are ignored. No shuffle; each row is
    encoded whole, however long, by the task that reads it, in time linear in its length.
    """

    def run(batches):
        bpe, sha = load(path), hashlib.sha256
        for b in batches:
            n, one, two = [], [], []
            for t in b.column(1).to_pylist():
                own = bpe.encoded(t)
                n.append(sum([x[0] for x in own]))
                one.append(sha(" ".join([x[1] for x in own]).encode()).hexdigest())
                two.append(sha(" ".join([x[2] for x in own]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
