"""Line dedup, exact dedup, BPE, packing, SimHash, sharding and URL filters against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docmill.llm import bpe, exact_dedup, line_dedup, packing, sharding, simhash, url_filter
from tests.llm.conftest import ROWS

VOCAB = public_tokenizers.path("word_bpe_49k.json")
WS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact_groups(docs, empty):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[lower(t)].append(i)
    want = Counter()
    for i, t in ROWS:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[i, keep, len(own), i == keep, sha(lower(t))] += 1
    assert rows_of(exact_dedup.exact_groups(docs)) == want
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {2, 5, 4, *range(6, 14), None}


def test_exact_copies_go_by_id_and_text(spark):
    df = spark.createDataFrame([(5, "x"), (5, "y"), (9, "X"), (9, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    assert rows_of(exact_dedup.drop_exact_copies(df)) == Counter([(5, "y"), (9, "X"), (9, "x"), (None, "x"), (None, "y")])


def brute_lines(rows, least=40, docs=5):
    held = defaultdict(list)
    for i, t in rows:
        for k in {lower(x.strip(WS)) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held[k].append(-(1 << 63) if i is None else i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(own := held.get(lower(x.strip(WS)), [])) < docs or max(own) == (-(1 << 63) if i is None else i)]
        out[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


@pytest.mark.parametrize("room", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup(docs, empty, room, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", 2)
    assert rows_of(line_dedup.dedup_lines(docs, broadcast_bytes=room)) == brute_lines(ROWS)
    assert line_dedup.dedup_lines(empty, broadcast_bytes=room).count() == 0


@pytest.mark.parametrize("room", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup_many(spark, room, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    rng = random.Random(3)
    pool = [f"line {k} ä" + "x" * rng.randrange(25, 50) for k in range(300)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(400)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=room)
    assert rows_of(out) == brute_lines(rows)


@pytest.mark.parametrize("room", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup_null_and_repeated_ids(spark, room):
    lines = [c * 45 for c in "abcdef"]
    rng = random.Random(1)
    rows = [(rng.choice([None, None, 1, 2]), "\n".join(rng.choices(lines, k=4))) for _ in range(40)]
    assert rows_of(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_bytes=room)) == brute_lines(rows)


def test_counts_decide_in_the_probe():
    keys, prints = np.arange(5, dtype=np.uint64), np.arange(10, 15, dtype=np.uint64)
    mixed = keys ^ (prints * np.uint64(0x9E3779B97F4A7C15))
    table, order = line_dedup.PerfectHash(mixed), np.zeros(5, int)
    order[table.index(mixed)] = np.arange(5)
    arrays = (table, prints[order], np.array([2, 3, 4, 5, 6], np.uint32)[order], np.full(5, 99))
    assert line_dedup.probe(arrays, keys, prints, np.arange(5), 5).tolist() == [False, False, False, True, True]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64))
    table = line_dedup.PerfectHash(keys)
    assert sorted(table.index(keys)) == list(range(len(keys))) and table.size == len(keys)
    assert line_dedup.PerfectHash(keys[:0]).index(keys[:5]).tolist() == [-1] * 5


def test_bpe(docs, empty):
    library = Tokenizer.from_file(VOCAB)
    want, full = Counter(), Counter()
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(text)] += 1
        full[i, tuple(ids), text] += 1
    assert rows_of(bpe.encode_digests(docs, VOCAB)) == want
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, VOCAB).collect()) == full
    assert bpe.encode(empty, VOCAB).count() == 0


def test_bpe_on_odd_text():
    library, own, rng = Tokenizer.from_file(VOCAB), bpe.load(VOCAB), random.Random(5)
    parts = ["a", "E", "'s", "'ll", " ", "\n", "\x1c", "\x85", "Σ", "İ", "é", "é", "日", "½", "<|endoftext|>", "<|x", "aaa", "ing", "5", "!?"]
    texts = ["".join(rng.choice(parts + [chr(rng.randrange(1, 0xD800))]) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["ab" * 5000, "a" * 3001]
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert [int(i) for x in own.encoded(text) for i in x[1].split(" ")] == found.ids, text


@pytest.mark.parametrize("window", [4096, 256])
def test_pack(docs, empty, window):
    library = Tokenizer.from_file(VOCAB)
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in ROWS)
    pieces = packing.pack(docs, VOCAB, window=window, quantum=window // 64).collect()
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = tuple(np.frombuffer(p.ids, np.uint32).tolist())
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        by_doc[p.doc_id, p.doc_tokens].append((p.start, ids))
        seqs[p.sequence_id].append((p.offset, p.length))
    got = Counter()
    for (i, n), own in by_doc.items():
        copies = sum(1 for start, _ in own if start == 0)
        own = sorted(set(own)) if copies > 1 else sorted(own)
        assert [s for s, _ in own] == [sum(len(x) for _, x in own[:k]) for k in range(len(own))]
        got[i, tuple(x for _, ids in own for x in ids)] += copies
        assert sum(len(x) for _, x in own) == n
    assert got == want
    lengths = []
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        lengths.append(at)
    assert all(x & (x - 1) == 0 and x <= window for x in lengths) and sum(x < window for x in lengths) <= window.bit_length()
    assert sorted(seqs) == list(range(len(seqs)))
    assert packing.pack(empty, VOCAB).count() == 0


def test_solve_uses_patterns():
    hist = {k: int(v) for k, v in zip(range(1, 64), np.random.default_rng(0).integers(100, 5000, 63))}
    found, left = packing.solve(hist)
    used = Counter()
    for p, k in found:
        assert sum(p) == 64 and len(p) <= 4
        for x in p:
            used[x] += k
    assert all(used[k] + left.get(k, 0) == v for k, v in hist.items())
    assert sum(k * v for k, v in left.items()) < 0.4 * sum(k * v for k, v in hist.items())
    x = packing.nnls(np.array([[1.0, 0, 1], [0, 1, 1]]), np.array([1.0, -1]))
    assert (x >= 0).all() and abs(x[0] + x[2] - 1) < 1e-9 and x[1] == 0


def test_fingerprints(spark, docs, empty):
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for r in simhash.fingerprints(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, out.values())) == len(ROWS)
    prints = {t or "": r.fingerprint for i, t in ROWS for r in out[i]}
    for k, (i, t) in enumerate(rows):
        nxt, t = rows[(k + 1) % len(rows)][1] or "", t or ""
        if i == 13:
            continue  # two rows of one id: each precedes another text
        h = len(t) // 2
        r = out[i][0]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(t[: len(t) - h] + nxt[:h]))
        one, two = int(r.fingerprint, 16), int(r.edited_fingerprint, 16)
        assert r.near_edited == 1 - (one ^ two).bit_count() / 128
        assert r.near_next == 1 - (one ^ int(prints[nxt], 16)).bit_count() / 128
    assert len({r.fingerprint for r in out[1] + out[2]}) == 1
    assert simhash.fingerprints(empty).count() == 0


def brute_print(text):
    """128 votes one by one: Spark's xxhash64 has seed 42, and a second argument is hashed with the first one's hash as its seed."""
    votes, total, second = [0] * 128, 0, xxhash.xxh64_intdigest(b"second", 42)
    for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", lower(text)):
        weight = min(len(w), 16) ** 2
        total += weight
        for half, h in enumerate((xxhash.xxh64_intdigest(w.encode(), 42), xxhash.xxh64_intdigest(w.encode(), second))):
            for j in range(64):
                votes[64 * half + j] += weight * (h >> j & 1)
    bits = [2 * v > total for v in votes]
    return f"{sum(b << j for j, b in enumerate(bits[:64])):016x}{sum(b << j for j, b in enumerate(bits[64:])):016x}"


def test_all_bits_of_a_fingerprint(spark, docs):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcXYZ09é日") for _ in range(rng.randrange(1, 22))) for _ in range(200)]
    rows = [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(60)]
    for df, own in ((docs, ROWS), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        assert Counter((r.doc_id, r.fingerprint) for r in simhash.fingerprints(df).collect()) == Counter((i, brute_print(t)) for i, t in own)


def test_null_ids_in_cells(spark, monkeypatch):
    """Null ids come first, by a hash of the text, each followed by the next; equal rows stand together."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 5)
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefghij", k=30)) for _ in range(60)]
    rows = [(None if k % 3 else k, t) for k, t in enumerate(texts)] + [(None, texts[1])] * 20
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = Counter((i, sha(t[: len(t) - len(t) // 2] + line[(k + 1) % len(line)][1][: len(t) // 2])) for k, (i, t) in enumerate(line))
    assert Counter((r.doc_id, r.edited_sha256) for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_near_counts(spark):
    rng = random.Random(14)
    base = [rng.getrandbits(128) for _ in range(20)]
    all_ = [b ^ sum(1 << x for x in rng.sample(range(128), rng.randrange(0, 7))) for b in base for _ in range(10)] + base * 3
    prints = [(i, f"{x:032x}") for i, x in enumerate(all_)] + [(None, f"{base[0]:032x}"), (1000, None)]
    got = Counter((r.doc_id, r.n_within) for r in simhash.near_counts(spark.createDataFrame(prints, "doc_id long, fingerprint string")).collect())
    every = [x for _, x in prints if x is not None]
    near = lambda x: sum((int(x, 16) ^ int(y, 16)).bit_count() <= 3 for y in every)
    assert got == Counter((i, near(x) if x is not None and i is not None and i % 20 == 0 else None) for i, x in prints)


def test_fingerprints_across_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 1)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = sorted({rng.randrange(10_000): " ".join(rng.choices(words, k=rng.randrange(20, 80))) for _ in range(700)}.items())
    got = {r.doc_id: r for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        h = len(t) // 2
        assert got[i].edited_sha256 == sha(t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h])
    near = np.array([[r.near_edited, r.near_next] for r in got.values()])
    assert (near[:, 0] > near[:, 1]).mean() > 0.9


def test_within_radius(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(30)]
    all_ = [b ^ sum(1 << x for x in rng.sample(range(128), rng.randrange(0, 8))) for b in base for _ in range(6)] + base[:5]
    prints = spark.createDataFrame([(i, f"{x:032x}") for i, x in enumerate(all_)] + [(999, None)], "doc_id long, fingerprint string")
    got = {(r.query_print, r.print): (r.distance, r.n) for r in simhash.within_radius(prints, prints, 3).collect()}
    n = Counter(all_)
    want = {(f"{a:032x}", f"{b:032x}"): ((a ^ b).bit_count(), n[b]) for a in n for b in n if (a ^ b).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("limit", [1, 100, 400, 1 << 20])
def test_shard(docs, empty, limit):
    out = sharding.shard(docs, limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((i, len((t or "").encode())) for i, t in ROWS)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for name, own in shards.items():
        size = sum(r.n_bytes for r in own)
        assert {(r.depth, r.shard_bytes, r.shard_rows) for r in own} == {(len(name), size, len(own))}
        assert size <= limit or len({r.doc_id for r in own}) == 1
        if name:  # its parent was too large
            assert sum(r.n_bytes for r in out if r.shard.startswith(name[:-1])) > limit
    assert sharding.shard(empty, limit).count() == 0


def test_directory_has_one_slot_for_most_rows(spark):
    """Of 3000 rows over some 200 shards each meets one leaf, and shards of one long chain meet no more than the chain."""
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    leaves = {(r.shard, r.depth) for r in sharding.shard(df, 2000).collect()}
    deepest = max(d for _, d in leaves)
    assert len(leaves) > 150 and sharding.directory_bits(len(leaves), deepest) == deepest
    assert sharding.directory_bits(40, 60) == 8 and sharding.directory_bits(1, 0) == 0


def test_write_shards(spark, docs, empty, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 400)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("shard", F.input_file_name())
    own = [c for c in docs.columns]
    assert rows_of(back.select(own)) == rows_of(docs.select(own))
    sizes = Counter()
    for r in back.collect():
        sizes[r.shard.rsplit("/", 2)[1]] += len((r.text or "").encode())
    want = {f"shard={r.shard}": r.shard_bytes for r in sharding.shard(docs, 400).collect()}
    assert dict(sizes) == want
    sharding.write_shards(empty, str(tmp_path / "none"), 400)


def test_filter_urls(spark):
    urls = [None, "", "no scheme", "http://", "https://Example.ORG/es/1", "http://example.org/en/12?q", "http://a.b.example.org/en/2", "https://xexample.org/es/", "https://m.com/de/#x", "https://com/fr/", "http://com", "http://net/a", "http://u.com/de/x?http://z.org/", "https://m.com/de/#x"]
    df = spark.createDataFrame([(i, u, "kept", 5) for i, u in enumerate(urls)], "page_id long, url string, h string, p int")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "block"), (None, "/", "block"), ("net", None, "block")]
    got = {r.page_id: r for r in url_filter.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        tail = u.split("://", 1)[1] if u and "://" in u else ""
        host = tail
        for c in "/?#":
            host = host.split(c)[0]
        path = tail[len(host):].split("?")[0].split("#")[0]
        host = lower(host)
        fits = [(len(h + p), v, h + p) for h, p, v in rules if h and p and ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2], best[1]), u
        assert (got[i].h, got[i].p) == ("kept", 5)
    none = url_filter.filter_urls(df, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(urls)
    assert url_filter.filter_urls(df.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_rules_have_two_parts(spark):
    rules = spark.createDataFrame([("com", "abc", "block"), ("co", "m/x", "block"), ("b.org", "", "block"), ("a/b", "/", "block")], "host string, path string, verdict string")
    urls = ["http://comabc", "http://com/x", "http://com.co/m/x", "http://b.org", "http://a.b.org/y", "http://a/b/", "http://" + "a." * 20_000 + "b.org/" + "p" * 50_000]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == {i: (("b.org", "block") if i in (3, 4, 6) else (None, "allow")) for i in range(len(urls))}


def test_bloom_has_no_false_negatives(spark):
    keys = [(f"k{i}",) for i in range(3000)]
    bits = url_filter.bloom_of(spark.createDataFrame(keys, "rule string"), 40)
    at, own = url_filter._places([k for (k,) in keys], 40)
    assert ((bits[at[:, None], own >> 3] >> (own & 7).astype(np.uint8)) & 1).all()
