"""Jaccard join and substring dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import jaccard, substring_dedup
from tests.llm.conftest import ROWS


def brute_components(rows, width=5):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").translate({c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    by, near = defaultdict(list), defaultdict(set)
    for i, s in sets:
        by[i].append(s)
    ids = list(by)
    for a in ids:
        for b in ids:
            if a != b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in by[a] for y in by[b]):
                near[a].add(b)
    comp = {}
    for i in sorted(ids, key=lambda x: (x is None, x)):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += near[x]
    return Counter((i, len(s), comp[i]) for i, s in sets)


def found(df, **options):
    return Counter(tuple(r) for r in jaccard.similar_groups(df, **options).collect())


def test_edge_cases(spark, docs, empty):
    assert found(docs) == brute_components(ROWS)
    assert jaccard.similar_groups(empty).count() == 0
    left = jaccard.drop_near_copies(docs)
    assert left.columns == docs.columns and 2 not in {r.doc_id for r in left.collect()}


def test_null_and_repeated_ids(spark):
    """Each row with a null id is a document of its own; rows that share an id go together, those without words as well."""
    a, b, c, d = ("one two three four five six seven", "other words that stand for themselves here", "third text with its own seven words", "")
    rows = [(None, a), (None, b), (None, a), (7, a), (7, c), (3, c), (7, d), (None, d), (8, c.upper()), (9, d)]
    want = Counter([(None, 3, 3), (None, 2 + 1, None), (None, 3, 3), (7, 3, 3), (7, 3, 3), (3, 3, 3), (7, 0, 3), (None, 0, None), (8, 3, 3), (9, 0, 9)])
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want


def edited(rng, words, base, share):
    return [rng.choice(words) if rng.random() < share else w for w in base]


@pytest.mark.parametrize("chunk", [2000, 5])
def test_components(spark, chunk, monkeypatch):
    """Groups of near copies, chains, shared passages and thresholds, also with hot shingles put last and blocks in small pieces."""
    monkeypatch.setattr(jaccard, "HOT", 4)
    rng = random.Random(chunk)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=30)
    texts = []
    for size in (2, 3, 8, 60):
        base = rng.choices(words, k=rng.randrange(20, 90))
        texts += [edited(rng, words, base, rng.choice([0, 0.01, 0.03, 0.06])) for _ in range(size)]
    chain = rng.choices(words, k=60)
    for _ in range(12):
        texts.append(list(chain))
        chain[rng.randrange(60)] = rng.choice(words)
    texts += [passage + rng.choices(words, k=rng.randrange(1, 40)) for _ in range(60)]
    texts += [rng.choices(words[:3], k=rng.randrange(0, 9)) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, chunk=chunk) == brute_components(rows)


def test_without_copies_one_block(spark):
    """No leader helps here: pairs link neither with the smallest ids nor with one another's neighbours."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(2000)]
    core = rng.choices(words, k=24)
    rows = []
    for i in range(40):
        own = core + rng.choices(words, k=20)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1] + ["end"]))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), chunk=7) == brute_components(rows)


def test_rtree_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 120)).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[2:], [np.uint64(999)]])) for s in sets[:100]]
    vectors, sizes = jaccard.coarse([jaccard.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    q, x = jaccard.RTree(vectors, sizes).near(vectors, sizes)
    near = set(zip(q.tolist(), x.tolist()))
    every = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    want = {(i, j) for i, j in every if 175 * len(np.intersect1d(sets[i], sets[j])) >= 75 * (sizes[i] + sizes[j])}
    ratio = lambda i, j: 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j])
    bound = {(i, j) for i, j in every if ratio(i, j) and 175 * int(np.minimum(vectors[i], vectors[j]).sum(dtype=int)) >= 75 * (sizes[i] + sizes[j])}
    assert want <= near == bound and len(near) == len(q) and len(near) < 0.2 * len(every)
    assert len(jaccard.RTree(vectors[:0], sizes[:0]).near(vectors, sizes)[0]) == 0


def test_count_vectors_bound_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 2500))) for _ in range(2))
        if 175 * len(np.intersect1d(a, b)) >= 75 * (len(a) + len(b)):
            assert jaccard.may_link_pair(jaccard.count_vector(a), len(a), jaccard.count_vector(b), len(b))
    for n in (10, 3000, 9000, 40_000):
        own = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        v = jaccard.coarse([jaccard.unpacked(jaccard.packed(jaccard.count_vector(own)), len(own))])
        assert (v.shape, int(np.minimum(v, np.bincount((own % np.uint64(256)).astype(int), minlength=256)).sum())) == ((1, 256), len(own))
    same = np.arange(0, 64 * 500, 64).astype(np.uint64)  # all in one coordinate, beyond a byte
    v = jaccard.count_vector(same)
    assert jaccard.may_link_pair(v, 500, v, 500)
    for own in (same, np.arange(3000).astype(np.uint64), np.arange(0, 30 * 256, 256).astype(np.uint64)):  # bytes and half bytes hold all counts
        v = jaccard.count_vector(own)
        assert (jaccard.unpacked(jaccard.packed(v), len(own)) == v).all() and (len(jaccard.packed(v)) < len(v)) == (v.max() < 16)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99}


def brute_spans(rows):
    parts = [(float("inf") if i is None else i, substring_dedup.sentences(t or "")) for i, t in rows]
    first = {}

    def spans(own):
        for i in range(len(own)):
            for j in range(i, len(own) + 1):
                if j - i >= 3 and sum(len(w) for *_, w in own[i:j]) >= 20:
                    yield i, j, tuple(tuple(w) for *_, w in own[i:j])
                    break

    for i, own in parts:
        for a, _, key in spans(own):
            first[key] = min(first.get(key, (float("inf"), a)), (i, a))
    out = Counter()
    for (i, own), (real, t) in zip(parts, rows):
        gone, seen = set(), set()
        for a, z, key in spans(own):
            if first[key][0] < i or key in seen:
                gone |= set(range(a, z))
            seen.add(key)
        out[real, len(own), len(gone), "".join((t or "")[a:z] for k, (a, z, _) in enumerate(own) if k not in gone) if own else t or ""] += 1
    return out


def test_spans_edge_cases(docs, empty):
    assert Counter(tuple(r) for r in substring_dedup.dedup_spans(docs).collect()) == brute_spans(ROWS)
    assert substring_dedup.dedup_spans(empty).count() == 0


def test_spans(spark):
    rng = random.Random(6)
    words = [f"word{k}" for k in range(500)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 30))) + rng.choice([". ", "! ", "\n", ".\n", "。", " "])
    passages = ["".join(sentence() for _ in range(8)) for _ in range(5)]
    rows = []
    for i in range(80):
        body = [sentence() for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(0, 3)):
            body.insert(rng.randrange(len(body) + 1), rng.choice(passages))
        rows.append((i if i != 40 else None, "".join(body)))
    out = substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in out) == brute_spans(rows)


def test_spans_of_null_ids(spark):
    """Rows with a null id come after all others and don't count as one document."""
    text = " ".join(f"n{k}" for k in range(30))
    out = substring_dedup.dedup_spans(spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (None, None)], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_removed) for r in out) == Counter([(None, 30), (None, 30), (4, 0), (4, 0), (None, 0)])


def test_planted_passage_goes_and_the_rest_stays(spark):
    rng = random.Random(8)
    words = [f"p{k}" for k in range(2000)]
    passage = " ".join(rng.choices(words, k=52))
    heads = [" ".join(rng.choices(words, k=40)) + ". " for _ in range(6)]
    rows = [(i, h + passage + " " + " ".join(rng.choices(words, k=30))) for i, h in enumerate(heads)]
    out = {r.doc_id: r for r in substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    for i in range(1, 6):
        assert out[i].text.startswith(heads[i]) and len(set(out[i].text.split()) & set(passage.split())) < 35


def test_sentences_cover_the_text():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "bb. ", "\n", "ccc! ", " ", "d", "é。", "\t", "x y z "]) for _ in range(rng.randrange(60)))
        parts = substring_dedup.sentences(text)
        assert "".join(text[a:z] for a, z, _ in parts) == (text if parts else "") and (parts or not text.split())


def test_drop_repeated_spans_keeps_columns(docs):
    out = substring_dedup.drop_repeated_spans(docs)
    assert out.schema == docs.schema and out.count() == len(ROWS)


@pytest.mark.parametrize("kind", ["blanks", "points", "one word", "chinese"])
def test_passages_go_wholly(spark, kind):
    """Passages of 51 words in running text go from their first word to their last, with and without points or blanks."""
    rng = random.Random(kind)
    pool = [chr(0x4E00 + k) for k in range(3000)] if kind == "chinese" else [f"q{k}" for k in range(3000)]
    glue = "" if kind == "chinese" else " "
    rows, want = [], []
    for i in range(40):
        passage = [pool[i]] * 60 if kind == "one word" else [w + "." * (kind == "points" and rng.random() < 0.2) for w in rng.choices(pool, k=51)]
        for k in range(2):
            head, tail = ([chr(c + 2 * i + k) if kind == "chinese" else f"{c}-{2 * i + k}"] for c in (0x6000, 0x7000))
            rows.append((2 * i + k, glue.join([*head, *passage, *tail])))
            kept = [] if k else passage[:1] if kind == "one word" else passage
            want.append((2 * i + k, glue.join([*head, *kept, *tail])))
    got = {r.doc_id: r.text for r in substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(want)


def test_counts_above_full_rule_nothing_out():
    """Equal sets of six million shingles: every count is above what a vector can say."""
    v, n = np.full((20, 256), jaccard.FULL, np.int16), np.full(20, 6_000_000)
    assert jaccard.may_link(v[0], 6_000_000, v[1], 6_000_000) and jaccard.may_link(v, n, v[0], n[0]).all()
    assert len(jaccard.RTree(v, n).near(v, n)[0]) == 400
    v[10:] = 255  # exact counts of sets that the bound rules out as before
    assert not jaccard.may_link(v, n, v[10], n[10]).any()


def counted(monkeypatch, name):
    """A list that gets the arguments of each call of a function of jaccard."""
    calls, f = [], getattr(jaccard, name)
    monkeypatch.setattr(jaccard, name, lambda *a, **b: calls.append(a) or f(*a, **b))
    return calls


def test_links_of_a_task_take_few_rounds(spark, monkeypatch):
    """A path as long as a large group of near copies can make it; links that a task holds not all at once, and ones in many tasks."""
    calls = counted(monkeypatch, "saved")
    path = [(i, i + 1) for i in range(600)]
    random.Random(1).shuffle(path)
    rows = lambda n: spark.createDataFrame(path + [(5000, 4000), (7, 7)], "a long, b long").repartition(n)
    want = {i: 0 for i in range(601)} | {4000: 4000, 5000: 4000}
    assert {r.node: r.label for r in jaccard.components(rows(1)).collect()} == want
    assert sum(name == "labels" for _, name in calls) <= 3
    assert all(a < b for a, b in jaccard._stars(rows(3)).collect()) and jaccard._stars(rows(3)).count() <= len(path) + 1
    assert {r.node: r.label for r in jaccard.components(rows(5)).collect()} == want
    monkeypatch.setattr(jaccard, "JOINED", 50)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)  # labels are shuffled
    monkeypatch.setattr(jaccard, "sliced", lambda batches, rows: (b.slice(k, 40) for b in batches for k in range(0, b.num_rows, 40)))
    assert {r.node: r.label for r in jaccard.components(rows(2)).collect()} == want


def test_large_groups_are_labelled_once(spark, monkeypatch):
    """Near copies in several pieces with a few others that share a passage: what the pieces leave fits one piece, and is not dealt anew."""
    monkeypatch.setattr(jaccard, "HOT", 10**6)
    calls, seats = counted(monkeypatch, "components"), counted(monkeypatch, "_across")
    rng = random.Random(4)
    words = [f"g{k}" for k in range(3000)]
    passage = rng.choices(words, k=20)
    base = passage + rng.choices(words, k=40)
    texts = [base + [f"own{k}"] for k in range(40)] + [passage + rng.choices(words, k=15) for _ in range(8)]
    ids = [r.id for r in spark.range(48).orderBy(F.xxhash64("id")).collect()]  # the first of those that share a shingle leads
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts)]
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 9
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk=12) == want
    assert len(seats) == 1 and len(calls) == 2
