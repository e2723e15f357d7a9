"""The toxicity network: gradients, held-out accuracy, whole texts, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import toxicity
from tests.llm.conftest import ROWS

SYLLABLES = ["ba", "ko", "ri", "mu", "ten", "sol", "ar", "ve"]
BAD = ["idiot", "scum", "zworl"]


def make(rng, toxic, n):
    words = ["".join(rng.choices(SYLLABLES, k=rng.randrange(1, 4))) for _ in range(n)]
    if toxic:
        bad = rng.choice(BAD)
        words.insert(rng.randrange(n + 1), bad + rng.choice(SYLLABLES) if bad == "zworl" else bad)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def params():
    rng = random.Random(0)
    told = [(make(rng, k % 4 == 0, rng.randrange(5, 120)), int(k % 4 == 0)) for k in range(700)]
    return toxicity.train([t for t, _ in told], [y for _, y in told])


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(1).items()}
    words, at, mask, y = [b"idiot", b"the", b"ab", b"zworlba"], rng.integers(0, 4, (6, 3)), np.ones((6, 3), bool), np.array([1, 0, 1])
    mask[4:, 1] = False
    _, g = toxicity.grads(p, words, at, mask, y)
    for k in p:
        own = np.argwhere(np.abs(g[k]) > 1e-5)
        for i in map(tuple, own[rng.permutation(len(own))[:4]]):
            step = np.zeros_like(p[k])
            step[i] = 1e-2
            up, down = (toxicity.grads({**p, k: p[k] + s * step}, words, at, mask, y)[0] for s in (1, -1))
            assert g[k][i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-5), k


def test_held_out_accuracy(params):
    rng = random.Random(1)
    scorer = toxicity.Scorer(params)
    toxic, clean = ([make(rng, t, rng.randrange(5, 300)) for _ in range(150)] for t in (True, False))
    assert np.mean(np.array(scorer.scores(toxic)) >= 0.5) > 0.95
    assert np.mean(np.array(scorer.scores(clean)) < 0.5) > 0.95


def test_whole_texts_count(params):
    rng = random.Random(2)
    clean = make(rng, False, 5000)
    one, two = toxicity.Scorer(params).scores([clean, clean + " idiot"])
    assert one < 0.5 <= two


def test_cache_does_not_matter(params, monkeypatch):
    rng = random.Random(3)
    texts = [make(rng, k % 2, 60) for k in range(40)] + [None, "", "..."]
    whole = toxicity.Scorer(params).scores(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 50)
    monkeypatch.setattr(toxicity, "TAKEN_WORDS", 100)
    monkeypatch.setattr(toxicity, "BATCH", 7)
    assert np.allclose(whole, toxicity.Scorer(params).scores(texts), atol=1e-4)


def test_score(spark, docs, empty, params):
    out = toxicity.score(docs, params).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert len({r.score for r in out if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(empty, params).count() == 0
    left = toxicity.drop_toxic(docs, params)
    assert left.schema == docs.schema and left.count() == sum(r.predicted == 0 for r in out)


def test_fit_leaves_the_fold_out(spark):
    rng = random.Random(4)
    rows = [(i, make(rng, i % 4 == 0, 40)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    texts, y = toxicity.labelled_sample(docs, labels, toxic_rows=40, clean_rows=60)
    assert len(texts) == 100 and sum(y) == 40
    by_text = {t: i for i, t in rows}
    assert all(zlib.crc32(str(by_text[t]).encode()) % 5 for t in texts)


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5


def test_held_out_fold_of_the_labels(spark):
    """No label of the held-out fold is read, its rows are told apart, and what stands beside a text moves its score by a rounding at most."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = toxicity.held_out(F.col("doc_id"))
    learnt = toxicity.labelled_sample(docs, labels)
    assert learnt == toxicity.labelled_sample(docs, labels.where(~fold)) and len(set(learnt[1])) == 2
    params = toxicity.train(*learnt)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, params).collect()}
    told = {r.doc_id: r.toxic for r in labels.where(fold).collect() if r.toxic is not None}
    bad, good = ([scored[i] for i, y in told.items() if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + (a == b) / 2 for a in bad for b in good])
    assert len(bad) >= 3 and auc >= 0.9, auc
    again = {r.doc_id: r.score for r in toxicity.score(docs.repartition(7, F.xxhash64("text")), params).collect()}
    assert again.keys() == scored.keys() and max(abs(again[i] - scored[i]) for i in scored) < 1.5e-6
