"""The funnel over what both searches find in all documents, against brute force."""

import re
import sqlite3
import unicodedata
from collections import Counter

import numpy as np
import pytest

from docmill.plans import catalogue


def tokens(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def diverse(rows, docs, k):
    seen, first, over = Counter(), [], []
    for i in rows:
        seen[docs[i].source] += 1
        (over if docs[i].source and seen[docs[i].source] > max(5, k // 3) else first).append(i)
    return (first + over)[:k]


@pytest.fixture(scope="module")
def want(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    cosine = {i: v @ vectors[0] / np.linalg.norm(v) / np.linalg.norm(vectors[0]) for i, v in vectors.items() if i in docs}
    near = sorted(cosine, key=lambda i: (-round(cosine[i], 9), i))[:300]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(body)")
    db.executemany("INSERT INTO f(rowid, body) VALUES (?, ?)", [(i, r.text) for i, r in docs.items()])
    match = " OR ".join(f'"{w}"' for w in dict.fromkeys(tuple(tokens(w)) for w in asked.split() if len(w) > 2) for w in [" ".join(w)])
    hits = [i for i, _ in sorted(db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)), key=lambda x: (round(x[1], 9), x[0]))][:300]
    union = near + [i for i in hits if i not in set(near)]
    titles, pool = set(), []
    for i in union:
        title = docs[i].text[:40].strip().lower()
        if not title or title not in titles:
            pool.append(i)
        titles.add(title)
    asked_tokens = set(tokens(asked))
    share = {i: len(asked_tokens & set(tokens(" ".join([docs[i].text[:40], docs[i].text[: 80 * (i % 2 == 0)], docs[i].text])))) / len(asked_tokens) for i in pool[:200]}
    best = [i for i in sorted(pool[:200], key=lambda i: -share[i]) if share[i] >= 0.1]
    return {"union_dedup": union, "rerank_pool": union[:200], "diversity_cap_backfill": diverse(union, docs, 100), "hybrid_funnel": diverse(best, docs, 100) if len(best) >= 3 else []}


@pytest.mark.parametrize("name", ["union_dedup", "rerank_pool", "diversity_cap_backfill", "hybrid_funnel"])
def test_searched(spark, sf, want, name):
    rows = catalogue.queries()[name](spark, sf).orderBy("input_rank").collect()
    assert [int(r.id) for r in rows] == want[name] and len(rows) > 60


def test_all_orders_count(spark, sf):
    assert catalogue.queries()["recency_boost"](spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count() > 300
