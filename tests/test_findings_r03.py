"""Queries on values that the given tables lack, against their SQL."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa

from docmill.operators import chunk, keyword, keyword_index, rank, vector, vector_index
from docmill.plans import catalogue
from docmill.session import scratch_path


def agrees(spark, folder, name, table, rows, schema):
    """The rows of a query on a table of its own, which are those of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = catalogue.queries()[name](spark, str(folder))
    found = c.execute(catalogue.oracle_sql()[name])
    assert got.columns == [d[0] for d in found.description]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(found.fetchall())
    return got


def test_percent_labels_of_halves(spark, tmp_path):
    """Prices that are half a percent: 285000 of a million is 29 %, as 28.5 is."""
    prices = [5000.0 * k for k in range(-9, 400)] + [284999.99, 0.01, None]
    got = dict(agrees(spark, tmp_path, "percent_labels", "orders", list(enumerate(prices)), "o_orderkey long, o_totalprice double"))
    assert got[prices.index(285000.0)] == "29%" and got[prices.index(284999.99)] == "28%"


def test_titles_that_end_in_line_ends(spark, tmp_path):
    """A line end or tab tells titles apart, blanks of all kinds and case don't; of rows without a text the first stays, empty ones all do."""
    x = "x" * 39
    texts = [x, x + "\nmore", x + " more", x.upper() + " more", "\t" + x, "　" + x[:38], " " + x[:38] + "\n", x[:38] + " \nmore", "", " ", "  ", "\n", None, None, " " + x[:37] + " \n"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = agrees(spark, tmp_path, "title_dedup", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r[0] for r in got} >= {"0", "1", "4", "8", "9", "10", "11", "12"} and not {r[0] for r in got} & {"2", "3", "13"}


def test_chunks_leave_a_worker_in_slices():
    """A batch of 64 MB of texts goes through in small parts; none holds more than a few MB of chunks."""
    texts = [("Some words here. And more.\n\n" * 40_000)] * 58 + [None, "", "short"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(61)), pa.array(texts)], ["id", "texto"])
    sizes, seen = [], {}
    for b in chunk.cut_batches(iter([batch, batch.slice(0, 0)]), 4000):
        sizes.append(b.nbytes)
        for i, total, k, text in zip(*(c.to_pylist() for c in b.columns)):
            assert k == len(seen.setdefault(i, [])) < total
            seen[i].append(text)
    assert [seen[i] for i in (0, 57, 58, 59, 60)] == [chunk.cut(texts[i]) for i in (0, 57, 58, 59, 60)] and len(seen) == 61
    assert max(sizes) < 4 << 20 < batch.nbytes // 10


def peak(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_workers_score_few_pairs_at_a_time():
    """1,024 queries against batches of 10,000 rows: the best of all, in less memory than the batch's scores take."""
    draw = np.random.default_rng(3)
    asked, x = (vector.units(list(draw.normal(size=(n, 8))), 8) for n in (1024, 10_000))
    x[5000:5040] = x[17]
    ids = draw.permutation(10_000)
    b = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x.tolist())], ["id", "vector"])
    got, most = peak(lambda: vector.best_of_batch(b, asked, 10))
    want = np.lexsort((np.broadcast_to(ids, (1024, 10_000)), -np.rint(asked @ x.T * 1e9)))[:, :10]
    assert [sorted(r) for r in got.column(1).to_numpy().reshape(1024, 10).tolist()] == [sorted(r) for r in ids[want].tolist()]
    assert most < 70 << 20
    books = draw.normal(size=(8, 256, 1)) / 4
    model = vector_index.Model(x[:100], books, np.full(100, 300), 100, 40, 1.0)
    codes, bucket, asks = draw.integers(0, 256, (30_000, 8)).astype(np.uint8), np.sort(draw.integers(0, 100, 30_000)).astype(np.int32), draw.random((1024, 100)) < 0.7
    stored = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(range(30_000)), pa.array([c.tobytes() for c in codes], pa.binary())], ["bucket", "id", "code"])
    got, most = peak(lambda: pa.Table.from_batches(vector_index.best_coded((stored.slice(i, 10_000) for i in range(0, 30_000, 10_000)), model, asked, asks, 40)))
    near = np.where(asks[:, bucket], asked @ (model.centroids[bucket] + books[np.arange(8), codes].reshape(-1, 8)).T, -np.inf)
    found = {q: set() for q in range(1024)}
    for q, i in zip(got["q"].to_pylist(), got["id"].to_pylist()):
        found[q].add(i)
    assert got.num_rows == 1024 * 40 and most < 150 << 20
    assert all(found[q] == set(np.argsort(-near[q])[:40].tolist()) for q in range(0, 1024, 16))


def test_postings_meet_as_lists(spark):
    """Documents of the same words give a row for 128 of them, where each posting was a row of the shuffle; the index holds them all, with their places."""
    docs = spark.createDataFrame([(i, "uno dos uno" if i % 2 else "uno dos tres-uno") for i in range(300)] + [(300, None)], "doc_id long, text string").coalesce(1)
    counted = keyword_index._counted(keyword._tokens(docs, "doc_id", ["text"]), "bigint")
    rows = keyword_index._posted(counted, "bigint", 8)
    assert counted.count() == 301 and rows.count() == 3 + 3 + 2
    path = scratch_path(spark, "words")
    keyword_index.build_index(docs, path, buckets=8)
    held = spark.read.parquet(f"{path}/postings").selectExpr("token", "explode(arrays_zip(docs, dls, tfs, places)) AS x").select("token", "x.*").collect()
    want = [("uno", i, 3 + (i % 2 == 0), 2, [0, 2 + (i % 2 == 0)]) for i in range(300)] + [("dos", i, 3 + (i % 2 == 0), 1, [1]) for i in range(300)] + [("tres", i, 4, 1, [2]) for i in range(0, 300, 2)]
    assert sorted(map(tuple, held)) == sorted(want) and spark.read.parquet(f"{path}/forward").count() == 300


def test_search_joins_only_rows_that_were_found(spark):
    """Ids stand in the inputs of the join that chunks come from; copies of an id and null ids are ranked as top_k() ranks them."""
    docs = spark.createDataFrame([(str(i), "t") for i in range(50)], "id string, texto string")
    chunks = docs.join(spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(50)], "id string, embedding array<double>"), "id")
    hits = spark.createDataFrame([("3", 1), ("4", 2)], "id string, rank int")
    for found in (rank.lookup_hits(hits, chunks), vector.top_k_rows(chunks, [1.0, 3.0], 2)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Join Inner, (id") :]
        assert {r.id for r in found.collect()} == {"3", "4"} and below.count(" IN (") >= 2
    odd = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), (None, [1.0, 0.1]), ("b", None), ("c", [1.0, 0.2])], "id string, embedding array<double>")
    for k in (1, 2, 3, 4, 5):
        assert vector.top_k_rows(odd, [1.0, 0.0], k).collect() == vector.top_k(odd, [1.0, 0.0], k).collect()
