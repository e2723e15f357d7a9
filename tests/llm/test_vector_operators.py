"""op11 to op13 against brute force, on nulls, ties, repeated rows, clashing names and dense places."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import centroids, codes, embedding_dedup
from docmill.llm.vectors import packed, unpacked

DRAW = np.random.default_rng(4)
SCHEMA = "vec_id long, embedding array<double>, label int, node long, v string, w int, ball int, cluster string, code int, kept int, n int, own string, id string"


def frame(spark, rows):
    """(vec_id, vector, label) with columns whose names clash with those that operators use or add."""
    return spark.createDataFrame([(i, v, x, 1, "v", 2, 3, "c", 4, 5, 6, "o", "i") for i, v, x in rows], SCHEMA).repartition(3)


def odd(dims):
    """Rows that no operator compares: null, empty, zeros apart, null and non-finite components, too long and too short."""
    bad = [None, [], [None] * dims, [math.nan] * dims, [math.inf] + [1.0] * (dims - 1)]
    return [(900 + i, v, i % 2) for i, v in enumerate(bad)]


def vectors(n, dims, grid=None):
    x = DRAW.normal(size=(n, dims))
    return (np.round(x * grid) / grid if grid else x).tolist()


# ---- centroids


def brute_clusters(kept, k, rounds, scale):
    """kept: (id, vector). Assignment, distances and centres in Python's integers."""
    ints = {i: [math.floor(scale * c) for c in v] for i, v in kept}
    order = sorted(ints, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]
    centres = [ints[i] for i in order]

    def assigned():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), z) for z, c in enumerate(centres)) for i, v in ints.items()}

    for _ in range(rounds):
        to = assigned()
        for z in range(len(centres)):
            own = [ints[i] for i, (_, y) in to.items() if y == z]
            if own:
                centres[z] = [sum(c) // len(own) for c in zip(*own)]
    return assigned(), centres


@pytest.mark.parametrize(("n", "dims", "k", "grid"), [(700, 2, 9, 8), (400, 5, 7, None), (300, 3, 16, 1), (5, 4, 16, None)])
def test_clusters_match_brute_force(spark, n, dims, k, grid):
    rows = [(i, v, None) for i, v in enumerate(vectors(n, dims, grid))]
    got, centres = centroids.clusters(frame(spark, rows + odd(dims)), k=k, dims=dims, scale=8)
    want, means = brute_clusters([(i, v) for i, v, _ in rows], k, 3, 8)
    assert {r.id: (r.distance, r.cluster) for r in got.collect()} == want and centres.tolist() == means


def test_trees_prune_and_assign_whole_nodes(monkeypatch):
    """Rows in tight groups: far fewer exact distances than rows, and the same centres."""
    x = (np.repeat(DRAW.integers(-1000, 1000, (8, 3)), 500, 0) + DRAW.integers(-5, 5, (4000, 3))).astype(np.int64)
    centres = x[::500].copy()
    tree = centroids.build(x)
    seen = []
    real = centroids.squared_distances
    monkeypatch.setattr(centroids, "squared_distances", lambda a, b: seen.append(len(a)) or real(a, b))
    own, count, sums = centroids.assign(tree, centres)
    want = real(tree.rows, centres).argmin(1)
    assert (own == want).all() and (count == np.bincount(want, minlength=8)).all() and sum(seen) < 1000
    assert all((sums[z] == tree.rows[want == z].sum(0)).all() for z in range(8))


def test_equally_far_centres_and_equal_centres():
    x = np.array([[0, 0], [2, 0], [-2, 0], [0, 0]] * 30, np.int64)
    for centres in ([[1, 0], [-1, 0], [1, 0]], [[-1, 0], [1, 0]], [[0, 0]]):
        c = np.array(centres, np.int64)
        tree = centroids.build(x)
        assert (centroids.assign(tree, c)[0] == ((tree.rows[:, None] - c) ** 2).sum(2).argmin(1)).all()


def test_clusters_of_repeated_and_null_ids(spark):
    rows = [(1, [0.0, 0.0], 0), (1, [9.0, 9.0], 0), (None, [5.0, 5.0], 0), (None, [5.0, 5.0], 0), (2, [1.0, 0.0], 0)]
    got, centres = centroids.clusters(frame(spark, rows), k=3, dims=2, scale=1)
    assert sorted((r.id or 0, r.cluster, r.distance) for r in got.collect()) and got.count() == 5 and len(centres) == 3
    report = centroids.cluster_report(frame(spark, rows), k=3, dims=2, scale=1).collect()
    assert len({r.inertia for r in report}) == 1 and report[0].inertia == sum(r.distance for r in report)
    assert all(r.cluster_inertia == sum(o.distance for o in report if o.cluster == r.cluster) for r in report)


def test_clusters_of_nothing_and_of_too_much(spark):
    assert centroids.cluster_report(frame(spark, odd(4)), dims=4).collect() == [] and centroids.cluster_report(frame(spark, []), dims=4).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_report(frame(spark, [(1, [1e30, 0.0], 0)]), dims=2).collect()


def test_packed_integers():
    for x in ([[0, 127, -128]], [[128, 0, 0]], [[1 << 20, -(1 << 31), 5]], [[1 << 40, 0, -1]], np.zeros((0, 3))):
        assert (unpacked(packed(np.array(x, np.int64)), 3) == np.array(x)).all()


# ---- codes


def brute_codes(kept, parts, entries, rounds, scale):
    width = len(kept[0][1]) // parts
    ints = [(i, [tuple(math.floor(scale * c) for c in v[p * width : (p + 1) * width]) for p in range(parts)]) for i, v in sorted(kept)]
    books = [[v[p] for _, v in ints[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        to = [[best(p, v[p])[1] for p in range(parts)] for _, v in ints]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for (_, v), t in zip(ints, to) if t[p] == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    final = {i: [best(p, v[p]) for p in range(parts)] for i, v in ints}
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in final.items()}, books


@pytest.mark.parametrize(("n", "parts", "entries", "grid"), [(300, 4, 8, None), (200, 2, 64, 1), (3, 4, 64, None)])
def test_codes_match_brute_force(spark, n, parts, entries, grid):
    rows = [(i, v, [None, 1, 2][i % 3]) for i, v in enumerate(vectors(n, 8, grid))]
    got = codes.code_report(frame(spark, rows + odd(8)), parts=parts, entries=entries, scale=16).collect()
    want, books = brute_codes([(i, v) for i, v, _ in rows], parts, entries, 2, 16)
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    label = {i: x for i, _, x in rows}
    assert all(r.label_error == sum(e for i, (_, e) in want.items() if label[i] == label[r.vec_id]) for r in got)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}


def test_codes_of_repeated_ids_other_lengths_and_nothing(spark):
    rows = [(1, [0.0] * 4, None), (1, [0.0] * 4, None), (None, [1.0] * 4, 7), (5, [1.0] * 8, 7)]
    got = codes.code_report(frame(spark, rows), parts=2, entries=2).collect()
    assert sorted((r.vec_id or 0, r.error) for r in got) == [(0, 0), (1, 0), (1, 0)]
    assert codes.code_report(frame(spark, odd(8)), parts=4).collect() == []
    assert [r.vec_id for r in codes.code_report(frame(spark, [(1, [0.0] * 5, 0), (2, [0.0] * 8, 0)]), parts=4).collect()] == [2]


def test_decoded_vectors_are_near(spark):
    df = frame(spark, [(i, v, 0) for i, v in enumerate(vectors(200, 8))])
    coded, books = codes.compress(df, parts=4, entries=64)
    back = {r.id: r for r in codes.decoded(coded, books).collect()}
    for r in df.collect():
        d = np.floor(np.array(r.embedding) * 256) - np.array(back[r.vec_id].vector) * 256
        assert int((d * d).sum()) == back[r.vec_id].error


# ---- near-dedup


def brute_links(rows, cosine=0.95):
    """n_links and component ids by all pairs of usable vectors of a length."""
    usable = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for d in {len(rows[k][1]) for k in usable}:
        own = [k for k in usable if len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                links[own[a]].add(own[b])
    seen, out = set(), {}
    for k in links:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            seen |= group
            known = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                out[j] = (rows[j][0], len(links[j]), min(known) if known else None)
    return sorted(map(repr, out.values()))


def shown(df):
    return sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in df.collect())


def turned(base, other, angles):
    """Unit vectors at the angles (in degrees) from base towards other, which is at right angles to it."""
    return [(math.cos(math.radians(a)) * base + math.sin(math.radians(a)) * other).tolist() for a in angles]


def test_links_of_all_sorts(spark):
    """Copies, multiples, null and repeated ids, other lengths, vectors of nothing, a dense place and a sparse rest."""
    place = DRAW.normal(size=24)
    rows = [(i, (place + DRAW.normal(size=24) * 0.1).tolist()) for i in range(300)]
    rows += [(300 + i, v) for i, v in enumerate(vectors(200, 24))]
    rows += [(600 + i, (2.0 * np.array(rows[i][1])).tolist()) for i in (310, 311)]
    rows += [(i % 3 + 700, rows[320][1]) for i in range(9)] + [(None, rows[320][1]), (None, [1.0] * 24), (None, [1.0] * 24)]
    rows += [(800, [0.0] * 24), (801, [1.0, 2.0]), (802, [1.0, 2.1]), (803, [-1.0, -2.0])] + [(i, v) for i, v, _ in odd(24)]
    df = frame(spark, [(i, v, 0) for i, v in rows])
    got = embedding_dedup.near_groups(df)
    assert shown(got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect()) and got.first().recall == 1.0


def test_balls_that_link_in_part(spark):
    """Two dense places whose middles are as far apart as the threshold: some members link, some don't; and single vectors around."""
    base, other = np.eye(16)[0], np.eye(16)[1]
    spread = lambda a, n: [(np.array(v) + DRAW.normal(size=16) * 0.015).tolist() for v in turned(base, other, [a] * n)]
    rows = list(enumerate(spread(0, 700) + spread(18.5, 650) + spread(80, 60) + turned(base, other, [33, 36, 39, 100, 120]) + vectors(60, 16)))
    assert shown(embedding_dedup.near_groups(frame(spark, [(i, v, 0) for i, v in rows]))) == brute_links(rows)


def test_a_dense_chain_enlarges_lists(spark):
    base, other = np.eye(12)[2], np.eye(12)[5]
    rows = list(enumerate(turned(base, other, np.arange(0, 150, 1.1)) + vectors(50, 12)))
    assert shown(embedding_dedup.near_groups(frame(spark, [(i, v, 0) for i, v in rows]))) == brute_links(rows)


def test_near_groups_of_nothing(spark):
    assert embedding_dedup.near_groups(frame(spark, [])).collect() == []
    assert shown(embedding_dedup.near_groups(frame(spark, odd(4)))) == brute_links([(i, v) for i, v, _ in odd(4)])
    assert shown(embedding_dedup.near_groups(frame(spark, [(5, [1.0, 0.0], 0)]))) == ["(5, 0, 5)"]


def test_too_little_found_is_searched_again(spark, monkeypatch):
    """The audit makes the graph anew, with more of everything, until enough is found."""
    asked = []
    real = embedding_dedup._explored
    monkeypatch.setattr(embedding_dedup, "_explored", lambda classes, k, tables, theta: asked.append((k, tables)) or real(classes, k, tables, theta))
    monkeypatch.setattr(embedding_dedup, "_recall", lambda *a: 0.5 if len(asked) < 2 else 0.97)
    rows = [(i, v, 0) for i, v in enumerate(vectors(40, 6))]
    assert embedding_dedup.near_groups(frame(spark, rows)).first().recall == 0.97 and asked == [(16, 4), (32, 8)]


def test_recall_on_given_vectors(spark):
    """Vectors of the largest small table with near copies of every eighth: at least 0.95 of the links by brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = [(r.vec_id + 10_000 * (c + 1), (np.array(r.embedding) + DRAW.normal(size=64) * 0.02).tolist()) for r in df.where("vec_id % 8 = 0").collect() for c in range(3)]
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()] + near
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {int(k): int(n) for k, n, _ in (eval(x) for x in brute_links(rows))}
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.95 * sum(want.values()) > 1000
