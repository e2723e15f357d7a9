"""N-gram Jaccard join: rare shingles bring documents together, count-vector R-trees prune them, exact sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import BROADCAST_ROWS, discard, partitions, saved, scratch, sliced, small

WIDTH, SHARE = 5, 75
#: Bits of the shingle sketch, coordinates of a coarse count vector, points in a leaf.
SKETCH_BITS, GROUPS, LEAF = 24, 256, 16
#: Rows and bytes of sets in a piece of a group.
CHUNK, CHUNK_BYTES = 1000, 32 << 20
#: How often groups of several pieces are dealt anew at most before their components are set against one another.
ROUNDS = 2
#: Links that a task joins at a time before they are shuffled, and nodes of a small table of labels that a task takes.
JOINED, TASK_ROWS = 200_000, 50_000
#: A bucket of shingles goes on from a task if it holds two or more, and more than chance puts there; it counts as frequent from HOT on.
HOT = 12
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_DRAW = np.random.default_rng(20)
_BYTES, _PLACES = (_DRAW.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 4096))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of texts whose words are hashed at a time.
PIECE = 1 << 20


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and how many words each text has: sums of a byte's number times that of its place."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    letters = np.flatnonzero(~space)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.cumsum(_BYTES[data[letters]] * _PLACES[place & 4095] * ((place >> 12) * 2 + 1).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    at = np.cumsum(lengths)
    edges = np.cumsum([len(t) + 1 for t in texts])
    return _mix(sums[at] - sums[at - lengths] + lengths.astype(np.uint64)), np.diff(np.searchsorted(starts, edges, "right"), prepend=0)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes. Words end at ASCII white space; A-Z count as a-z; fewer words than `width` are one shingle."""
    out: list[np.ndarray] = []
    piece: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        piece.append((t or "").encode().lower())
        size += len(piece[-1])
        if size < PIECE and k < len(texts) - 1:
            continue
        h, counts = _word_hashes(piece)
        acc = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for j in range(width):
            acc = _mix(acc + h[j : j + len(acc)] * _FACTORS[j % len(_FACTORS)])
        at = 0
        for n in counts.tolist():
            if n >= width:
                one = np.sort(acc[at : at + n - width + 1])
                out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
            else:
                out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes(), n)] if n else [], np.uint64))
            at += n
        piece, size = [], 0
    return out


def required(n: int, share: int = SHARE) -> int:
    """Shingles that a partner of any size has in common with a set of n at least."""
    return -(-share * n // 100)


def count_vector(own: np.ndarray) -> np.ndarray:
    """Counts of the set's shingles by their last bits, as bytes: a coordinate for two shingles, GROUPS at least. 255 stands for that or more."""
    groups = groups_of(len(own))
    return np.minimum(np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def folded(vector: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A count vector with fewer coordinates."""
    return np.minimum(vector.reshape(-1, groups).sum(0, dtype=np.int64), 255).astype(np.uint8)


#: Stands for a count that a byte could not hold; bounds the counts of sets of that size at most.
FULL = 16_000


def groups_of(n: int) -> int:
    """Coordinates of the count vector of a set of n: one for two shingles, GROUPS at least, 32,768 at most."""
    groups = GROUPS
    while groups * 2 < n and groups < 1 << 15:
        groups *= 2
    return groups


def packed(vector: np.ndarray) -> bytes:
    """A count vector in half bytes if all its counts fit them, else as it is."""
    return (vector[::2] | (vector[1::2] << 4)).tobytes() if vector.max(initial=0) < 16 else vector.tobytes()


def unpacked(row: bytes, n: int) -> np.ndarray:
    """The count vector of a set of n shingles from its packed form."""
    v = np.frombuffer(row, np.uint8)
    return v if len(v) == groups_of(n) else np.stack([v & 15, v >> 4], 1).reshape(-1)


def coarse(vectors: list[np.ndarray]) -> np.ndarray:
    """The vectors with GROUPS coordinates each, as one matrix; FULL where a count is not known."""
    v = np.stack([folded(x) for x in vectors]) if vectors else np.zeros((0, GROUPS), np.uint8)
    return np.where(v == 255, np.int16(FULL), v.astype(np.int16))


def may_link_pair(x: np.ndarray, a_size: int, y: np.ndarray, b_size: int, share: int = SHARE) -> bool:
    """As may_link() for two count vectors, by as many coordinates as the shorter has; counts beyond a byte rule nothing out."""
    if len(x) != len(y):
        x, y = (folded(v, min(len(x), len(y))) for v in (x, y))
    least = np.minimum(x, y)
    return bool(int(least.sum()) * (100 + share) >= share * (a_size + b_size) or least.max() == 255)


def may_link(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Whether the count vectors allow intersection / union of share / 100: no more is shared than the sum of the smaller counts.

    Counts of sets in `a` of more than FULL may be above it, so where both sides are full nothing is ruled out.
    """
    least = np.minimum(a, b)
    ok = least.sum(-1, dtype=np.int64) * (100 + share) >= share * (a_sizes + b_sizes)
    large = np.asarray(a_sizes) > FULL
    return ok | (large & (least == FULL).any(-1)) if large.any() else ok


class RTree:
    """Count vectors in nested boxes: each box knows the greatest count in every coordinate and its smallest and largest set.

    The sum of the smaller counts with a box's greatest counts bounds what any of its points shares with a query. Boxes come
    from halving the points along the widest coordinate, or their sizes if those spread more.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.order, self.leaf, self.boxes = np.arange(len(vectors)), leaf, {}
        todo = [(0, len(vectors))] if len(vectors) else []
        while todo:
            a, b = todo.pop()
            own, n = vectors[self.order[a:b]], sizes[self.order[a:b]]
            top = own.max(0)
            self.boxes[a, b] = (top, n.min(), n.max())
            if b - a > leaf:
                spread, mid = top - own.min(0), (b - a) // 2
                by = n if n.max() - n.min() > spread.max() else own[:, int(spread.argmax())]
                self.order[a:b] = self.order[a:b][np.argpartition(by, mid)]
                todo += [(a, a + mid), (a + mid, b)]
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]

    def near(self, vectors: np.ndarray, sizes: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs that the bounds and the sizes don't rule out."""
        todo, out = [(0, len(self.order), np.arange(len(vectors)))] if len(self.order) else [], []
        while todo:
            a, b, q = todo.pop()
            top, low, high = self.boxes[a, b]
            q = q[(high * 100 >= share * sizes[q]) & (sizes[q] * 100 >= share * low)]
            q = q[may_link(vectors[q], sizes[q], top, low, share)]
            if not len(q):
                continue
            if b - a > self.leaf:
                mid = a + (b - a) // 2
                todo += [(a, mid, q), (mid, b, q)]
                continue
            n, m = self.sizes[a:b], sizes[q][:, None]
            x, y = np.nonzero((n * 100 >= share * m) & (m * 100 >= share * n))
            ok = may_link(vectors[q[x]], sizes[q[x]], self.vectors[a + y], self.sizes[a + y], share)
            out.append((q[x[ok]], self.order[a + y[ok]]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _summaries(docs: DataFrame, width: int, sketch_bits: int) -> DataFrame:
    """key, n, s1, s2 (128 bits of the set) for each row; a task's last row has its frequent shingle buckets and their counts instead."""

    def run(batches):
        counts = np.zeros(1 << sketch_bits, np.uint32)
        names = ["key", "n", "s1", "s2", "buckets", "counts"]
        for b in sliced(batches):
            n, s1, s2 = [], [], []
            sets = shingle_sets(b.column(1).to_pylist(), width)
            for own in sets:
                h = xxhash.xxh3_128_intdigest(own.tobytes())
                n.append(len(own))
                s1.append((h >> 64) - (1 << 63))
                s2.append((h & (1 << 64) - 1) - (1 << 63))
            np.add.at(counts, (np.concatenate([*sets, np.zeros(0, np.uint64)]) >> np.uint64(64 - sketch_bits)).astype(np.int64), 1)
            none = pa.nulls(b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n, s1, s2)), none, none], names)
        mean = counts.mean()
        top = np.flatnonzero(counts >= max(2, np.ceil(mean + 4 * np.sqrt(mean))))
        if len(top):
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array([x], pa.list_(pa.int64())) for x in (top, counts[top].astype(np.int64))], names)

    return docs.mapInArrow(run, "key long, n long, s1 long, s2 long, buckets array<long>, counts array<long>")


def _ranks(told: DataFrame, sketch_bits: int) -> np.ndarray:
    """The order class of each bucket: 0, or the binary logarithm of its count if it is frequent. The driver gets 5 bytes a bucket at most."""
    sums = told.where("buckets IS NOT NULL").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("b")).agg(F.sum("x.counts").alias("c"))
    sums = saved(sums, "buckets")
    least = HOT + 4 * (sums.agg(F.sum("c")).first()[0] or 0) / (1 << sketch_bits)

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype(np.uint32).tobytes()]), pa.array([b.column(1).to_numpy().astype(np.uint8).tobytes()])], ["b", "r"])

    ranks = np.zeros(1 << sketch_bits, np.uint8)
    for r in sums.where(F.col("c") >= least).select("b", F.floor(F.log2("c")).cast("int")).mapInArrow(pack, "b binary, r binary").collect():
        ranks[np.frombuffer(r["b"], np.uint32)] = np.frombuffer(r["r"], np.uint8)
    return ranks


def _prefixes(docs: DataFrame, ranks, width: int, share: int, sketch_bits: int) -> DataFrame:
    """node, n, vector (packed) and tokens: the rarest shingles of the set, as many as any partner must share one of."""

    def run(batches):
        table = ranks.value
        for b in sliced(batches):
            keys, sizes, vectors, out = [], [], [], []
            for i, own in enumerate(shingle_sets(b.column(1).to_pylist(), width)):
                if len(own):
                    order = np.argsort(table[(own >> np.uint64(64 - sketch_bits)).astype(np.int64)], kind="stable")
                    keys.append(i)
                    sizes.append(len(own))
                    vectors.append(packed(count_vector(own)))
                    out.append(_mix(own[order[: len(own) - required(len(own), share) + 1]]).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary()), lists], ["node", "n", "vector", "tokens"])

    return docs.mapInArrow(run, "node long, n long, vector binary, tokens array<long>")


#: What tells a task's block, and a row's part in it: 0 is in the tree, 1 asks it, 2 does both.
TASK = ["leader", "i", "j"]
_SEAT = "leader long, i int, j int, side int, node long, label long, n long"


def _blocks(batches, solve):
    """solve(rows) of each block of rows with the same leader, i and j, which stand together in the batches."""
    at, rows = None, []
    for b in sliced(batches):
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:3] != at:
                yield solve(rows) if len(rows) > 1 else []
                at, rows = r[:3], []
            rows.append(r)
    yield solve(rows) if len(rows) > 1 else []


def _near(rows: list[tuple], vectors: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (asking, asked) in a block of pairs with different labels whose count vectors may link, each pair once."""
    side, label, size = (np.array([r[k] for r in rows], np.int64) for k in (3, 5, 6))
    own, asking = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    q, x = RTree(vectors[own], size[own]).near(vectors[asking], size[asking], share)
    q, x = asking[q], own[x]
    ok = (label[q] != label[x]) & ((q < x) | (side[q] != 2))
    return q[ok], x[ok]


def _seated(seats: DataFrame, rows: DataFrame, value: str, solve, schema: str, names: list[str]) -> DataFrame:
    """Rows that solve() gives for each block of seats, joined with the value of their node."""
    both = seats.join(rows, "node").select(*TASK, "side", "node", "label", "n", value)
    dealt = both.repartition(partitions(seats.sparkSession), *TASK).sortWithinPartitions(*TASK)

    def run(batches):
        types = [f.split()[1] for f in schema.split(", ")]
        arrow = {"long": pa.int64(), "int": pa.int32()}
        found: list[tuple] = []
        for own in _blocks(batches, solve):
            found += own
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*found), types)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*found), types)], names)

    return dealt.mapInArrow(run, schema)


def _root(parent: dict[int, int], x: int) -> int:
    """The root of x in a union-find, whose paths are shortened on the way."""
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def _live(seats: DataFrame, vectors: DataFrame, share: int) -> DataFrame:
    """The seats that have, in their block, a partner of another label which sizes and count vectors don't rule out."""

    def solve(rows: list[tuple]) -> list[tuple]:
        fine = [unpacked(r[7], r[6]) for r in rows]
        live = [False] * len(rows)
        for a, b in zip(*(x.tolist() for x in _near(rows, coarse(fine), share))):
            if not (live[a] and live[b]) and may_link_pair(fine[a], rows[a][6], fine[b], rows[b][6], share):
                live[a] = live[b] = True
        return [r[:7] for r, x in zip(rows, live) if x]

    return _seated(seats, vectors, "vector", solve, _SEAT, [f.split()[0] for f in _SEAT.split(", ")])


def _linked(seats: DataFrame, docs: DataFrame, width: int, share: int) -> DataFrame:
    """Links a, b between seats of one block, by their exact sets; as many as it takes to join what links, no more than the block has rows."""

    def sets(batches):
        for b in sliced(batches):
            own = shingle_sets(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "own"])

    def solve(rows: list[tuple]) -> list[tuple]:
        own = [np.frombuffer(r[7], np.uint64) for r in rows]
        fine = [count_vector(x) for x in own]
        parent: dict[int, int] = {}
        root = lambda k: _root(parent, k)
        q, x = _near(rows, coarse(fine), share)
        order = np.argsort(q, kind="stable")
        q, x = q[order], x[order]
        edges = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), len(q)]
        out = []
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            a = int(q[start])
            mine = root(rows[a][5])
            others = [b for b in x[start:end].tolist() if root(rows[b][5]) != mine and may_link_pair(fine[a], len(own[a]), fine[b], len(own[b]), share)]
            for k in range(0, len(others), 64):
                some = [b for b in others[k : k + 64] if root(rows[b][5]) != root(rows[a][5])]
                if not some:
                    continue
                parts = [own[b] for b in some]
                flat = np.concatenate(parts)
                at = np.minimum(np.searchsorted(own[a], flat), len(own[a]) - 1)
                shared = np.add.reduceat((own[a][at] == flat).astype(np.int64), np.cumsum([0, *(len(p) for p in parts[:-1])]))
                for b, both in zip(some, shared.tolist()):
                    if both * (100 + share) >= share * (len(own[a]) + len(own[b])) and root(rows[a][5]) != root(rows[b][5]):
                        parent[root(rows[a][5])] = root(rows[b][5])
                        out.append((rows[a][4], rows[b][4]))
        return out

    wanted = saved(seats.select("node").distinct(), "wanted")
    own = docs.join(small(wanted), docs["key"] == wanted["node"], "left_semi").select("key", "text").mapInArrow(sets, "node long, own binary")
    links = saved(_seated(seats, own, "own", solve, "a long, b long", ["a", "b"]), "links")
    discard(wanted)
    return links


def _slots(count: str, shingles: str, chunk: int):
    """Into how many pieces a group's rows go, so that a piece has about `chunk` rows and CHUNK_BYTES of sets."""
    return F.greatest(F.ceil(F.col(count) / chunk), F.ceil(F.col(shingles) * 8 / CHUNK_BYTES), F.lit(1)).cast("int")


def _within(groups: DataFrame, seed: int) -> DataFrame:
    """Seats for the members of each group (leader, node, n, label, p) in p pieces, each piece against itself; the leader sits in all."""
    all_ = F.sequence(F.lit(0), F.col("p") - 1)
    place = F.explode(F.when(F.col("node") == F.col("leader"), all_).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(seed)), F.col("p")).cast("int")))).alias("i")
    return groups.select("leader", place, "node", "n", "label").select("leader", "i", F.col("i").alias("j"), F.lit(2).alias("side"), "node", "label", "n")


def _majors(groups: DataFrame, chunk: int) -> DataFrame:
    """For each group (leader): the label with the most rows, into how many pieces its rows go (mp), and those of all others (op)."""
    sizes = groups.groupBy("leader", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    top = sizes.groupBy("leader").agg(F.max(F.struct("c", "label", "s")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    top = top.select("leader", F.col("top.label").alias("major"), F.col("top.c").alias("mc"), F.col("top.s").alias("ms"), (F.col("c") - F.col("top.c")).alias("oc"), (F.col("s") - F.col("top.s")).alias("os"))
    return top.select("leader", "major", _slots("mc", "ms", chunk).alias("mp"), _slots("oc", "os", chunk).alias("op"), (F.col("oc") > 0).alias("mixed"))


def _across(rows: DataFrame) -> DataFrame:
    """Seats for groups with several labels and their _majors(): the label with the most rows against the others, and those against one another, piece by piece."""
    rows = rows.withColumn("is_major", F.col("label") == F.col("major"))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cols = ["leader", "i", "j", "side", "node", "label", "n"]
    major = rows.where("is_major").select("*", slot("mp").alias("i"), F.explode(upto("op")).alias("j"), F.lit(0).alias("side"))
    other = rows.where("NOT is_major").withColumn("own", slot("op"))
    asking = other.select("*", F.explode(upto("mp")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    o, own = F.col("o"), F.col("own")
    inner = other.select("*", F.explode(upto("op")).alias("o")).select("*", (-1 - F.least(own, o)).alias("i"), F.greatest(own, o).alias("j"), F.when(own == o, 2).when(own < o, 0).otherwise(1).alias("side"))
    return major.select(cols).unionByName(asking.select(cols)).unionByName(inner.select(cols))


def _labelled(groups: DataFrame, labels: DataFrame, chunk: int) -> DataFrame:
    """The groups that still hold several components, with the component of each node as its label and the group's _majors()."""
    own = groups.drop("label").join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = saved(own, "labelled")
    majors = saved(_majors(own, chunk).where("mixed").drop("mixed"), "majors")
    return own.join(small(majors), "leader")


def _stars(links: DataFrame) -> DataFrame:
    """Links a, b that join what links (a, b) join, but straight to the least of the nodes that are joined within a task; no more than there were."""

    def run(batches):
        parent: dict[int, int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([_root(parent, x) for x in parent], list(parent))], ["a", "b"])

        for batch in batches:
            for b in sliced([batch], 10_000):
                for x, y in zip(*(c.to_pylist() for c in b.columns)):
                    x, y = _root(parent, x), _root(parent, y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                if len(parent) >= JOINED:
                    yield told()
                    parent.clear()
        if parent:
            yield told()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that is reachable, for each node of the links (a, b).

    Each task first joins what its links join, so that chains become stars and rounds are few. Each round takes the smallest
    label among a node and its neighbours (a join that Spark may split where a node is hot, and an aggregate with a partial
    step), then the label's own label; it ends when no label changes. Few labels are broadcast, so that a round shuffles once,
    and go to no more tasks than they need.
    """
    links = saved(_stars(links), "links")
    most = 2 * links.count()
    few = F.broadcast if most <= BROADCAST_ROWS else lambda df: df
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-most // TASK_ROWS))
    edges = links.union(links.select("b", "a"))
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")).coalesce(tasks), "labels")
    while True:
        around = edges.join(few(labels), edges["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        best = around.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        roots = few(labels.select(F.col("node").alias("root"), F.col("label").alias("further")))
        after = saved(best.join(roots, best["label"] == roots["root"], "left").select("node", "old", F.least("label", "further").alias("label")).coalesce(tasks), "labels")
        done = after.where("label != old").isEmpty()
        if done:
            return after.select("node", "label")
        labels = after.select("node", "label")


def _numbered(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of key and text with a key of their own, and key and id of each row where the ids are not such keys themselves.

    Ids that are null or stand in several rows are replaced by numbers, in a written copy of the table.
    """
    ids = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    if ids.groupBy("key").count().where("count > 1 OR key IS NULL").isEmpty():
        return ids, None
    rows = saved(ids.select(F.monotonically_increasing_id().alias("row"), F.col("key").alias("id"), "text"), "numbered")
    return rows.select(F.col("row").alias("key"), "text"), rows.select(F.col("row").alias("key"), "id")


def _links(docs: DataFrame, first: DataFrame, ranks, width: int, share: int, chunk: int, sketch_bits: int) -> DataFrame:
    """Links a, b that join the keys of distinct sets, those of `first`, into their components, and no others."""
    prefixes = saved(_prefixes(first, ranks, width, share, sketch_bits), "prefixes")
    tokens = prefixes.select("node", F.explode("tokens").alias("token"))
    least = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))
    blocks = saved(tokens.groupBy("token").agg(least["node"].alias("leader"), F.count("*").alias("c")).where("c > 1").select("token", "leader"), "blocks")
    pairs = saved(tokens.join(blocks, "token").select("leader", "node").distinct(), "pairs")
    discard(blocks)
    groups = saved(pairs.join(prefixes.select("node", "n"), "node").select("leader", "node", "n"), "groups")
    discard(pairs)
    sizes = saved(groups.groupBy("leader").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("leader", _slots("c", "s", chunk).alias("p")), "sizes")
    vectors = prefixes.select("node", "vector")

    def solved(seats: DataFrame) -> DataFrame:
        seats = saved(seats, "seats")
        live = saved(_live(seats, vectors, share), "live")
        found = _linked(live, docs, width, share)
        discard(seats, live)
        return found

    # Every member has its own label at first, so a group of one piece is done after this.
    links = solved(_within(groups.join(sizes, "leader").withColumn("label", F.col("node")), 0))
    large = saved(groups.join(sizes.where("p > 1"), "leader"), "large")
    discard(groups, sizes)
    for k in range(ROUNDS + 1):
        if large.isEmpty():
            break
        labels = components(links)
        links = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
        large = _labelled(large, labels, chunk)
        # A group whose other components fill one piece is done once they are set against its largest; dealing it anew saves nothing.
        last = F.lit(k == ROUNDS) | (F.col("op") == 1)
        links = links.union(solved(_across(large.where(last)).unionByName(_within(large.where(~last), k + 1))))
        large = large.where(~last).drop("major", "mp", "op")
    discard(prefixes)
    return links


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = SHARE, chunk: int = CHUNK, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two rows link when 100 * |A and B| >= share * |A or B| for their sets of distinct `width`-word shingles; words end
    at ASCII white space and A-Z count as a-z. A text with fewer words is one shingle; one without words (or null) has an
    empty set and no links. Ids are integers; rows that share an id are one node with the links of each; a row with a
    null id is a node of its own after all others, whose component_id is null if it reaches no id. Other columns are
    ignored. An empty table gives no rows.

    No link is lost: linked sets share a shingle among the first n - ceil(share * n / 100) + 1 of each in one global
    order, whatever that order is. It puts frequent shingles last, by a sketch of bounded size, so that common passages
    don't bring documents together. Equal sets become one node first. Of the nodes with a common prefix shingle the one
    with the least hash is the leader; each leader's group, with all shingles that it leads, goes to tasks in pieces of
    bounded size. There the count-vector R-tree rules out pairs, exact sets decide the others, and a union-find keeps no
    more links than a piece has rows. Only groups of several pieces go on: dealt anew a few times at most, so that copies
    become one component, then the remaining components of each against one another. Pairs are never listed as rows.
    """
    spark = df.sparkSession
    with scratch() as keep:
        docs, ids = _numbered(df, id_col, text_col)
        told = saved(_summaries(docs, width, sketch_bits), "shingle-sums")
        rows = told.where("key IS NOT NULL").select("key", "n", "s1", "s2")
        classes = saved(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("node")), "shingle-classes")
        ranks = spark.sparkContext.broadcast(_ranks(told, sketch_bits))
        copies = saved(rows.where("n > 0").select("key").join(classes, F.col("key") == F.col("node"), "left_anti"), "copies")
        links = _links(docs, docs.join(small(copies), "key", "left_anti"), ranks, width, share, chunk, sketch_bits)
        out = rows.withColumn("id", F.col("key")) if ids is None else rows.join(ids, "key")
        if ids is not None:  # an id's rows are one node: the first of their sets links with the others
            same = out.where("n > 0 AND id IS NOT NULL").join(classes, ["s1", "s2"])
            links = links.union(same.join(same.groupBy("id").agg(F.min("node").alias("a")), "id").where("node != a").select("a", F.col("node").alias("b")))
        ends = components(links).select(F.col("node").alias("own"), F.col("label").alias("component"))
        known = saved(classes.join(ends, classes["node"] == ends["own"], "left").select("s1", "s2", F.coalesce("component", "node").alias("component")), "known")
        out = out.join(known, ["s1", "s2"], "left").select("id", "n", "component")
        if ids is None:
            keep(told, known)
        else:  # labels are keys here: a component is named by its least id, and all rows of an id go with it
            out = saved(out, "named")
            least = out.where("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("id").alias("least"))
            named = out.join(least, out["component"] == least["c"], "left").select("id", "n", F.coalesce("least", "id").alias("component"))
            each = saved(named.where("id IS NOT NULL").groupBy(F.col("id").alias("own")).agg(F.min("component").alias("best")), "best")
            out = saved(named.join(each, named["id"] == each["own"], "left").select("id", "n", F.coalesce("best", "component").alias("component")), "named")
            keep(out)
    whole = lambda c: c.cast(df.schema[id_col].dataType)
    return out.select(whole(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), whole(F.coalesce("component", "id")).alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each component, that of the smallest id (all rows that tie on it); rows without words or with a null id stay."""
    with scratch() as keep:
        groups = similar_groups(df, id_col, text_col, **options)
        keep(gone := saved(groups.where(F.col(id_col).isNotNull() & (F.col(id_col) != F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct(), "near-copies"))
    return df.join(small(gone), df[id_col] == gone["__gone"], "left_anti")
