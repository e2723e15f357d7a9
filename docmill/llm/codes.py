"""Vector code compression: product codes by integer codebooks that are learnt from all vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import saved, scratch, small
from docmill.llm.vectors import components, scaled, squared_distances, sums_of, unpacked, packed, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose distances are worked out at a time.
ROWS = 1024


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of parts (rows, parts, length) the nearest entry of each part's codebook (parts, entries, length), the first of equals, and the squared distances."""
    at, far = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for start in range(0, len(x), ROWS):
        for p in range(x.shape[1]):
            d = squared_distances(x[start : start + ROWS, p], books[p])
            at[start : start + ROWS, p] = best = d.argmin(1)
            far[start : start + ROWS, p] = d[np.arange(len(d)), best]
    return at, far


def _integers(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, dims: int, scale: int) -> DataFrame:
    """id, label, ints (the packed integers) of the vectors of df."""

    def run(batches):
        for b in batches:
            x = scaled(components(b.column(2), dims), scale, dims)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(row) for row in x], pa.binary())], ["id", "label", "ints"])

    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, ints binary")


def _matrix(column: pa.Array, dims: int, parts: int) -> np.ndarray:
    rows = [unpacked(r, dims) for r in column.to_pylist()]
    return np.concatenate([*rows, np.zeros((0, dims), np.int64)]).reshape(-1, parts, dims // parts)


def _refined(ints: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after a round. Each task adds up what it assigns to each entry; a shuffle by (part, entry) merges the sums of all tasks."""
    parts, entries, width = books.shape
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims, parts)
            at = (nearest(x, shared.value)[0] + np.arange(parts) * entries).reshape(-1)
            n += np.bincount(at, minlength=parts * entries)
            np.add.at(sums, at, x.reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used // entries), pa.array(used % entries), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = sums_of(ints.select("ints").mapInArrow(run, "part long, entry long, n long, sums array<long>"), ["part", "entry"], width)
    out = books.copy()
    for (p, e), (n, sums) in found.items():
        out[p, e] = [s // n for s in sums]
    shared.unpersist()
    return out


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) for each vector, and the codebooks (part, entry, position).

    A component x becomes floor(scale * x); a vector is cut into `parts` equal parts. The codebook of a part starts as that
    part of the vectors of the smallest ids (`entries` of them, or as many as there are); each round assigns every part to
    the nearest entry (squared distance, the first of equals) and moves the entries that are used to the floor of their
    parts' means. A code has a byte for each part (`entries` is 256 at most), the error is the sum of its squared distances.

    Rows whose vector is null or holds a null or non-finite component fall out, as do vectors that can't be cut into equal parts
    (empty ones too). Of those that can, the smallest id's length counts; vectors of another length have no parts to compare with
    and fall out. Of rows with one id each has its own code; at the start equal ids go by their vectors, null ids after all others. A null label is a
    label. Other columns are ignored. A table without vectors gives no rows and codebooks without entries. Components
    so large that squared distances don't fit 64 bits are an error.

    The integers are written once; each round reads them, and `parts` * `entries` rows of a task at most reach the shuffle.
    Codebooks are all that the driver holds.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: entries must be from 1 to 256")
    n = F.size(vector_col)
    good = df.where(whole(F.col(vector_col)) & (n > 0) & (n % parts == 0))
    order = [F.asc_nulls_last(id_col), F.col(vector_col)]
    first = good.orderBy(*order).select(n).first()
    dims = first[0] if first else parts
    good = good.where(n == dims)
    start = [r[0] for r in good.orderBy(*order).limit(entries).select(F.col(vector_col).cast("array<double>")).collect()]
    books = scaled(np.array(start, np.float64).reshape(-1, dims), scale, dims).reshape(-1, parts, dims // parts).transpose(1, 0, 2)
    ints = saved(_integers(good, id_col, vector_col, label_col, dims, scale), "integers")
    for _ in range(rounds if len(start) else 0):
        books = _refined(ints, books, dims)
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            at, far = nearest(_matrix(b.column(2), dims, parts), shared.value)
            text = at.astype(np.uint8).tobytes().hex()
            codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(far.sum(1))], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in ints.schema.fields}
    return ints.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), books


def digest(books: np.ndarray) -> str:
    """The sha256 of all entries' components by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def code_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """id, code (hexadecimal), error, label_error (the error of all rows of the same label, null being one) and codebooks_sha256 for each vector of compress().

    Errors are added up by label with a partial step in each task; their rows are joined back, broadcast if they are few.
    """
    with scratch() as keep:
        coded, books = compress(df, id_col, vector_col, label_col, **options)
        keep(rows := saved(coded, "codes"))
        keep(sums := saved(rows.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")), "label-errors"))
    joined = rows.join(small(sums), rows["label"].eqNullSafe(sums["own"]))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def decoded(df: DataFrame, books: np.ndarray, code_col: str = "code", out_col: str = "vector", scale: int = SCALE) -> DataFrame:
    """df with the vectors that its codes stand for: the codebooks' entries divided by `scale`. A null code has no vector."""
    shared = df.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<double>")
    def run(codes):
        table = shared.value
        return codes.map(lambda c: None if c is None else (np.concatenate([table[p, e] for p, e in enumerate(bytes.fromhex(c))]) / scale).tolist())

    return df.withColumn(out_col, run(F.col(code_col)))
