"""Vectors of integers in Arrow batches, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: Column) -> Column:
    """Whether a vector is not null and has no component that is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def components(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists of `dims` numbers as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def scaled(x: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x). Squared distances of `dims` components must fit 62 bits, else an error says so."""
    y = np.floor(x * scale)
    most = int((2**62 // max(dims, 1)) ** 0.5) // 2
    if len(y) and np.abs(y).max(initial=0) > most:
        raise ValueError(f"a component times {scale} is beyond {most}: squared distances would not fit 64 bits")
    return y.astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """The matrix as bytes of the smallest integers that hold it, after a byte that says which."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or (not x.size or (x.min() >= -(1 << 8 * w - 1) and x.max() < 1 << 8 * w - 1)))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpacked(b: bytes, dims: int) -> np.ndarray:
    """A matrix of packed()."""
    return np.frombuffer(b, f"<i{b[0]}", offset=1).reshape(-1, dims).astype(np.int64)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres, exact: norms and one product of 64-bit integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]


def sums_of(df: DataFrame, keys: list[str], dims: int) -> dict[tuple, tuple[int, list[int]]]:
    """Rows of keys, n and sums (a list of `dims`) added up by the keys: for each key its n and its sums. The keys are few, by the caller's bound."""
    total = df.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(dims)))
    return {tuple(r[: len(keys)]): (r["n"], list(r[len(keys) + 1 :])) for r in total.collect()}
