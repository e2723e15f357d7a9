"""Long texts in chunks of paragraphs or sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 4000
#: Bytes of text that a worker holds as Python strings at a time; a longer text is gone through by itself.
SLICE = 2 << 20


def _pieces(text: str, most: int) -> Iterator[tuple[str, str, bool]]:
    """Paragraphs, or the sentences and lines of one that is too long: the piece, what joins it to the chunk before, and whether it starts a chunk of its own."""
    size = 0
    for para in text.split("\n\n"):
        if len(para) > most and size + len(para) + 2 > most:
            for k, piece in enumerate(para.replace(". ", ".\n").split("\n")):
                size = yield piece, " ", k == 0
        else:
            size = yield para, "\n\n", False


def cut(text: str | None, most: int = MAX_CHARS) -> list[str]:
    """The chunks of a text, in order: its pieces are gone through once, and a chunk is joined when it is full.

    A text of at most `most` characters is one chunk. A longer one is packed by paragraphs (blank lines between them);
    a paragraph that is too long is packed by sentences and lines, and its last part stays open for what follows. A
    sentence longer than `most` isn't cut. Chunks are stripped; if nothing is left, the text's start is the one chunk.
    """
    text = text or ""
    if len(text) <= most:
        return [text]
    done: list[str] = []
    held: list[str] = []  # the open chunk in parts, with what joins them
    size = 0

    def close() -> None:
        nonlocal held, size
        if size:
            done.append("".join(held).strip())
        held, size = [], 0

    pieces = _pieces(text, most)
    step = next(pieces, None)
    while step is not None:
        piece, joiner, alone = step
        if alone or size + len(piece) + len(joiner) > most:
            close()
        if size:
            held += [joiner, piece]
            size += len(joiner) + len(piece)
        else:
            held, size = [piece], len(piece)
        try:
            step = pieces.send(size)
        except StopIteration:
            step = None
    if "".join(held).strip():
        close()
    return done or [text[:most]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut_all(texts: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([cut(t, int(m)) for t, m in zip(texts, most)])


def chunks(text: Column, most: int = MAX_CHARS) -> Column:
    """The chunks of a text, by cut(): an Arrow batch of texts at a time, in one pass over each text."""
    return _cut_all(text, F.lit(most))


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in order, in runs of rows that start within the same `most` bytes of a text column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    run = np.concatenate([[0], ends[:-1]]) // most
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def cut_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of the texts in the last column: the other columns, total_chunks, chunk_index, the chunk."""
    for b in batches:
        for part in slices(b, b.num_columns - 1, SLICE) if b.num_rows else ():
            own = [cut(t.as_py(), most) for t in part.column(part.num_columns - 1)]
            n = np.array([len(c) for c in own])
            rows = pa.array(np.repeat(np.arange(len(own)), n))
            index = np.concatenate([np.arange(k) for k in n])
            made = [pa.array(np.repeat(n, n), pa.int32()), pa.array(index, pa.int32()), pa.array([c for cs in own for c in cs], pa.string())]
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:-1]), *made], [*part.schema.names[:-1], "total_chunks", "chunk_index", part.schema.names[-1]])


def chunk_documents(df: DataFrame, id_col: str = "id", text_col: str = "texto", most: int = MAX_CHARS) -> DataFrame:
    """One row a chunk: id (with _c<index> where there are several), the chunk as text, chunk_index, total_chunks, other columns.

    A worker holds one Arrow batch, which Spark bounds in bytes, and beside it the texts and chunks of SLICE bytes.
    """
    rest = [c for c in df.columns if c not in (id_col, text_col, "chunk_index", "total_chunks")]
    rows = df.select(id_col, *rest, F.col(text_col).cast("string").alias(text_col))
    made = T.StructType([*rows.schema.fields[:-1], T.StructField("total_chunks", T.IntegerType()), T.StructField("chunk_index", T.IntegerType()), T.StructField(text_col, T.StringType())])
    rows = rows.mapInArrow(lambda batches: cut_batches(batches, most), made)
    key = F.col(id_col).cast("string")
    return rows.withColumn(id_col, F.when(F.col("total_chunks") > 1, F.concat_ws("_c", key, F.col("chunk_index"))).otherwise(key))
