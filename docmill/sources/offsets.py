"""A streaming source of JSON lines by byte offsets: files that grow are read on from where the last batch ended."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that a task reads.
SPLIT = 16 << 20


class _Span(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class GrowingLines(DataSource):
    """Rows of file, position (the byte where a line starts) and value, one for each finished line of the .jsonl files in the folder `path`.

    The offset of a batch is the length of each file up to its last finished line, so a line that is still being written waits; Spark keeps
    offsets in the query's checkpoint. A file that has become shorter than what was read of it was written anew and is read from its start. Folders on any file system that
    Arrow knows by the path's scheme; lines are read by ranges of SPLIT bytes, a line belonging to the range in which it starts.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def _files(self):
        system, folder = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        return system, {f.path: f.size for f in system.get_file_info(pafs.FileSelector(folder)) if f.is_file and f.path.endswith(".jsonl")}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, files = self._files()
        return {f: end for f, size in sorted(files.items()) if (end := self._finished(system, f, size))}

    def _finished(self, system, file: str, size: int) -> int:
        """Where the last finished line ends."""
        with system.open_input_file(file) as f:
            at = size
            while at > 0:
                start = max(0, at - (1 << 16))
                if (found := f.read_at(at - start, start).rfind(b"\n")) >= 0:
                    return start + found + 1
                at = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for file, last in end.items():
            first = start.get(file, 0)
            if last < first:
                first = 0
            out += [_Span(file, at, min(at + self.split, last)) for at in range(first, last, self.split)]
        return out

    def read(self, partition: _Span) -> Iterator[tuple]:
        system, _ = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        with io.BufferedReader(system.open_input_file(partition.file), 1 << 20) as f:
            at = partition.start
            if at > 0:  # the line that started before belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(0)
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                yield partition.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing is kept besides Spark's own checkpoint."""


def growing_lines(spark: SparkSession, path: str, split: int = SPLIT):
    """A stream of GrowingLines."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", path).option("split", str(split)).load()


def position_of(offset: str) -> dict[str, int]:
    """The bytes of each file that a query has read, from an offset of its progress."""
    return {k: int(v) for k, v in json.loads(offset).items()}
