"""A Spark data source for recordings: JSON lines of events, read in byte ranges.

``spark.dataSource.register(Recordings)``, then
``spark.read.format("recordings").load(folder)``.  Each task reads its range of
one file, from the first line that begins in it to the end of the last one
that does, so files of any size are read in parallel.  A line that isn't a
JSON object, or misses its recording, keeps its text in ``bad``.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "recording string, seq long, kind string, t long, x double, y double, bad string"
#: Bytes of a range, unless the option ``range_bytes`` says otherwise.
RANGE = 64 << 20
ROWS = 4_096
_ARROW = pa.schema([("recording", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("t", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("bad", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _files(path: str):
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where, at


def _whole(value) -> int | None:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) < 2**63 else None


def _real(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def parsed(line: bytes) -> tuple:
    """One line as a row of SCHEMA; numbers of another type are null."""
    try:
        e = json.loads(line)
        if not isinstance(e, dict) or not isinstance(e.get("recording"), str):
            raise ValueError
    except ValueError:
        return (None,) * 6 + (line.decode("utf-8", "replace"),)
    kind = e.get("kind", e.get("type"))
    return e["recording"], _whole(e.get("seq")), kind if isinstance(kind, str) else None, _whole(e.get("t")), _real(e.get("x")), _real(e.get("y")), None


class Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        where, at = _files(self.path)
        info = where.get_file_info(at)
        found = [info] if info.is_file else where.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))
        return [Range(p, i, min(i + self.size, n)) for p, n in files for i in range(0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        where, _ = _files(self.path)
        rows: list[tuple] = []
        with io.BufferedReader(where.open_input_file(partition.path)) as raw:
            raw.seek(max(partition.start - 1, 0))
            lines = raw.readline
            at = partition.start
            if partition.start:
                at = partition.start - 1 + len(lines())  # what is left of a line that began before
            while at < partition.end:
                line = lines()
                if not line:
                    break
                at += len(line)
                if line.strip():
                    rows.append(parsed(line.rstrip(b"\r\n")))
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        if "path" not in self.options:
            raise ValueError("recordings need a path")
        return Reader(self.options["path"], int(self.options.get("range_bytes", RANGE)))
