"""Lines that many documents share, dropped everywhere but in one.

Each document's lines are hashed (128 bits); the hashes are dealt out by range
and sorted by hash, then document from the largest down, then row.  A stream
over each range sees a line's documents one after the other, the one that may
keep it first, and holds back at most the few rows that don't yet make the
line common.  A hash whose rows end at the edge of a range is decided by the
sum of the ranges' counts, at most two for each range.  What leaves a range is
the places of dropped lines, never text; a document's places become a
compressed bitmap.

Every row is a document.  Null ids are below all others; null and empty texts
are one empty line.  Repeated rows count each, and all keep a line together
if theirs is the largest id that holds it.  An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._ranges import ranges
from ._tables import forget, written
from ._text import SPACES, free_name

MIN_CHARS = 40
MIN_DOCS = 5
#: Hashes in a range, about.
ROWS = 500_000

RECORD = "h1 long, h2 long, doc long, row long, n int, at array<int>"
#: What a record that leaves a range is.
DROPPED, AT_EDGE, COUNT = 0, 1, 2


def _identity(docs: DataFrame, doc: str, text: str) -> list:
    """Columns that name a row: its id, the least number for null, and its text's hash."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(t).alias("row"), t.alias("t")]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a lower-cased line, or None where it is too short to have one."""
    key = line.strip(SPACES)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            copies: dict[tuple, list] = {}
            for i, who in enumerate(zip(docs.tolist(), rows.tolist(), strict=True)):
                copies.setdefault(who, [i, 0])[1] += 1
            keys, owner, number, where, sizes = [], [], [], [], [0]
            for i, n in copies.values():
                found: dict[bytes, list[int]] = {}
                for j, line in enumerate(batch.column(2)[i].as_buffer().to_pybytes().lower().split(b"\n")):
                    key = line_key(line, min_chars)
                    if key is not None:
                        found.setdefault(key, []).append(j)
                for key, at in found.items():
                    keys.append(key)
                    where += at
                    sizes.append(len(where))
                owner += [i] * len(found)
                number += [n] * len(found)
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            own = np.array(owner, np.int64)
            at = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(where, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs[own]), pa.array(rows[own]), pa.array(number, pa.int32()), at], names=["h1", "h2", "doc", "row", "n", "at"])

    return run


def _sifted(need: int):
    """Streams a sorted range; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = count = top = None
        leading = True  # whether the key is the range's first
        held: list[pa.RecordBatch] = []

        def tagged(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, kind, np.int32)), *batch.columns], names=["kind", *batch.schema.names])

        def summary() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
            made = [pa.array([v], k) for v, k in zip((COUNT, *key, top, count, 0, None), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(made, names=["kind", "h1", "h2", "doc", "row", "n", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, row, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(new))
            run_of = np.cumsum(new) - 1
            totals, tops = np.add.reduceat(n.astype(np.int64), starts), doc[starts].copy()
            same = key == (int(h1[0]), int(h2[0]))
            if same:
                totals[0] += count
                tops[0] = top
            elif key is not None:
                if leading:
                    yield summary()
                leading, held = False, []
            repeat = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1])])
            loses = (doc != tops[run_of]) & ~repeat
            drop = loses & (totals >= need)[run_of]
            last = np.zeros(len(new), bool)
            last[starts[-1] :] = True
            if leading:  # its documents may have begun in an earlier range
                drop[: ends[0]] = False
                yield tagged(batch.slice(0, int(ends[0])), AT_EDGE)
            elif same and totals[0] >= need:
                yield from (tagged(b, DROPPED) for b in held)
                held = []
            if drop.any():
                yield tagged(batch.take(pa.array(np.flatnonzero(drop))), DROPPED)
            if len(starts) > 1:
                if leading:
                    key, count, top = (int(h1[0]), int(h2[0])), int(totals[0]), int(tops[0])
                    yield summary()
                leading, held = False, []
            key, count, top = (int(h1[-1]), int(h2[-1])), int(totals[-1]), int(tops[-1])
            if not leading and count < need:
                held.append(batch.take(pa.array(np.flatnonzero(loses & last))))
        if key is not None:
            yield from (tagged(b, AT_EDGE) for b in held)
            yield summary()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, maps = [], []
        for at in batch.column(2).to_pylist():
            lines = np.unique(np.array(at, np.int64))
            keep = np.ones((int(lines[-1]) // 8 + 1) * 8, bool)
            keep[lines] = False
            counts.append(len(lines))
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "row", "n", "keep"])


def bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, n, keep) of each document that loses lines: its id, its text's hash, how many lines go, and a zlib-compressed bitmap of those that stay.

    Bits count from the least of each byte; lines past the bitmap's end stay.
    """
    lines = written(docs.select(*_identity(docs, doc, text)).mapInArrow(_hashed(min_chars), RECORD), "lines")
    order = [F.asc("h1"), F.asc("h2"), F.desc("doc"), F.asc("row")]
    sifted = written(ranges(lines, *order, rows=ROWS).mapInArrow(_sifted(min_docs), "kind int, h1 long, h2 long, doc long, row long, n int, at array<int>"), "sifted")
    forget(lines)
    edges = sifted.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("row").alias("total"), F.max("doc").alias("top"))  # counts stand in row
    late = sifted.where(F.col("kind") == AT_EDGE).join(F.broadcast(edges), ["h1", "h2"]).where((F.col("total") >= min_docs) & (F.col("doc") < F.col("top")))
    gone = sifted.where(F.col("kind") == DROPPED).select("doc", "row", "at").union(late.select("doc", "row", "at"))
    each = gone.groupBy("doc", "row").agg(F.flatten(F.collect_list("at")).alias("at"))  # a document's own lines
    out = written(each.mapInArrow(_packed, "doc long, row long, n long, keep binary"), "bitmaps")
    forget(sifted)
    return out


def kept_lines(docs: DataFrame, maps: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, str, str]:
    """The documents with the lines that the bitmaps keep, and the names of two more columns: lines before, lines dropped.

    Other columns are carried along; null texts become empty.
    """
    n_lines, n_dropped = free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns)
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text)
    carried = docs.select(*_identity(docs, doc, text)[:2], *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    joined = carried.join(maps.select("doc", "row", "keep"), ["doc", "row"], "left").select(*names, "keep")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, lost = [], [], []
            for t, keep in zip(batch.column(place), batch.column(len(names)), strict=True):
                if t.is_valid and keep.is_valid:
                    lines = t.as_py().split("\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), bitorder="little")
                    stay = [line for line, b in zip(lines, bits, strict=False) if b] + lines[len(bits) :]
                    texts.append("\n".join(stay))
                    before.append(len(lines))
                    lost.append(len(lines) - len(stay))
                else:
                    texts.append(t.as_py() or "")
                    before.append(texts[-1].count("\n") + 1)
                    lost.append(0)
            cols = list(batch.columns[: len(names)])
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(lost, pa.int64())], names=[*names, "before", "lost"])

    fields = [T.StructField(f.name, T.StringType()) if i == place else f for i, f in enumerate(carried.schema.fields[2:])]
    out = joined.mapInArrow(rebuild, T.StructType([*fields, T.StructField("before", T.LongType()), T.StructField("lost", T.LongType())]))
    return out.toDF(*docs.columns, n_lines, n_dropped), n_lines, n_dropped


def digest(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out, _, _ = kept_lines(docs, bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
