"""Vectorised text helpers that run inside Spark tasks.

A batch of texts is one byte buffer with offsets.  Tokens are found, hashed and
combined by numpy over the whole buffer; no Python loop runs over words or bytes.
Texts are never cut: a batch is split between rows only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20

#: White space is space and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's root and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_ROOT, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def classes(is_token: Callable[[int], bool]) -> np.ndarray:
    """A table of which byte values belong to tokens."""
    return np.array([is_token(b) for b in range(256)])


#: Runs of anything but white space.
NON_SPACE = classes(lambda b: b not in SPACES)
#: Runs of ASCII letters, digits and all that is not ASCII.
ALNUM = classes(lambda b: b >= 128 or chr(b).isalnum())
#: A-Z in lower case, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Texts:
    """Some whole texts as one buffer of UTF-8 bytes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets.astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Null texts are empty ones."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = pc.fill_null(column, "")
        _, offs, data = column.buffers()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        n = len(column)
        if n == 0 or offs is None:
            return cls(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
        offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[offs[0] : offs[-1]], offs - offs[0])

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def parts(self, most: int = CHUNK_BYTES) -> Iterator[tuple[slice, Texts]]:
        """Runs of rows of about so many bytes, each row whole."""
        at = 0
        while at < len(self):
            end = int(np.searchsorted(self.offsets, self.offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), len(self))
            a, b = self.offsets[at], self.offsets[end]
            yield slice(at, end), Texts(self.buf[a:b], self.offsets[at : end + 1] - a)
            at = end

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each token, and for each text the index of its first token (and the total)."""
        n = len(self.buf)
        inside = np.zeros(n + 1, bool)
        inside[:n] = table[self.buf]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:n]
        before[self.offsets] = False  # a token never goes on into the next text
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n + 1, bool)
        after[:n] = inside[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def prefix(self, fold: np.ndarray | None = None) -> np.ndarray:
        """Running sums from which span() takes the hash of any run of bytes."""
        n = len(self.buf)
        power, _ = _tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        values = _VALUES if fold is None else _VALUES[fold]
        np.cumsum(values[self.buf] * power[:n], out=sums[1:])
        return sums


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of bytes starts..ends, the same wherever they stand."""
    _, inverse = _tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of n consecutive tokens from each token on; the last n-1 are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[i : i + m]
    return mix(out)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Index in a sorted array, or -1."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return np.where(ordered[at] == values, at, -1)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... (counts[i] of them) for all i, one after another."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def give_back() -> None:
    """Returns to the system what Arrow and the C library hold unused: a Python worker outlives its tasks, and what it keeps adds to the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores as long as it clashes (column names ignore case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def annotate(df: DataFrame, text: str, keep: list[str], result: T.StructType, fn: Callable[[Texts], list]) -> tuple[DataFrame, str]:
    """Each row's kept columns and one struct column that fn makes of its text; gives the struct's name.

    fn gets some whole texts and returns an array for each field.  Rows stay
    where they are: there is no shuffle, and repeated or null keys don't matter.
    """
    name = free_name("found", [*keep, text])
    carried = [c for c in keep if c != text]
    kept = [df.schema[c] for c in keep]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in result.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.names.index(text)
            for rows, part in Texts.of(batch.column(where)).parts():
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(fn(part), arrow, strict=True)]
                cols = [batch.column(batch.schema.names.index(c)).slice(rows.start, rows.stop - rows.start) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.StructArray.from_arrays(made, names=result.names)], names=[*keep, name])
        give_back()

    return df.select(*carried, text).mapInArrow(run, T.StructType([*kept, T.StructField(name, result)])), name
