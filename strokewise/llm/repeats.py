"""Removal of repeated byte strings, by suffix arrays of shards.

Every window of 200 bytes belongs to the shard of the least hash among its
k-grams; equal windows so meet in one shard, wherever they stand.  Runs of
windows of one shard are segments.  Segments that occur twice as a whole are
repeated throughout; counting them needs no bytes.  Where a shard holds
different segments, each one's bytes are sent once, and the shard's suffixes
are sorted by induction: queues by first byte carry suffixes, first those that
start a rise (sorted by names of the pieces between them, in doubling depth up
to the window), then all that follow from them; common prefixes of neighbours
tell which windows are equal.

Spark's shuffles and sorts, which go to disk, deal out the shards and hold
what doesn't fit; a shard too large for a task is counted by window hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import forget, written
from ._text import Texts, free_name, ranges, span

WINDOW = 200
GRAM = 32
#: Windows in one segment at most.
RUN = 256
#: Different segments of one shard that a task sorts; larger shards are counted by hashes.
LARGE = 2_000
#: Segments that a task sorts together, about.
TOGETHER = 4_000
FILTER_BITS = 27


def _segments(texts: Texts, window: int, inner: bool = False) -> tuple[np.ndarray, ...]:
    """Start, number of windows, shard and hash of each segment, and its text.

    inner: also whether the shard's gram stands in it more than once, without
    which no window can occur twice within the segment.
    """
    none = np.zeros(0, np.int64)
    sizes = texts.sizes()
    gram = min(GRAM, window)
    if len(texts.buf) < window:
        return (none,) * (5 + inner)
    sums = texts.prefix()
    at = np.arange(len(texts.buf) - gram + 1)
    grams = least = span(sums, at, at + gram)
    need, have = window - gram + 1, 1
    while have < need:  # the least of ever longer runs
        step = min(have, need - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    per = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(texts)), per)
    starts = ranges(texts.offsets[:-1], per)
    if not len(starts):
        return (none,) * (5 + inner)
    shard = least[starts]
    fresh = np.append(True, (shard[1:] != shard[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(fresh)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.append(first, len(starts))))
    first = np.flatnonzero(place % RUN == 0)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    name = span(sums, begin, begin + count + window - 1)
    out = begin, count, shard[first].view(np.int64), name.view(np.int64), owner[first]
    if not inner:
        return out
    reach = count + need - 1
    same = grams[ranges(begin, reach)] == np.repeat(shard[first], reach)
    return *out, (np.add.reduceat(same.astype(np.int64), np.cumsum(reach) - reach) > 1).astype(np.int64)


def _bits(values: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (16 MB) of the values' last bits; one bit too many does no harm."""

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, np.uint8)
        own[rows["bit"].to_numpy() & 0xFFFF] = 1
        return pa.table({"part": [key[0].as_py()], "set": [np.packbits(own).tobytes()]})

    bit = F.col("v").bitwiseAND((1 << FILTER_BITS) - 1)
    got = values.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", 16)).groupBy("part").applyInArrow(block, "part long, set binary").collect()
    out = np.zeros((1 << FILTER_BITS) >> 3, np.uint8)
    for r in got:
        out[r.part * 8192 : (r.part + 1) * 8192] = np.frombuffer(r.set, np.uint8)
    return out


def _asked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & ((1 << FILTER_BITS) - 1)
    return ((bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1).astype(bool)


# -- suffix sorting -----------------------------------------------------------


def _queues(symbols: np.ndarray, chars: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append the suffixes to the queues of their first characters, in order."""
    if not len(symbols):
        return
    order = np.argsort(chars, kind="stable")
    symbols, chars = symbols[order], chars[order]
    cuts = np.flatnonzero(np.diff(chars)) + 1
    for group, c in zip(np.split(symbols, cuts), chars[np.append(0, cuts)], strict=True):
        queues[c].append(group)


def induced(text: np.ndarray, rising: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that follows from the order of the seeds (those where a rise starts)."""
    width = int(text.max()) + 1
    empty = np.zeros(0, np.int64)
    falls: list[list[np.ndarray]] = [[] for _ in range(width)]
    rises: list[list[np.ndarray]] = [[] for _ in range(width)]
    starts: list[list[np.ndarray]] = [[] for _ in range(width)]
    _queues(seeds, text[seeds], starts)
    last = len(text) - 1
    falls[text[last]].append(np.array([last]))
    for c in range(width):
        done = []
        wave = np.concatenate(falls[c]) if falls[c] else empty
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[~rising[before]]
            chars = text[before]
            wave = before[chars == c]
            if len(more := before[chars > c]):
                _queues(more, chars[chars > c], falls)
        falls[c] = done
        if starts[c]:
            before = np.concatenate(starts[c])
            before = before[before > 0] - 1
            before = before[~rising[before]]
            if len(before):
                _queues(before, text[before], falls)
    out = []
    for c in range(width - 1, -1, -1):
        done = []
        wave = np.concatenate(rises[c]) if rises[c] else empty
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            before = before[rising[before]]
            chars = text[before]
            wave = before[chars == c]
            if len(more := before[chars < c]):
                _queues(more, chars[chars < c], rises)
        fall = np.concatenate(falls[c]) if falls[c] else empty
        before = fall[::-1]
        before = before[before > 0] - 1
        before = before[rising[before]]
        if len(before):
            _queues(before, text[before], rises)
        out += [*done, fall[::-1]]
    return np.concatenate(out)[::-1]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text (numbers from 0 on) in order; ties beyond `depth` characters are broken anyhow."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.uint16)
    # a suffix rises if its next different character is greater; the last one falls
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    upward = np.append(text[change[:-1] + 1] > text[change[:-1]], False)
    rising = np.repeat(upward, np.diff(change, prepend=-1))
    seeds = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if len(seeds) > 1:
        order = induced(text, rising, seeds)
        place = np.full(n, -1)
        place[seeds] = np.arange(len(seeds))
        ordered = place[order]
        ordered = ordered[ordered >= 0]  # seeds by the piece up to the next seed
        ends = np.append(seeds[1:] + 1, n)
        sums = Texts(text.astype(np.uint8), np.array([0, n])).prefix()
        piece = span(sums, seeds, ends)
        if len(seeds):
            piece[-1] ^= np.uint64(1)  # the last piece ends with the text: it is like no other
        new = np.append(True, piece[ordered][1:] != piece[ordered][:-1])
        rank = np.empty(len(seeds), np.int64)
        rank[ordered] = np.cumsum(new)
        reach = 1
        while rank.max() < len(seeds) and 2 * reach <= depth:  # a piece has two characters at least; pieces of twice as many names
            following = np.concatenate([rank[reach:], np.zeros(min(reach, len(rank)), np.int64)])[: len(rank)]
            key = rank * (len(seeds) + 1) + following
            rank = np.unique(key, return_inverse=True)[1] + 1
            reach *= 2
        seeds = seeds[np.argsort(rank, kind="stable")]
    return induced(text, rising, seeds)


def equal_windows(parts: list[bytes], window: int) -> list[np.ndarray]:
    """For each part, which of its windows occur more than once among all windows of the parts."""
    sizes = np.array([len(p) for p in parts])
    buf = np.frombuffer(b"".join(p + b"\0" for p in parts) + b"\0" * (window + 8), np.uint8)
    text = buf[: int(sizes.sum()) + len(parts)].astype(np.uint16) + np.uint16(1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text[begin + sizes] = 0
    places = np.zeros(len(text), bool)
    places[ranges(begin, sizes - window + 1)] = True
    order = suffix_array(text, window)
    order = order[places[order]]
    same = np.ones(max(0, len(order) - 1), bool)
    words = np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))
    for at in [*range(0, window - 7, 8), max(0, window - 8)] if window >= 8 else []:
        left = np.flatnonzero(same)
        same[left] = words[order[:-1][left] + at] == words[order[1:][left] + at]
    if window < 8:
        for at in range(window):
            same &= buf[order[:-1] + at] == buf[order[1:] + at]
    twice = np.zeros(len(text), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return [twice[b : b + s - window + 1] for b, s in zip(begin, sizes, strict=True)]


# -- the operator -------------------------------------------------------------


def _keys(text: str) -> list:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), t.alias("t")]


def repeated(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(name, mask): every segment with windows that occur twice; no mask: all of them."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in Texts.of(batch.column(0)).parts():
                _, _, shard, name, _, inner = _segments(part, window, True)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(name), pa.array(inner.astype(np.int8))], names=["shard", "name", "inner"])

    found = texts.mapInArrow(count, "shard long, name long, inner byte").groupBy("shard", "name").agg(F.count("*").alias("n"), F.max("inner").alias("inner"))
    found = written(found, "found")  # the frames below read it, so that no shard's names are gathered in one row
    whole = found.where(F.col("n") > 1).select("name")
    # lone segments of lone shards need no further look; this keeps what is left small
    shards = found.groupBy("shard").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner"))
    mixed = written(shards.where((F.col("kinds") > 1) | (F.col("inner") > 0)).select("shard", "kinds"), "shards")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(mixed.select(F.col("shard").alias("v"))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen = bits.value, set()
        for batch in batches:
            for _, part in Texts.of(batch.column(0)).parts():
                begin, n, shard, name, _ = _segments(part, window)
                at = np.flatnonzero(_asked(asked, shard))
                at = [i for i in at.tolist() if not (name[i] in seen or seen.add(name[i]))]
                if len(seen) > 1 << 20:
                    seen.clear()
                raw = part.buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(name[at]), pa.array([raw[begin[i] : begin[i] + n[i] + window - 1] for i in at], pa.binary())], names=["shard", "name", "bytes"])

    sent = texts.mapInArrow(fetch, "shard long, name long, bytes binary").dropDuplicates(["name"])
    sent = written(sent.join(mixed, "shard"), "segments")
    small, large = sent.where(F.col("kinds") <= LARGE), sent.where(F.col("kinds") > LARGE)
    groups = max(1, -(-small.count() // TOGETHER))

    def sort(shard: pa.Table) -> pa.Table:
        masks = equal_windows([x.as_buffer().to_pybytes() for x in shard["bytes"].combine_chunks()], window) if len(shard) else []
        some = [i for i, m in enumerate(masks) if m.any()]
        return pa.table({"name": shard["name"].take(pa.array(some, pa.int64())), "mask": pa.array([np.packbits(masks[i]).tobytes() for i in some], pa.binary())})

    sorted_ = small.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups))).select("group", "name", "bytes").groupBy("group").applyInArrow(sort, "name long, mask binary")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = Texts.of(batch.column(1))
            n = raw.sizes() - window + 1
            at = ranges(raw.offsets[:-1], n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(ranges(np.zeros(len(n), np.int64), n).astype(np.int32)), pa.array(span(raw.prefix(), at, at + window).view(np.int64))], names=["name", "at", "h"])

    windows = large.select("name", "bytes").mapInArrow(hashes, "name long, at int, h long")
    again = windows.groupBy("h").count().where("count > 1").select("h")
    marks = windows.join(again, "h").groupBy("name").agg(F.collect_list("at").alias("at"))  # a segment has at most RUN windows

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(1):
                mark = np.zeros(RUN, np.uint8)
                mark[places.values.to_numpy()] = 1
                out.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["name", "mask"])

    parted = sorted_.union(marks.mapInArrow(masks, "name long, mask binary"))
    out = written(whole.select("name", F.lit(None).cast("binary").alias("mask")).union(parted.join(whole, "name", "left_anti")), "repeated")
    forget(found, mixed, sent)
    return out


SPANS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])


def cut(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW) -> tuple[DataFrame, str]:
    """The kept columns of each document and a struct: n_bytes, starts and ends of removed runs, the bytes kept.

    Null and empty texts, and those shorter than the window, lose nothing.
    Copies and repeated rows lose all their windows.  The struct's name gets
    underscores where it clashes.
    """
    keep = list(keep if keep is not None else docs.columns)
    name = free_name("cut", keep)
    table = repeated(docs, text, window)
    bits = docs.sparkSession.sparkContext.broadcast(_bits(table.select(F.col("name").alias("v"))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = bits.value
        for batch in batches:
            for rows, part in Texts.of(batch.column(2)).parts():
                begin, n, _, names, owner = _segments(part, window)
                at = np.flatnonzero(_asked(asked, names))
                own = pa.array(owner[at] + rows.start)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(begin[at] - part.offsets[owner[at]]), pa.array(n[at].astype(np.int32)), pa.array(names[at])], names=["k1", "k2", "at", "n", "name"])

    spots = docs.select(*_keys(text)).mapInArrow(place, "k1 long, k2 long, at long, n int, name long").join(table, "name")
    spots = spots.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n", "mask")).alias("spots"))
    names = [f"c{i}" for i in range(len(keep))]
    carried = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], *_keys(text))
    joined = carried.join(spots, ["k1", "k2"], "left").select(*names, "t", "spots")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for t, spot in zip(batch.column(len(names)), batch.column(len(names) + 1).to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                covered = np.zeros(len(raw) + 1, np.int32)
                for x in spot or ():
                    n = x["n"]
                    on = np.arange(n) if x["mask"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8))[:n])
                    np.add.at(covered, x["at"] + on, 1)
                    np.add.at(covered, x["at"] + on + window, -1)
                gone = np.cumsum(covered) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(np.int8)))
                made[0].append(len(raw))
                made[1].append(edge[::2].tolist())
                made[2].append(edge[1::2].tolist())
                made[3].append(np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes())
            cols = [pa.array(m, k) for m, k in zip(made, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.StructArray.from_arrays(cols, names=SPANS.names)], names=[*names, "found"])

    out = joined.mapInArrow(remove, T.StructType([*[f for f in joined.schema.fields if f.name in names], T.StructField("found", SPANS)]))
    return out.toDF(*keep, name), name


def digest(docs: DataFrame) -> DataFrame:
    out, name = cut(docs, keep=["doc_id"])
    c = F.col(name)
    removed = F.aggregate(F.zip_with(c["starts"], c["ends"], lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", c["n_bytes"].alias("n_bytes"), removed.alias("n_removed"), F.size(c["starts"]).cast("long").alias("n_spans"), F.sha2(c["kept"], 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, for tests."""
    raw = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - window + 1):
            seen[r[i : i + window]] = seen.get(r[i : i + window], 0) + 1
    out = []
    for (d, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int(np.count_nonzero(np.diff(np.append(False, gone).astype(np.int8)) == 1))
        out.append((d, len(r), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out
