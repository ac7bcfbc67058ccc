"""Language-model scores by logistic context mixing.

A text is a sequence of bytes and an end mark, cut into units after every white
space.  Each symbol is spelled in the bits of a Huffman code of the training
bytes.  For every bit several predictors look up what followed their hashed
context: for a unit's first byte what kind of place it stands in and the last
bytes of the word before, for the others the last one, two or three symbols and
the unit's beginning.  Their log odds are mixed with weights chosen by the
code's node and by how well the longest context is known; the mixed probability
is refined by a table of what came true.  Weights and refinement are learned
online on all training documents.

How likely a whole unit is, is then mixed anew in each document: the spelled
probability, the unit's share of the training units, and its share of the
document so far.  The weights of these three start out the same everywhere and
follow, block by block, what predicted best in this document.

What is gathered grows with the input: the counts of all different units and
words are kept in buckets, as many as the text needs, and the contexts' tables
grow with it as well, up to ``MOST_SLOTS`` (contexts are at most four symbols
long, so there are only so many).  Documents are dealt into pieces.  A piece
sends each of its different units once, with how often it came, to the bucket
of its word; each different unit of the corpus is counted, learned from and
scored once, in its bucket; the piece gets its units' scores and counts back in
the order in which it asked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import forget, free_shuffles, written
from ._text import LOWER, NON_SPACE, Texts, free_name, mix, ranges, span

#: Slots of each predictor's table: one for so many bytes of training text, but not more than MOST_SLOTS (as powers of two).
SLOT_BYTES = 128
LEAST_SLOTS, MOST_SLOTS = 16, 22
PREDICTORS = 4
END = 256
#: Bytes of text in a piece, and for each bucket, about.
PIECE = 6 << 20
BUCKET = 16 << 20
#: Symbols that are spelled at a time.
CHUNK = 1 << 17
#: Slots in one block of a table on its way to the driver, as a power of two.
BLOCK = 16
#: Kinds of rows beside those of buckets.
DOCUMENT, TEXT, BYTES = -1, -2, -3
#: What the three ways to know a unit (spelled, training units, document) start with in each document.
PRIOR = np.array([8.0, 8.0, 2.0])

#: Counts by level: a count is kept as the last level that it reaches.
LEVELS = np.array([0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 512, 4096, 65536])

_SPACE = ~NON_SPACE
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True
_U = np.uint64


class Code:
    """A Huffman code of 257 symbols; the nodes and bits of each symbol's way down."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i, None) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        up, n = {}, len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]], up[b[1]] = (n, 0), (n, 1)
            heapq.heappush(heap, (a[0] + b[0], n, None))
            n += 1
        self.nodes_total = n - len(counts)
        nodes, bits, sizes = [], [], []
        for s in range(len(counts)):
            way, at = [], s
            while at in up:
                at, bit = up[at]
                way.append((at - len(counts), bit))
            sizes.append(len(way))
            nodes += [w[0] for w in reversed(way)]
            bits += [w[1] for w in reversed(way)]
        self.nodes, self.bits = np.array(nodes, np.int32), np.array(bits, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes


def _packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True)


def _unpacked(cell: pa.Scalar, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(cell.as_buffer(), n * np.dtype(kind).itemsize, "zstd"), kind)


# -- a piece of documents -----------------------------------------------------


class Piece:
    """Some texts' units and firsts, the different ones of each, and the buckets that these belong to.

    A first is a unit's first symbol with what stands before it: the kind of
    place (start of the text, of a line, of a sentence, within one) and the
    three bytes before the white space, as one number.
    """

    def __init__(self, texts: Texts, buckets: int):
        self.texts = texts
        buf, n_texts = texts.buf, len(texts)
        cuts = np.flatnonzero(_SPACE[buf]) + 1
        per = np.diff(np.searchsorted(cuts, texts.offsets, "right")) + 1
        # a text that ends with white space has an empty last unit
        self.owner = np.repeat(np.arange(n_texts), per)
        self.starts = np.sort(np.concatenate([texts.offsets[:-1], cuts]))
        self.ends = np.sort(np.concatenate([cuts, texts.offsets[1:]]))
        self.first_unit = np.cumsum(per) - per
        last = np.zeros(len(self.starts), bool)
        last[self.first_unit + per - 1] = True
        sums = texts.prefix()
        keys = span(sums, self.starts, self.ends) ^ mix(last.astype(_U))
        _, which, self.unit = np.unique(keys, return_index=True, return_inverse=True)
        self.starts_of, self.ends_of, self.last_of = self.starts[which], self.ends[which], last[which]
        padded = np.concatenate([np.zeros(4, np.uint8), buf, np.zeros(1, np.uint8)])
        back = lambda k: np.where(self.starts - texts.offsets[self.owner] >= k, padded[self.starts + 4 - k], 0).astype(np.int64)
        before, kind = back(1), np.ones(len(self.starts), np.int64)
        kind = 2 + 2 * (before == 10) + _STOPS[back(2)]
        kind[self.first_unit] = 1
        symbol = np.where(self.ends > self.starts, padded[self.starts + 4].astype(np.int64), END)
        firsts = ((((kind << 8 | back(4)) << 8 | back(3)) << 8 | back(2)) << 9) | symbol
        self.firsts, self.first = np.unique(firsts, return_inverse=True)
        # words in lower case decide on buckets, so that a bucket has all units of a word
        length = self.ends_of - self.starts_of
        tail = padded[np.maximum(self.ends_of - 1, 0) + 4]
        self.words_end = self.ends_of - ((length > 0) & _SPACE[tail])
        lower = span(texts.prefix(LOWER), self.starts_of, self.words_end)
        bucket = lambda h: ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        self.asked = []
        for found in (bucket(lower), bucket(mix(self.firsts.astype(_U)))):
            order = np.argsort(found, kind="stable")
            self.asked.append((order, np.concatenate([[0], np.cumsum(np.bincount(found, minlength=buckets))])))

    def sent(self, train: np.ndarray) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """(bucket, part, n, items, times): what each bucket is asked; part 0 are units, part 1 firsts."""
        weight = train[self.owner].astype(float)
        for part, (of, count) in enumerate(((self.unit, len(self.starts_of)), (self.first, len(self.firsts)))):
            times = np.bincount(of, weight, count).astype("<u4")
            order, cuts = self.asked[part]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[b] : cuts[b + 1]]
                if part:
                    items = _packed(self.firsts[at])
                else:
                    size = self.ends_of[at] - self.starts_of[at]
                    head = (size * 2 + self.last_of[at]).astype("<u4").tobytes()
                    items = len(at).to_bytes(8, "little") + int(size.sum()).to_bytes(8, "little") + _packed(np.frombuffer(head + self.texts.buf[ranges(self.starts_of[at], size)].tobytes(), np.uint8))
                yield b, part, len(at), items, _packed(times[at])

    def taken(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each different unit the log probability, count and its word's count, and of each first the log probability."""
        made = [[np.zeros(len(self.starts_of), k) for k in ("<f4", "<u4", "<u4")], [np.zeros(len(self.firsts), "<f4")]]
        seen = [0, 0]
        for bucket, part, n, pack in zip(answers["bucket"].to_pylist(), answers["part"].to_pylist(), answers["n"].to_pylist(), answers["pack"], strict=True):
            order, cuts = self.asked[part]
            at = order[cuts[bucket] : cuts[bucket + 1]]
            raw = _unpacked(pack, "<u4", n * (1 if part else 3))
            for i, out in enumerate(made[part]):
                out[at] = raw[i * n : (i + 1) * n].view(out.dtype)
            seen[part] += n
        if seen != [len(self.starts_of), len(self.firsts)]:
            raise ValueError("a piece's answers don't fit its questions")
        return (*made[0], made[1][0])


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """A table of pieces: rows of documents (without text), of pieces' texts, of bytes' counts, and of what buckets are asked.

    docs has columns of its own, held_out, and its text as t.
    """
    carried = [f for f in docs.schema.fields if f.name != "t"]
    schema = T.StructType([T.StructField("piece", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("pack", T.BinaryType()), T.StructField("more", T.BinaryType()), *[T.StructField(f.name, f.dataType) for f in carried]])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in carried]

    def rows(piece: int, made: list[tuple], own: list | None = None) -> pa.RecordBatch:
        cols = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array([piece] * len(made), pa.int64()), *cols, *(own or [pa.nulls(len(made), k) for k in kinds])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, counts = TaskContext.get().partitionId() << 32, np.zeros(257, np.int64)
        for batch in batches:
            names = batch.schema.names
            train = ~batch.column(names.index("held_out")).to_numpy(zero_copy_only=False)
            for at, texts in Texts.of(batch.column(names.index("t"))).parts(PIECE):
                own = train[at]
                learn = np.repeat(own, texts.sizes())
                counts[:256] += np.bincount(texts.buf[learn], minlength=256)
                counts[END] += int(own.sum())
                yield rows(piece, [(DOCUMENT, 0, i, None, None) for i in range(len(texts))], [batch.column(names.index(f.name)).slice(at.start, len(texts)) for f in carried])
                yield rows(piece, [(TEXT, 0, len(texts.buf), _packed(texts.buf), texts.offsets.tobytes())])
                for b, part, n, items, times in Piece(texts, buckets).sent(own):
                    yield rows(piece, [(b, part, n, items, times)])
                piece += 1
        yield rows(-1, [(BYTES, 0, 0, counts.tobytes(), None)])

    return written(docs.mapInArrow(run, schema), "pieces")


def _texts(cell: pa.Scalar, n: int, offsets: pa.Scalar) -> Texts:
    return Texts(_unpacked(cell, "u1", n), np.frombuffer(offsets.as_buffer(), np.int64))


# -- buckets ------------------------------------------------------------------

BUCKETS = T.StructType([T.StructField(n, t) for n, t in (("bucket", T.IntegerType()), ("tokens", T.LongType()), ("kinds", T.LongType()), ("units", T.LongType()), ("bytes", T.LongType()), ("asked", T.ArrayType(T.StructType([T.StructField("piece", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType())]))), ("n_units", T.LongType()), ("n_firsts", T.LongType()), ("pack", T.BinaryType()), ("times", T.BinaryType()), ("words", T.BinaryType()), ("firsts", T.BinaryType()), ("first_times", T.BinaryType()), ("places", T.BinaryType()))])


def _merged(asked: pa.Table) -> pa.Table:
    """One row of a bucket: its different units and firsts, how often each came in training, and where each piece's are among them."""
    parts = asked["part"].to_pylist()
    sides: list[list] = [[], []]
    for i, part in enumerate(parts):
        n = asked["n"][i].as_py()
        times = _unpacked(asked["more"][i], "<u4", n)
        if part:
            sides[1].append((i, _unpacked(asked["pack"][i], "<i8", n), times))
        else:
            raw = asked["pack"][i].as_buffer().to_pybytes()
            size = int.from_bytes(raw[8:16], "little")
            data = np.frombuffer(pa.decompress(raw[16:], 4 * n + size, "zstd"), np.uint8)
            sides[0].append((i, data[: 4 * n].view("<u4").astype(np.int64), times, data[4 * n :]))
    order = [x[0] for side in sides for x in side]
    heads = np.concatenate([x[1] for x in sides[0]] or [np.zeros(0, np.int64)])
    buf = np.concatenate([x[3] for x in sides[0]] or [np.zeros(0, np.uint8)])
    ends = np.cumsum(heads >> 1)
    starts = ends - (heads >> 1)
    texts = Texts(buf, np.array([0, len(buf)]))
    _, which, place = np.unique(span(texts.prefix(), starts, ends) ^ mix((heads & 1).astype(_U)), return_index=True, return_inverse=True)
    count = np.bincount(place, np.concatenate([x[2] for x in sides[0]] or [np.zeros(0)]), len(which)).astype("<u4")
    starts, ends, heads = starts[which], ends[which], heads[which]
    words_end = ends - ((ends > starts) & _SPACE[buf[np.maximum(ends - 1, 0)]]) if len(buf) else ends
    _, word = np.unique(span(texts.prefix(LOWER), starts, words_end), return_inverse=True)
    is_word = words_end > starts
    n_word = np.bincount(word, count * is_word, int(word.max()) + 1 if len(word) else 0).astype(np.int64)
    codes = np.concatenate([x[1] for x in sides[1]] or [np.zeros(0, np.int64)])
    firsts, first = np.unique(codes, return_inverse=True)
    first_times = np.bincount(first, np.concatenate([x[2] for x in sides[1]] or [np.zeros(0)]), len(firsts)).astype("<u4")
    size = ends - starts
    data = np.concatenate([heads.astype("<u4").view(np.uint8), buf[ranges(starts, size)]])
    row = {
        "bucket": [asked["bucket"][0].as_py()], "tokens": [int(n_word.sum())], "kinds": [int(np.count_nonzero(n_word))], "units": [int(count.sum())], "bytes": [int(size.sum())],
        "asked": [[{"piece": asked["piece"][i].as_py(), "part": parts[i], "n": asked["n"][i].as_py()} for i in order]], "n_units": [len(which)], "n_firsts": [len(firsts)],
        "pack": [_packed(data)], "times": [_packed(count)], "words": [_packed((n_word[word] * is_word).astype("<u4") if len(word) else count)], "firsts": [_packed(firsts)], "first_times": [_packed(first_times)],
        "places": [_packed(np.concatenate([place, first]).astype("<i4"))],
    }
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.table(row, to_arrow_schema(BUCKETS))


def merged(pieces: DataFrame) -> DataFrame:
    return written(pieces.where("bucket >= 0").select("piece", "bucket", "part", "n", "pack", "more").groupBy("bucket").applyInArrow(_merged, BUCKETS), "buckets")


class Bucket:
    """A bucket's different units and firsts, and how they are spelled."""

    def __init__(self, heads: np.ndarray, buf: np.ndarray, times: np.ndarray, firsts: np.ndarray, first_times: np.ndarray):
        self.size, self.last, self.buf = heads.astype(np.int64) >> 1, heads.astype(np.int64) & 1, buf
        self.starts = np.cumsum(self.size) - self.size
        self.times, self.firsts = np.concatenate([times, first_times]).astype(np.int64), firsts
        self.n_units = len(heads)

    @classmethod
    def of(cls, batch: pa.RecordBatch, i: int) -> Bucket:
        cell = lambda c: batch.column(batch.schema.names.index(c))[i]
        n, m, size = cell("n_units").as_py(), cell("n_firsts").as_py(), cell("bytes").as_py()
        data = _unpacked(cell("pack"), "u1", 4 * n + size)
        return cls(data[: 4 * n].view("<u4"), data[4 * n :], _unpacked(cell("times"), "<u4", n), _unpacked(cell("firsts"), "<i8", m), _unpacked(cell("first_times"), "<u4", m))

    def symbols(self, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each symbol after the first of some units: its context's hash for each predictor, itself, and the unit's place in `which`."""
        size, last = self.size[which], self.last[which]
        room = size + last + 3  # two zeros, a mark of the beginning, the bytes, perhaps the end mark
        begin = np.cumsum(room) - room + 2
        symbols = np.zeros(int(room.sum()) + 4, np.int64)
        symbols[begin] = 300
        symbols[ranges(begin + 1, size)] = self.buf[ranges(self.starts[which], size)]
        symbols[(begin + 1 + size)[last == 1]] = END
        length = np.maximum(size + last - 1, 0)
        at = ranges(begin + 2, length)
        own = np.repeat(begin, length)
        back = lambda k: symbols[at - k].astype(_U)
        place = np.minimum(at - own, 6).astype(_U)
        one = back(1) + _U(1 << 60)
        two = back(1) | back(2) << _U(9) | _U(2 << 60)
        three = two + (back(3) << _U(18)) + _U(1 << 60)
        start = symbols[own + 1] | np.where(at - own > 2, symbols[own + 2], 0) << 9 | np.where(at - own > 3, symbols[own + 3], 0) << 18
        begun = (start.astype(_U) << _U(16) | back(1)) | place << _U(48) | _U(4 << 60)
        return [mix(c) for c in (one, two, three, begun)], symbols[at], np.repeat(np.arange(len(which)), length)

    def first_symbols(self, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        f = self.firsts[which].astype(_U)
        kind, b4, b3, b2 = f >> _U(33), f >> _U(25) & _U(255), f >> _U(17) & _U(255), f >> _U(9) & _U(255)
        base = kind << _U(32)
        contexts = (base | _U(5 << 60), base | b2 | _U(6 << 60), base | b3 << _U(8) | b2 | _U(7 << 60), base | b4 << _U(16) | b3 << _U(8) | b2 | _U(8 << 60))
        return [mix(c) for c in contexts], (self.firsts[which] & 511), np.arange(len(which))

    def spelled(self, code: Code, slot_bits: int, trained: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some symbols at a time: slots of each predictor, node (those of firsts by themselves) and bit of each bit, and the number of its unit or first."""
        for side, (begin, end) in enumerate(((0, self.n_units), (self.n_units, len(self.times)))):
            which = np.arange(begin, end)
            if trained:
                which = which[self.times[begin:end] > 0]
            total = np.cumsum(self.size[which] + 2) if side == 0 else np.arange(1, len(which) + 1)
            at = 0
            while at < len(which):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
                some = which[at:stop]
                contexts, spelt, item = self.first_symbols(some - self.n_units) if side else self.symbols(some)
                at = stop
                lengths = code.sizes[spelt]
                steps = ranges(code.first[spelt], lengths)
                nodes = code.nodes[steps]
                salt = (nodes.astype(_U) + _U(1)) * _U(0x9FB21C651E98DF25)
                slots = np.stack([(mix(np.repeat(c, lengths) + salt) >> _U(64 - slot_bits)).astype(np.int64) for c in contexts])
                yield slots, nodes + side * code.nodes_total, code.bits[steps], np.repeat(some[item], lengths)


def _level(n: np.ndarray) -> np.ndarray:
    return (np.searchsorted(LEVELS, n, "right") - 1).astype(np.uint8)


def context_table(buckets: DataFrame, shared: Broadcast, slot_bits: int) -> np.ndarray:
    """[predictor, slot]: the levels of how often a 0 and a 1 came there, over all training documents.

    Each task adds up its buckets' counts and sends them in blocks of slots; a
    block is added up in one task.  The table has at most 2**MOST_SLOTS bytes
    for each predictor.
    """
    width = min(BLOCK, slot_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((PREDICTORS, 2 << slot_bits), np.uint32)
        for batch in batches:
            for i in range(len(batch)):
                bucket = Bucket.of(batch, i)
                for slots, _, bits, item in bucket.spelled(shared.value, slot_bits, True):
                    times = bucket.times[item].astype(np.uint32)
                    for k in range(PREDICTORS):
                        np.add.at(table[k], slots[k] * 2 + bits, times)
        for k in range(PREDICTORS):
            for b, part in enumerate(table[k].reshape(-1, 2 << width)):
                at = np.flatnonzero(part)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([_packed(np.diff(at, prepend=0).astype("<u4"))], pa.binary()), pa.array([_packed(part[at])], pa.binary())], names=["k", "block", "n", "at", "times"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(2 << width, np.int64)
        for n, at, times in zip(parts["n"].to_pylist(), parts["at"], parts["times"], strict=True):
            total[np.cumsum(_unpacked(at, "<u4", n).astype(np.int64))] += _unpacked(times, "<u4", n)
        zeros, ones = total.reshape(-1, 2).T
        return pa.table({"k": parts["k"].slice(0, 1), "block": parts["block"].slice(0, 1), "states": pa.array([(_level(zeros) * 16 + _level(ones)).tobytes()], pa.binary())})

    out = np.zeros((PREDICTORS, 1 << slot_bits), np.uint8)
    found = buckets.mapInArrow(count, "k int, block int, n long, at binary, times binary").groupBy("k", "block").applyInArrow(add, "k int, block int, states binary")
    for r in found.toLocalIterator():  # a byte for each slot
        out[r.k, r.block << width : (r.block + 1) << width] = np.frombuffer(r.states, np.uint8)
    return out


_TYPICAL = np.append((LEVELS[:-1] + np.append(LEVELS[1:-1], LEVELS[-1])) / 2, LEVELS[-1] * 2.0)
_TYPICAL[:4] = LEVELS[:4]
#: Log odds of a 1 for each pair of levels.
ODDS = np.log((_TYPICAL[None, :] + 0.05) / (_TYPICAL[:, None] + 0.05)).astype(np.float32).ravel()
#: How well a context is known: not, hardly, somewhat, well.
TRUST = np.array([np.searchsorted([1, 3, 10], LEVELS[s // 16] + LEVELS[s % 16], "right") for s in range(256)], np.int64)
#: The pair of levels without one occurrence of a 0 or of a 1 (small counts only).
_less = np.where(np.arange(16) <= 4, np.maximum(np.arange(16) - 1, 0), np.arange(16))
WITHOUT = np.array([[_less[s // 16] * 16 + s % 16 for s in range(256)], [s // 16 * 16 + _less[s % 16] for s in range(256)]], np.uint8)


class Mixer:
    """Gated weights and the refining table."""

    STEPS = 33

    def __init__(self, nodes: int):
        self.weights = np.full((4 * nodes, PREDICTORS + 1), 0.35, np.float32)
        self.weights[:, -1] = 0
        self.visits = np.zeros(4 * nodes)
        self.hits = np.zeros((nodes, self.STEPS, 2)) + 0.02
        self.centres = np.linspace(-8, 8, self.STEPS, dtype=np.float32)

    def inputs(self, states: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ODDS[states], 4 * nodes + TRUST[states[2]]

    def odds(self, x: np.ndarray, gates: np.ndarray) -> np.ndarray:
        w = self.weights[gates]
        out = w[:, -1].copy()
        for k in range(PREDICTORS):
            out += w[:, k] * x[k]
        return np.clip(out, -12, 12, out=out)

    def _step(self, odds: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((odds + 8) * ((self.STEPS - 1) / 16)), 0, self.STEPS - 1).astype(np.int64)

    def learn(self, states: np.ndarray, nodes: np.ndarray, bits: np.ndarray, times: np.ndarray, batch: int = 8192, rate: float = 0.3) -> None:
        """Online: a bit's error, as often as it came, moves the weights of its gate, what came true the refining table."""
        x, gates = self.inputs(states, nodes)
        every = np.empty(len(bits), np.float32)
        size = len(self.weights)
        for i, a in enumerate(range(0, len(bits), batch)):
            at = slice(a, a + batch)
            odds = every[at] = self.odds(x[:, at], gates[at])
            error = (bits[at] - 1 / (1 + np.exp(-odds))) * times[at]
            g = gates[at]
            n = np.bincount(g, times[at], size)
            self.visits += n
            scale = rate / (1 + i / 200) ** 0.5 / np.maximum(n, 8) * 0.3
            for k in range(PREDICTORS + 1):
                grad = error * x[k, at] if k < PREDICTORS else error
                self.weights[:, k] += (np.bincount(g, grad, size) * scale).astype(np.float32)
        self.hits += np.bincount((nodes * self.STEPS + self._step(every)) * 2 + bits, times, self.hits.size).reshape(self.hits.shape)

    def state(self) -> np.ndarray:
        """What can be added up: weights' moves by visits, visits, and hits, each without its first value."""
        start = Mixer(len(self.hits))
        return np.concatenate([((self.weights - start.weights) * self.visits[:, None].astype(float)).ravel(), self.visits, (self.hits - start.hits).ravel()])

    @classmethod
    def of(cls, nodes: int, state: np.ndarray) -> Mixer:
        """The mixer of a sum of states: weights are their averages by visits."""
        out = cls(nodes)
        moves, out.visits, hits = np.split(state, [out.weights.size, out.weights.size + len(out.visits)])
        out.weights += (moves.reshape(out.weights.shape) / np.maximum(out.visits, 1)[:, None]).astype(np.float32)
        out.hits += hits.reshape(out.hits.shape)
        return out

    def finish(self) -> None:
        prior = 1 / (1 + np.exp(-self.centres.astype(float)))
        n = self.hits.sum(axis=2)
        self.refined = ((self.hits[:, :, 1] + 8 * prior) / (n + 8)).astype(np.float32)

    def log_probabilities(self, states: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> np.ndarray:
        odds = self.odds(*self.inputs(states, nodes))
        p = 1 / (1 + np.exp(-odds))
        p = 0.5 * (p + self.refined.ravel()[nodes * self.STEPS + self._step(odds)])
        return np.log(np.where(bits == 1, p, 1 - p))


def _looked_up(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return np.stack([table[k][slots[k]] for k in range(PREDICTORS)])


def learned(buckets: DataFrame, shared: Broadcast, slot_bits: int) -> Mixer:
    """A mixer of all training documents' units: each task learns online on its buckets, and the states of fixed size are added up, groups of them first."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = shared.value
        mixer = Mixer(2 * code.nodes_total)
        for batch in batches:
            for i in range(len(batch)):
                bucket = Bucket.of(batch, i)
                for slots, nodes, bits, item in bucket.spelled(code, slot_bits, True):
                    mixer.learn(WITHOUT[bits, _looked_up(table, slots)], nodes, bits, bucket.times[item].astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([mixer.state().tobytes()], pa.binary())], names=["part", "state"])

    def add(states: pa.Table) -> pa.Table:
        return pa.table({"state": pa.array([sum(np.frombuffer(s.as_buffer()) for s in states["state"]).tobytes()], pa.binary())})

    nodes = 2 * shared.value[0].nodes_total
    total = np.zeros_like(Mixer(nodes).state())
    for r in buckets.mapInArrow(learn, "part int, state binary").groupBy("part").applyInArrow(add, "state binary").toLocalIterator():  # 16 rows at most
        total += np.frombuffer(r.state)
    return Mixer.of(nodes, total)


def answered(buckets: DataFrame, shared: Broadcast, slot_bits: int) -> DataFrame:
    """(piece, bucket, part, n, pack): what each piece asked for."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table, mixer = shared.value
        for batch in batches:
            for i in range(len(batch)):
                cell = lambda c, i=i, batch=batch: batch.column(batch.schema.names.index(c))[i]
                bucket = Bucket.of(batch, i)
                log_p = np.zeros(len(bucket.times))
                for slots, nodes, bits, item in bucket.spelled(code, slot_bits):
                    log_p[item[0] : item[-1] + 1] += np.bincount(item - item[0], mixer.log_probabilities(_looked_up(table, slots), nodes, bits))
                log_p = log_p.astype("<f4").view("<u4")
                words = _unpacked(cell("words"), "<u4", bucket.n_units)
                asked = cell("asked").as_py()
                places = _unpacked(cell("places"), "<i4", sum(x["n"] for x in asked))
                at, packs = 0, []
                for x in asked:
                    own = places[at : at + x["n"]]
                    at += x["n"]
                    packs.append(_packed(log_p[bucket.n_units + own] if x["part"] else np.concatenate([log_p[own], bucket.times[own].astype("<u4"), words[own]])))
                yield pa.RecordBatch.from_arrays([pa.array([x["piece"] for x in asked], pa.int64()), pa.array([cell("bucket").as_py()] * len(asked), pa.int32()), pa.array([x["part"] for x in asked], pa.int32()), pa.array([x["n"] for x in asked], pa.int64()), pa.array(packs, pa.binary())], names=["piece", "bucket", "part", "n", "pack"])

    return written(buckets.mapInArrow(answer, "piece long, bucket int, part int, n long, pack binary"), "answers")


# -- documents ----------------------------------------------------------------


def _edges(most: int) -> list[int]:
    """Where blocks of units begin: of 32 at first, later of a sixteenth of what came before."""
    out = [0]
    while out[-1] < most:
        out.append(out[-1] + max(32, out[-1] // 16))
    return out


def adapted(spelled: np.ndarray, share: np.ndarray, earlier: np.ndarray, first: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Log probability of each unit as mixed in its document.

    spelled: log probabilities; share: of the training units; earlier: how often
    the unit came in the document before.  A block's weights come from the
    blocks before it alone.
    """
    out = np.empty(len(spelled))
    by_size = np.argsort(-per, kind="stable")
    gains = np.tile(PRIOR, (len(per), 1))
    edges = _edges(int(per.max()) if len(per) else 0)
    trained = bool(share.any())
    for a, b in zip(edges, edges[1:], strict=False):
        docs = by_size[: np.searchsorted(-per[by_size], -a, "left")]
        n = np.minimum(per[docs], b) - a
        at, own = ranges(first[docs] + a, n), np.repeat(np.arange(len(docs)), n)
        before = (at - np.repeat(first[docs], n)).astype(float)
        w = gains[docs][own]
        if not trained:
            w[:, 1] = 0
        w[before == 0, 2] = 0
        w /= w.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            logs = np.stack([np.log(w[:, 0]) + spelled[at], np.log(w[:, 1] * share[at]), np.log(w[:, 2] * earlier[at] / np.maximum(before, 1))])
        out[at] = np.logaddexp.reduce(logs, axis=0)
        credit = np.exp(logs - out[at])
        for k in range(3):
            gains[docs, k] += np.bincount(own, credit[k], len(docs))
    return out


RESULT = T.StructType([T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("n_bytes", T.LongType()))])


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id alone by default) and held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents whose crc32(id as text) leaves 2 on division by 7 are held out;
    a null id counts as the empty text.  A null or empty text has one token, its
    end.  Repeated rows count as often as they occur.  Without any training
    document every score is that of an untrained model.  Kept columns named
    like new ones get underscores.
    """
    spark = docs.sparkSession
    keep = [doc_id] if keep is None else list(keep)
    names = [f"c{i}" for i in range(len(keep))]
    whole = F.coalesce(F.col(text), F.lit(""))
    size = int(docs.agg(F.sum(F.octet_length(whole))).first()[0] or 0)
    buckets = 1 + size // BUCKET
    slot_bits = min(MOST_SLOTS, max(LEAST_SLOTS, (size // SLOT_BYTES).bit_length()))
    carried = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], _held_out(F.col(doc_id)).alias("held_out"), whole.alias("t"))
    pieces = dealt(carried, buckets)
    byte_counts = np.zeros(257, np.int64)
    for r in pieces.where(F.col("bucket") == BYTES).select("pack").toLocalIterator():  # 257 numbers of each task
        byte_counts += np.frombuffer(r.pack, np.int64)
    code, ends = Code(byte_counts), int(byte_counts[END])
    found = merged(pieces)
    row = found.agg(F.sum("tokens"), F.sum("kinds"), F.sum("units")).first()
    total, kinds, units = int(row[0] or 0) + ends, int(row[1] or 0) + (ends > 0), int(row[2] or 0)
    table = context_table(found, spark.sparkContext.broadcast(code), slot_bits)
    mixer = learned(found, spark.sparkContext.broadcast((code, table)), slot_bits)
    mixer.finish()
    answers = answered(found, spark.sparkContext.broadcast((code, table, mixer)), slot_bits)
    forget(found)
    free_shuffles()
    log_all = float(np.log10(total + kinds + 1))

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        what = rows["bucket"].to_numpy()
        at = int(np.flatnonzero(what == TEXT)[0])
        texts = _texts(rows["pack"][at], rows["n"][at].as_py(), rows["more"][at])
        piece = Piece(texts, buckets)
        log_p, times, words, first_log_p = piece.taken(answers)
        owner, unit = piece.owner, piece.unit
        per = np.bincount(owner, minlength=len(texts))
        key = owner * len(log_p) + unit
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=-1))
        earlier = np.empty(len(key), np.int64)
        earlier[order] = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
        spelled = log_p[unit].astype(float) + first_log_p[piece.first]
        logs = adapted(spelled, times[unit] / max(units, 1), earlier, piece.first_unit, per)
        word = (piece.words_end > piece.starts_of)[unit]
        base = np.bincount(owner[word], np.log10(words[unit[word]].astype(float) + 1) - log_all, len(texts)) + (np.log10(ends + 1) - log_all)
        known = np.bincount(owner[word], words[unit[word]] > 0, len(texts)).astype(np.int64) + (ends > 0)
        own = rows.filter(pa.array(what == DOCUMENT))
        own = own.sort_by("n").select([*names, "held_out"])
        made = [pa.array(np.bincount(owner[word], minlength=len(texts)) + 1), pa.array(known), pa.array(base), pa.array(np.bincount(owner, logs, len(texts)) / np.log(10)), pa.array(texts.sizes())]
        for field, column in zip(RESULT.names, made, strict=True):
            own = own.append_column(field, column)
        return own

    fields = [T.StructField(f.name, f.dataType) for f in carried.schema.fields if f.name != "t"]
    sides = pieces.where(F.col("bucket").isin(DOCUMENT, TEXT)).select("piece", "bucket", "n", "pack", "more", *names, "held_out")
    rows = sides.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score, T.StructType([*fields, *RESULT.fields]))
    new = {
        "held_out": F.col("held_out"),
        "n_tokens": F.col("n_tokens"),
        "n_known": F.col("n_known"),
        "train_tokens": F.lit(total).cast("long"),
        "base_score": F.col("base_score"),
        "score": F.col("score"),
        "bits_per_byte": -F.col("score") * F.lit(float(np.log2(10))) / F.greatest(F.col("n_bytes"), F.lit(1)),
    }
    old = [F.col(n).alias(free_name(c, list(new))) for c, n in zip(keep, names, strict=True)]
    return rows.select(*old, *[c.alias(n) for n, c in new.items()])
