"""Sum-of-squares packing of documents into sequences of a fixed length.

For each residual gap the number of open sequences with that gap is kept.  A
piece goes where the sum of these numbers' squares becomes smallest: into a
gap, or into a new sequence.  A piece of the whole length is a sequence.

Documents are tokenized where they lie; only a row per piece travels.  Pieces
are dealt evenly by row number into groups of bounded size, each packed by one
task; what a group leaves open is packed again with what others leave, in
fewer groups each time, until one group holds it.
"""

from __future__ import annotations

import array
import functools
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import written
from ._text import give_back

LENGTH = 2_048
END = 0
#: Pieces that one task packs.
GROUP = 1 << 13
#: Words whose ids a task remembers.
CACHE = 200_000

#: Letters in lower case and numbers below U+0250, where the tokenizer's words are found here.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
_words = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}{_NUMBERS}]+").findall
_ODD = re.compile("[^\t\n\r -~¡-ɏ]|İ")
_LATIN = bytes([9, 10, 13, *range(32, 127), *range(161, 256)])


def _plain(text: str) -> bool:
    """Whether the text can be cut into words here; others (and those with a special token's mark) go to the tokenizer whole."""
    if "<|" in text:
        return False
    try:
        return not text.encode("latin-1").translate(None, _LATIN)
    except UnicodeEncodeError:
        return not _ODD.search(text)


def _byte_letters() -> dict[str, str]:
    """What the tokenizer's model sees for each byte: printable bytes as they are, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(others)})


class _Ids(dict):
    """The ids of words as bytes; forgets all when it holds too many."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        self[word] = out = _bytes([t.id for t in self.model.tokenize(seen)])
        return out


@functools.cache
def _tokenizer(path: str) -> tuple:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, _Ids(tokenizer.model)


def _bytes(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def token_bytes(texts: list[str | None], path: str, words: bool) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    words: whether the tokenizer lower-cases and knows nothing between words
    (as the one of the query does), so that ids can be remembered by word.
    """
    tokenizer, ids = _tokenizer(path)
    out = []
    for text in texts:
        text = text or ""
        if words and _plain(text):
            out.append(b"".join(map(ids.__getitem__, _words(text.lower()))))
        else:
            out.append(_bytes(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids))
    return out


PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, words: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  A null or empty text is its end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, len(batch), 64):
                rows = []
                for i, raw in enumerate(token_bytes(texts.slice(a, 64).to_pylist(), tokenizer, words), a):
                    raw += _bytes([end])
                    rows += [(i, p, p * length, min(4 * length, len(raw) - at) // 4, zlib.crc32(raw[at : at + 4 * length])) for p, at in enumerate(range(0, len(raw), 4 * length))]
                row, piece, start, size, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        _tokenizer(tokenizer)[1].clear()
        give_back()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *PIECE]))


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its sequence's number and its offset; and how full each sequence is.

    Larger pieces go first.  Of equal sums the smallest gap left counts, a new
    sequence last.
    """
    order = np.argsort(-sizes, kind="stable")
    open_ = np.zeros(length + 1, np.int64)  # by gap
    holders: list[list[int]] = [[] for _ in range(length + 1)]
    bins, places, full = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i in order.tolist():
        s = int(sizes[i])
        # twice these is what the sum of squares grows by, less one for each number that changes
        grow = open_[: length - s] - open_[s:length]  # gaps s..length-1 become 0..length-1-s
        cost = 2 * grow + 2
        cost[:1] -= 1  # a gap of nothing isn't open any more
        cost[open_[s:length] == 0] = np.iinfo(np.int64).max
        new = 2 * open_[length - s] + 1 if s < length else 0
        best = int(np.argmin(cost)) if len(cost) else 0
        if len(cost) and cost[best] <= new:
            gap = best + s
            b = holders[gap].pop()
            open_[gap] -= 1
        else:
            gap, b = length, len(full)
            full.append(0)
        bins[i], places[i] = b, full[b]
        full[b] += s
        if gap > s:
            open_[gap - s] += 1
            holders[gap - s].append(b)
    return bins, places, np.array(full, np.int64)


def _packer(names: list[str], length: int, final: bool, turn: int) -> Callable[[pa.Table], pa.Table]:
    def pack(part: pa.Table) -> pa.Table:
        bins, places, full = sum_of_squares(part["length"].to_numpy(), length)
        closed = full >= (0 if final else length - length // 64)
        ids = (np.int64(turn) << np.int64(56)) + (np.int64(part["group"][0].as_py()) << np.int64(24)) + bins
        return part.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(places)).append_column("closed", pa.array(closed[bins]))

    return pack


def packed(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset.  Sequences are never longer than length; offsets have no gaps.

    Sequences that their group leaves with a gap of over a 64th are opened
    again: their pieces go to the next round with those of other groups.
    """
    names = rows.columns
    whole = rows.where(F.col("length") >= length).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, turn, final = written(rows.where(F.col("length") < length), "pieces"), [whole], 0, False
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("closed", T.BooleanType())])
    while count := rest.count():
        groups = -(-count // group)
        final |= groups == 1

        row = F.monotonically_increasing_id() % F.lit(1 << 33) + F.spark_partition_id() * F.lit(7919)
        out = written(rest.withColumn("group", F.pmod(row, F.lit(groups))).groupBy("group").applyInArrow(_packer(names, length, final, turn), schema), "packed")
        done.append(out.where("closed").drop("closed"))
        if final:
            break
        rest = written(out.where("not closed").select(*names), "pieces")
        final = rest.count() > 0.5 * count  # more rounds would leave as much
        turn += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, words: bool = True) -> DataFrame:
    """Documents as pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is packed whole: null and empty texts as one end id,
    repeated rows and null ids each for themselves.  Other columns don't matter.
    """
    return packed(written(pieces(docs, tokenizer, doc_id, text, length, words=words), "all-pieces"), length)
