"""Benchmark decontamination by winnowing.

The minimum hash of every run of consecutive k-grams is a text's fingerprint
there.  A window of ``n`` words holds n-k+1 k-grams, so whenever a document
holds a benchmark window, both have the same minimum in it: any shared span of
n words or more is found.  Fingerprints are joined first; each hit is extended
to its n words, looked up among the benchmark's windows, and compared with the
window word by word (64-bit hashes of each).

The benchmark side is split by hash into blocks of bounded size
(``BLOCK_BYTES``); each block is sent to the tasks and all documents are read
against it.  What one block finds is written before the next one is sent, so
only one is held at a time and neither side has a limit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import forget, written
from ._text import ALNUM, LOWER, Texts, annotate, grams, lists, member, ranges, span

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _hashed(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = texts.words(ALNUM)
    return span(texts.prefix(LOWER), starts, ends), first, starts, ends


def _minima(g: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many."""
    out = g[: max(0, len(g) - width + 1)].copy()
    for i in range(1, width):
        np.minimum(out, g[i : i + len(out)], out=out)
    return out


class _Block:
    """Fingerprints and windows of some benchmark items."""

    def __init__(self, ids: list[str], texts: list[str], window: int, gram: int):
        self.window, self.gram, self.ids = window, gram, ids
        hashes, first, _, _ = _hashed(Texts.of(pa.array(texts, pa.string())))
        by_length: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        self.hashes = hashes
        prints = []
        for i in range(len(ids)):
            own = hashes[first[i] : first[i + 1]]
            if not len(own):
                continue
            length = min(window, len(own))
            by_length.setdefault(length, []).append((grams(own, length), i, first[i]))
            if length == window:
                prints.append(_minima(grams(own, gram), window - gram + 1))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {}
        for length, found in by_length.items():
            keys = np.concatenate([g for g, _, _ in found])
            sizes = np.array([len(g) for g, _, _ in found])
            owner = np.repeat([i for _, i, _ in found], sizes)
            places = ranges(np.array([a for _, _, a in found]), sizes)
            order = np.lexsort((owner, keys))
            keys, owner, places = keys[order], owner[order], places[order]
            unique, at = np.unique(keys, return_index=True)
            self.windows[length] = unique, at, owner, places[at], len(keys)


def _find(block: _Block, texts: Texts) -> list:
    hashes, first, starts, ends = _hashed(texts)
    n, docs = len(hashes), len(texts)
    doc = np.repeat(np.arange(docs), np.diff(first))
    covered = np.zeros(n + 1, np.int32)
    pairs = []
    for length, (keys, at, owner, places, total) in block.windows.items():
        if n < length:
            continue
        whole = doc[: n - length + 1] == doc[length - 1 :]
        if length == block.window:  # only where the fingerprint is known
            whole &= member(_minima(grams(hashes, block.gram), length - block.gram + 1), block.prints) >= 0
        here = np.flatnonzero(whole)
        if not len(here):
            continue
        hit = member(grams(hashes, length)[here], keys)
        here, hit = here[hit >= 0], hit[hit >= 0]
        same = np.ones(len(here), bool)
        for i in range(length):
            same &= hashes[here + i] == block.hashes[places[hit] + i]
        here, hit = here[same], hit[same]
        np.add.at(covered, here, 1)
        np.add.at(covered, here + length, -1)
        many = np.append(at, total)[hit + 1] - at[hit]
        pairs.append(np.stack([np.repeat(doc[here], many), owner[ranges(at[hit], many)]]))
    inside = np.cumsum(covered[:n]) > 0
    words = np.flatnonzero(inside)
    per = np.bincount(doc[words], minlength=docs)
    local = (words - first[:-1][doc[words]]).astype(np.int32)
    # runs of hit words as code point spans
    begin = words[np.diff(words, prepend=-2) > 1] if len(words) else words
    if len(words):
        fresh = (np.diff(words, prepend=-2) > 1) | (np.diff(doc[words], prepend=-1) != 0)
        begin, end = words[fresh], words[np.append(fresh[1:], True)]
        points = np.zeros(len(texts.buf) + 1, np.int64)
        np.cumsum((texts.buf & 0xC0) != 0x80, out=points[1:])
        base = points[texts.offsets[doc[begin]]]
        s, e = points[starts[begin]] - base, points[ends[end]] - base
    else:
        s = e = np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["start", "end"])
    items: list[list[str]] = [[] for _ in range(docs)]
    if pairs:
        for d, i in np.unique(np.concatenate(pairs, axis=1), axis=1).T:
            items[d].append(block.ids[i])
    return [np.diff(first), lists(pa.array(local), per), lists(spans, np.bincount(doc[begin], minlength=docs)), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """The kept columns of each document and a struct: n_words, words (indices of hit words), spans (code points), items.

    A null or empty text has no words.  An item of fewer words than the window
    is one window; one without words matches nothing.  A null item id counts as
    the empty id, and items with one id are one item.  Repeated rows agree, as
    each is read by itself; texts are never cut.  Other columns don't matter; the
    struct's name gets underscores where it clashes.
    """
    keep = list(keep if keep is not None else docs.columns)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("id") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out, name, last = None, "", None
    for b in range(blocks):
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b)).collect()  # at most about block_bytes
        block = docs.sparkSession.sparkContext.broadcast(_Block([r.id for r in rows], [r.t for r in rows], window, gram))
        if out is None:
            out, name = annotate(docs, text, list(dict.fromkeys([*keep, text])) if blocks > 1 else keep, RESULT, lambda part, block=block: _find(block.value, part))
        else:
            base = out.columns
            out, extra = annotate(out, text, base, RESULT, lambda part, block=block: _find(block.value, part))
            both = F.struct(
                F.col(name)["n_words"].alias("n_words"),
                F.array_union(F.col(name)["words"], F.col(extra)["words"]).alias("words"),
                F.array_union(F.col(name)["spans"], F.col(extra)["spans"]).alias("spans"),
                F.array_union(F.col(name)["items"], F.col(extra)["items"]).alias("items"),
            )
            out = out.withColumn(name, both).drop(extra)
        if blocks > 1:
            out = written(out, "contamination")
            block.unpersist()
            if last is not None:
                forget(last)
            last = out
    return out.select(*keep, name), name


def excise(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without contaminated ones; all columns as they were.

    Null and empty texts hold no window and stay; repeated rows go or stay
    together; without a benchmark all stay.
    """
    out, name = contamination(docs, benchmark, text)
    return out.where(F.size(F.col(name)["words"]) == 0).drop(name)


def digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: word and hit counts, and which items it holds."""
    out, name = contamination(docs, benchmark, keep=["doc_id"], **options)
    r = F.col(name)
    return out.select(
        "doc_id",
        r["n_words"].alias("n_words"),
        F.size(r["words"]).cast("long").alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(r["items"]), ","), 256).alias("items_sha256"),
        (F.size(r["words"]) > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """The same by direct comparison, for tests: {doc_id: (n_words, n_hit, n_items, sha, contaminated)}."""
    import re

    cut = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    out = {}
    for d, text in docs:
        words, hit, ids = cut(text), set(), set()
        for i, t in items:
            w = cut(t)
            size = min(window, len(w))
            for a in range(len(w) - size + 1 if size else 0):
                for s in range(len(words) - size + 1):
                    if words[s : s + size] == w[a : a + size]:
                        hit |= set(range(s, s + size))
                        ids.add("" if i is None else str(i))
        out[d] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out
