"""Exact self-join on the Jaccard similarity of word shingles, by token-combination prefixes.

Shingles are ordered from rare to frequent.  A document of n shingles can lose
at most n/4 of them to a partner of similarity 0.75, so one more than that many
signatures must survive in its prefix (in the smaller one of a pair, a seventh).  Rare shingles are signatures by
themselves.  Where a document runs out of rare ones, its prefix is extended by
frequent ones, which are indexed only in combinations of two (or three, for the
most frequent class) from one hash class: j shingles of a class hold j-1 (j-2)
independent losses.  All candidates are verified on their whole sets.

Groups of signatures aren't multiplied out.  Each member is compared with the
group's leaders, links are joined to components, and only members of still
different components are compared further, until each pair that shares a
signature is verified, is ruled out by the parity sketches that the join
carries, or lies in one component.  So components are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._graph import components
from ._tables import forget, free_shuffles, written
from ._text import LOWER, NON_SPACE, Texts, annotate, give_back, grams, mix, span

SHINGLE = 5
#: From how many occurrences on a shingle counts as frequent, at least, and how many frequent ones tasks keep at most (the count is raised until so few remain).
FREQUENT = 32
MOST_FREQUENT = 1 << 21
#: From how many times that on it is indexed in threes.
THREES = 64
#: Documents with fewer shingles (or that can be similar to such) are indexed by single ones.
SMALL_LEVEL = 3
FILTER_BITS = 26
#: A bitmap of fixed size tells which shingles may occur twice; by their first bits.
TWICE_BITS = 27
#: 64-bit words of a set's parity sketch.
SKETCH = 8


def _sets(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after another, and their counts."""
    starts, ends, first = texts.words(NON_SPACE)
    hashes = span(texts.prefix(LOWER), starts, ends)
    every = grams(hashes, size)
    out, counts = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b == a:
            continue
        own = every[a : b - size + 1] if b - a >= size else mix(grams(hashes[a:b], b - a) + np.uint64(b - a))
        own = np.sort(own)
        if len(own) > 1:
            own = own[np.append(True, own[1:] != own[:-1])]
        counts[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def _nodes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64)


def _key(texts: Texts) -> list:
    values, counts = _sets(texts)
    return [counts, pa.array(_nodes(values, counts), mask=counts == 0)]


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets, counts and names of all texts, without copies within the task."""
    seen: set[int] = set()
    for batch in batches:
        for _, part in Texts.of(batch.column(0)).parts():
            values, counts = _sets(part)
            nodes = _nodes(values, counts)
            fresh = np.array([c > 0 and not (x in seen or seen.add(x)) for x, c in zip(nodes.tolist(), counts.tolist(), strict=True)], bool)
            if len(fresh):
                yield values[np.repeat(fresh, counts)], counts[fresh], nodes[fresh]
    give_back()


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def frequent(texts: DataFrame, least: int = FREQUENT, most: int = MOST_FREQUENT) -> Counts:
    """The frequent shingles (sorted), their classes (2 or 3), and a bitmap of those that may occur twice.  Counts are over all documents.

    Tasks send sorted 40-bit codes and counts in blocks by their first bits.
    Codes that meet only make a rare shingle count as frequent, which is allowed:
    any order of shingles gives the same links.
    """
    parts = texts.rdd.getNumPartitions()
    bits = min(16, max(8, (4 * parts).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            codes = np.concatenate(held)
            held.clear()
            codes >>= np.uint64(24)  # in place, as is the sort: one copy at a time
            codes.sort()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            counts = np.diff(np.append(first, len(codes)))
            codes = codes[first]
            bucket = (codes >> np.uint64(40 - bits)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(codes))
            pack = [pa.compress(np.diff(codes[a:b], prepend=codes[a]).tobytes() + counts[a:b].astype(np.uint32).tobytes(), "zstd", asbytes=True) for a, b in zip(cuts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(ends - cuts), pa.array(codes[cuts].astype(np.int64)), pa.array(pack, pa.binary())], names=["bucket", "n", "base", "pack"])

        for values, _, _ in _sets_of(batches):
            held.append(values)
            size += len(values)
            if size >= 1 << 21:
                yield flush()
                size = 0
        if size:
            yield flush()

    def add_up(block: pa.Table) -> pa.Table:
        codes, counts = [], []
        for n, base, pack in zip(block["n"].to_pylist(), block["base"].to_pylist(), block["pack"], strict=True):
            raw = pa.decompress(pack.as_buffer(), 12 * n, "zstd")
            codes.append(np.cumsum(np.frombuffer(raw, np.uint64, n)) + np.uint64(base))
            counts.append(np.frombuffer(raw, np.uint32, n, 8 * n))
        codes, counts = np.concatenate(codes), np.concatenate(counts).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        cuts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        total = np.add.reduceat(counts, cuts)
        hot = total >= least
        bucket = block["bucket"][0].as_py()
        first = bucket << (TWICE_BITS - bits)
        mark = np.zeros(max(8, 1 << (TWICE_BITS - bits)), np.uint8)
        mark[(codes[cuts][total > 1] >> np.uint64(40 - TWICE_BITS)).astype(np.int64) - first] = 1
        n = int(hot.sum())
        return pa.table({"code": pa.array([*codes[cuts][hot].astype(np.int64).tolist(), None], pa.int64()), "df": pa.array([*total[hot].tolist(), None], pa.int64()), "part": pa.array([None] * n + [first >> 3], pa.int64()), "bits": pa.array([None] * n + [np.packbits(mark).tobytes()], pa.binary())})

    found = written(texts.mapInArrow(count, "bucket int, n long, base long, pack binary").groupBy("bucket").applyInArrow(add_up, "code long, df long, part long, bits binary"), "frequent")
    found_table, twice = found, np.zeros(1 << (TWICE_BITS - 3), np.uint8)
    for r in found.where("part is not null").select("part", "bits").collect():  # 16 MB in all, whatever the input
        twice[r.part : r.part + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    found = found.where("code is not null")
    steps = found.groupBy(F.floor(F.log2(F.col("df"))).alias("power")).count().orderBy(F.desc("power")).collect()  # 64 rows at most
    bound, total = 1 << 62, 0
    for s in steps:
        total += s["count"]
        if total > most:
            break
        bound = 1 << s["power"]
    got = found.where(F.col("df") >= max(bound, least)).select("code", "df").toArrow()  # at most `most` rows
    codes, df = got["code"].to_numpy().astype(np.uint64), got["df"].to_numpy()
    order = np.argsort(codes)
    forget(found_table)
    return codes[order], np.where(df[order] >= THREES * max(bound if bound < 1 << 62 else least, least), 3, 2).astype(np.uint8), twice


def _combined(tokens: np.ndarray, k: int, classes: int, need: int, level: int) -> tuple[np.ndarray, int]:
    """Signatures of k tokens of one class each from a prefix that stands `need` losses, and how many losses are left to stand."""
    if not len(tokens) or need <= 0:
        return np.zeros(0, np.uint64), need
    kind = ((tokens >> np.uint64(20)) & np.uint64(classes - 1)).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    cuts = np.flatnonzero(np.diff(kind[order], prepend=-1))
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens)) - np.repeat(cuts, np.diff(np.append(cuts, len(tokens))))
    stands = np.cumsum(rank >= k - 1)
    stop = int(np.searchsorted(stands, need)) + 1
    left = max(0, need - int(stands[-1]))
    out = []
    inside = order[order < stop]  # still by class, in order
    for group in np.split(tokens[inside], np.flatnonzero(np.diff(kind[inside])) + 1):
        if len(group) >= k:
            at = np.array(list(combinations(range(len(group)), k)))
            h = np.full(len(at), k * 64 + level, np.uint64)
            for j in range(k):
                h = mix(h + group[at[:, j]])
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), left


def _signatures(own: np.ndarray, kinds: np.ndarray, lonely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one document, and which of them are first ones: own are its sorted shingles, kinds their frequency classes; lonely ones stand in the prefix but need no index.

    To a partner that isn't smaller a set loses at most a seventh of its
    shingles; so in each pair the smaller one's first signatures suffice.
    """
    n = len(own)
    rare, others = own[kinds == 1], ~lonely[kinds == 1]

    def withstanding(need: int) -> np.ndarray:
        if len(rare) >= need:
            return rare[:need][others[:need]]
        out = [rare[others]]
        level = n.bit_length() - 1
        for at in (level, level + 1) if n >= 0.75 * 2 ** (level + 1) else (level,):
            if at <= SMALL_LEVEL:
                out += [np.concatenate([own[kinds == 2], own[kinds == 3]])[: need - len(rare)]]
                continue
            left = need - len(rare)
            for k in (2, 3):
                made, left = _combined(own[kinds == k], k, max(1, 2**at // (8 << (k - 1))), left, at)
                out.append(made)
            assert left == 0
        return np.unique(np.concatenate(out))

    every = withstanding(n // 4 + 1)
    return every, np.isin(every, withstanding(n // 7 + 1))


def _index(texts: DataFrame, hot: Counts) -> DataFrame:
    """(sig, node, n, first): every document's signatures, but for single shingles that occur nowhere else."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, kinds_of, twice = shared.value
        for values, counts, nodes in _sets_of(batches):
            kinds = np.ones(len(values), np.uint8)
            if len(codes):
                cut = values >> np.uint64(24)
                at = np.searchsorted(codes, cut)
                at[at == len(codes)] = 0
                kinds = np.where(codes[at] == cut, kinds_of[at], np.uint8(1))
            ends = np.cumsum(counts)
            at = (values >> np.uint64(64 - TWICE_BITS)).astype(np.int64)
            lonely = (twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
            sigs = [_signatures(values[e - c : e], kinds[e - c : e], lonely[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            many = [len(s) for s, _ in sigs]
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for s, _ in sigs]).view(np.int64)), pa.array(np.repeat(nodes, many)), pa.array(np.repeat(counts, many).astype(np.int32)), pa.array(np.concatenate([f for _, f in sigs]))], names=["sig", "node", "n", "first"])

    return texts.mapInArrow(run, "sig long, node long, n int, first boolean")


def _filter(nodes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of fixed size of the nodes' last bits: tasks keep to what can be asked for, and a bit too many does no harm."""

    def block(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, np.uint8)
        own[rows["bit"].to_numpy() & 0xFFFF] = 1
        return pa.table({"part": [key[0].as_py()], "set": [np.packbits(own).tobytes()]})

    bit = F.col("node").bitwiseAND((1 << bits) - 1)
    got = nodes.select(bit.alias("bit")).distinct().withColumn("part", F.shiftright("bit", 16)).groupBy("part").applyInArrow(block, "part long, set binary").collect()
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in got:
        out[r.part * 8192 : (r.part + 1) * 8192] = np.frombuffer(r.set, np.uint8)
    return out


SET = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bitmap", T.BinaryType()), T.StructField("shingles", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])


def _sets_table(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, bitmap, shingles, sketch) of the nodes, written once: a bitmap of four or more bits a shingle, the first 40 bits of each as sorted steps, and the parities of 64 * SKETCH bins."""
    asked = texts.sparkSession.sparkContext.broadcast(_filter(nodes))
    mask = (1 << FILTER_BITS) - 1

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.value
        for values, counts, nodes in _sets_of(batches):
            low = nodes & mask
            wanted = np.flatnonzero((bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1)
            ends = np.cumsum(counts)
            maps, steps, bins = [], [], []
            for i in wanted.tolist():
                own = values[ends[i] - counts[i] : ends[i]]
                width = 2 + int(len(own) - 1).bit_length() + 1
                mark = np.zeros(1 << width, np.uint8)
                mark[(own >> np.uint64(64 - width)).astype(np.int64)] = 1
                maps.append(np.packbits(mark).tobytes())
                odd = np.bincount((own & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                bins.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                cut = np.diff(own >> np.uint64(24), prepend=np.uint64(0)).astype("<u8")
                steps.append(pa.compress(np.ascontiguousarray(cut.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[wanted]), pa.array(counts[wanted].astype(np.int32)), pa.array(maps, pa.binary()), pa.array(steps, pa.binary()), pa.array(bins, pa.list_(pa.int64()))], names=SET.names)

    return written(texts.mapInArrow(fetch, SET), "sets")


def _codes(steps: pa.Scalar, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(steps.as_buffer(), 5 * n, "zstd"), np.uint8).reshape(5, n)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = planes.T
    return np.cumsum(wide.view("<u8").ravel())


def _may_be_similar(x: pa.Scalar, y: pa.Scalar, n: int, m: int) -> bool:
    """False only if the bitmaps prove that the sets aren't: a bit of one alone is a shingle of it alone."""
    a, b = (np.unpackbits(np.frombuffer(z.as_buffer(), np.uint8)).astype(bool) for z in (x, y))
    while len(a) > len(b):
        a = a.reshape(-1, 2).any(axis=1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).any(axis=1)
    common = min(n - int((a & ~b).sum()), m - int((b & ~a).sum()))
    return 100 * common >= 75 * (n + m - common)


def _are_similar(x: pa.Scalar, y: pa.Scalar, n: int, m: int) -> bool:
    both = np.sort(np.concatenate([_codes(x, n), _codes(y, m)]))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= 75 * (n + m - common)


def by_shuffle(table: DataFrame) -> DataFrame:
    """A table that grows with the input: its joins are planned alike at every size, never by a broadcast that a larger input rules out."""
    return table.hint("merge")


def _compared(sets: DataFrame, pairs: DataFrame, column: str, decide: Callable[[pa.Scalar, pa.Scalar, int, int], bool]) -> DataFrame:
    """The pairs (a, b) with near: what decide says of the column of both."""
    asked = sets.sparkSession.sparkContext.broadcast(_filter(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    mask = (1 << FILTER_BITS) - 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.value
        for t in batches:
            low = t.column(0).to_numpy() & mask
            yield t.filter(pa.array(((bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1).astype(bool)))

    own = sets.select("node", "n", F.col(column).alias("x"))
    own = own.mapInArrow(pick, own.schema).dropDuplicates(["node"])
    side = lambda at, n, x: own.select(F.col("node").alias(at), F.col("n").alias(n), F.col("x").alias(x))
    both = pairs.select("a", "b").join(by_shuffle(side("a", "n", "x")), "a").join(by_shuffle(side("b", "m", "y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            near = [decide(x, y, n, m) for x, y, n, m in zip(t["x"], t["y"], t["n"].to_pylist(), t["m"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t["a"], t["b"], pa.array(near, pa.bool_())], names=["a", "b", "near"])

    out = written(both.select("a", "b", "n", "m", "x", "y").mapInArrow(compare, "a long, b long, near boolean"), "compared")
    free_shuffles()
    return out


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with whether their sets are similar: bitmaps first, whole sets for those that they don't rule out."""
    may = _compared(sets, pairs, "bitmap", _may_be_similar)
    return may.where(~F.col("near")).union(_compared(sets, may.where("near"), "shingles", _are_similar))


MEMBER = ("node", "n", "first")
OTHER = ("m", "k", "other_first")


def _other(column: str) -> list[Column]:
    return [F.col(f"{column}.{x}").alias(y) for x, y in zip(MEMBER, OTHER, strict=True)]


def _fits() -> Column:
    """Whether a member and another may be similar: by size, and as the smaller one's first signature is shared."""
    small = F.when(F.col("n") < F.col("k"), F.col("first")).when(F.col("n") > F.col("k"), F.col("other_first")).otherwise(F.col("first") & F.col("other_first"))
    return (F.least("n", "k") * 4 >= F.greatest("n", "k") * 3) & (F.col("node") != F.col("m")) & small


def _sketches_allow() -> Column:
    """False only if the sketches prove that the sets aren't similar: each unequal parity is a shingle of one set alone, and similar sets have at most a seventh of their sizes' sum of those."""
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other_sketch")[i])) for i in range(SKETCH)), F.lit(0))
    return apart * 7 <= F.col("n") + F.col("k")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of those that may be similar."""
    return rows.where(_fits()).select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def links(texts: DataFrame) -> DataFrame:
    """(node, component) of all sets that are linked to another one.  Tables go as soon as what follows from them is written."""
    index = _index(texts, frequent(texts))
    group = Window.partitionBy("sig")
    chain = group.orderBy("node")
    lead = F.min(F.struct(~F.col("first"), "node", "n", "first")).over(group)
    spread = index.select("sig", *MEMBER, lead.alias("lead"), F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high"))
    shared = written(spread.where((F.col("low") != F.col("high")) & F.col("lead.first")).select("sig", *MEMBER, "lead"), "shared")
    near = shared.select(*MEMBER, "lead", F.lag(F.struct(*MEMBER)).over(chain).alias("prev"))
    to = F.explode(F.array_compact(F.array(F.struct(*[F.col(f"lead.{x}").alias(x) for x in MEMBER]), F.col("prev"))))
    pairs = written(_pairs(near.select(*MEMBER, to.alias("to")).select(*MEMBER, *_other("to"))), "pairs")
    free_shuffles()
    sets = _sets_table(texts, shared.select("node"))
    tried = _verified(sets, pairs)
    forget(pairs)
    free_shuffles()
    for turn in range(3):
        found = written(components(tried.where("near")), "components")
        named = shared.select("sig", *MEMBER).join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
        named = named.select("sig", *MEMBER, "label", F.min("label").over(group).alias("low"), F.max("label").over(group).alias("high")).where("low <> high")
        past, shared = shared, written(named.select("sig", *MEMBER, "label"), "shared")  # groups within one component are done with
        forget(past, found)
        if turn < 2:  # other leaders first: they join most of what belongs together
            lead = F.min(F.struct(~F.col("first"), F.xxhash64("node", F.lit(turn)), *MEMBER, "label")).over(group)
            split = shared.withColumn("lead", lead).where(F.col("lead.label") != F.col("label"))
            pairs = _pairs(split.select(*MEMBER, *_other("lead")))
        else:  # each pair of two components that shares a signature; after these nothing is left
            one = shared.distinct().join(by_shuffle(sets.select("node", "sketch").dropDuplicates(["node"])), "node")
            two = one.where("first").select("sig", *[F.col(x).alias(y) for x, y in zip(MEMBER, OTHER, strict=True)], F.col("label").alias("other"), F.col("sketch").alias("other_sketch"))
            pairs = _pairs(one.join(two, "sig").where(_fits() & (F.col("label") != F.col("other")) & _sketches_allow()))
        pairs = written(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        free_shuffles()
        tried = tried.union(_verified(sets, pairs))
        forget(pairs)
    forget(shared, sets)
    free_shuffles()
    return written(components(tried.where("near")), "components")


RESULT = T.StructType([T.StructField("n", T.LongType()), T.StructField("node", T.LongType())])


def _labelled(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(the kept columns under names of their own, n, node, row), (node, label, least), and those names.

    node is null without words; least is the least id of the label's documents
    (null if all of them are).
    """
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*keep, doc_id]))}
    texts = docs.select(text)
    out, name = annotate(docs, text, list(names), RESULT, _key)
    joined = links(texts)
    ident = names[doc_id]
    rows = written(out.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(name)["n"].alias("n"), F.col(name)["node"].alias("node"), F.monotonically_increasing_id().alias("row")), "rows")
    small = rows.where("node is not null").groupBy("node").agg(F.min(ident).alias("id")).join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("label"), "id")
    least = small.groupBy("label").agg(F.min("id").alias("least"))
    return rows, small.join(least, "label").select("node", "label", "least"), names


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each document (all by default) with n_shingles and component_id.

    component_id is the least id that can be reached by links of similarity
    0.75 or more, the document's own included.  Null and empty texts have no
    shingles and are linked with nothing; null ids don't count as least.
    Repeated rows and exact copies are one set.  Columns named like the new
    ones are replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_shingles", "component_id")]
    rows, labels, names = _labelled(docs, doc_id, text, keep)
    return rows.join(labels, "node", "left").select(*[F.col(names[c]).alias(c) for c in keep], F.col("n").alias("n_shingles"), F.coalesce("least", F.when(F.col("node").isNull(), F.col(names[doc_id]))).alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the least id (one without an id only where no row has any); all columns as they were.

    Of several rows with that id the one with the least set's name counts, then
    the first.  Rows without words are linked with nothing and all stay.
    """
    cols = docs.columns
    rows, labels, names = _labelled(docs, doc_id, text, cols)
    ident = F.col(names[doc_id])
    # texts are shuffled once, by row, when it is known which rows stay
    named = rows.where("node is not null").select("node", "row", ident).join(labels.select("node", "label"), "node")
    best = written(named.groupBy("label").agg(F.min(F.struct(ident.isNull(), ident, "node", "row")).alias("best")).select(F.col("best.row").alias("row")), "kept")
    free_shuffles()
    kept = rows.join(by_shuffle(best), "row", "left_semi").unionByName(rows.where("node is null"))
    return kept.select(*[F.col(names[c]).alias(c) for c in cols])


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, keep=["doc_id"])


def brute_force(rows: list[tuple]) -> dict:
    """{doc_id: (n_shingles, component_id)} by comparing all pairs, for tests."""
    import re

    sets, low = {}, {c: c + 32 for c in range(65, 91)}
    for d, t in rows:
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for x, y in combinations(ids, 2):
        c = len(sets[x] & sets[y])
        if c and 100 * c >= 75 * len(sets[x] | sets[y]):
            a, b = sorted((top(x), top(y)))
            up[b] = a
    return {d: (len(sets[d]), top(d)) for d in ids}
