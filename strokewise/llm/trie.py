"""A trie of conversations' common beginnings, built level by level.

Each turn is named by 128 bits of its role and text.  Conversations that are
the same throughout are one class with a weight, so copies never walk down
together.  At each depth the live classes are grouped by the node they stand
in and their next turn; a group is a node, named by its least conv_id.  A
class that is alone in its node leaves the levels: what is below is a chain,
written at once.  Then leaves and savings are rolled up, from the deepest
level to the root, by joins of children to parents.

So there are as many rounds as the longest beginning that two different
conversations share has turns, each of a few shuffles of live classes; a
group is an aggregate of minima and sums, and hot keys of the joins are
split by adaptive execution.

Turns without a conv_id belong to no conversation.  Turns of one number are
ordered by role, then text; null numbers come first; repeated turns count
each.  Without conversations there is no root.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _ranges
from ._columns import words
from ._tables import forget, written

#: Contract's rebuilding: conversations of a family take their first turns from its least.
FAMILY, MOST_TAKEN = 20, 4
#: Turns in a block of running sums.
BLOCK = 4_096

EMPTY = hashlib.sha256(b"").hexdigest()


def named(conversations: DataFrame) -> DataFrame:
    """(c, place, total, k1, k2, words) of each turn: its place in its conversation (from 0), whose total it has, its name, its text's words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").alias("c"), "turn", role.alias("role"), text.alias("text"))
    ties = F.row_number().over(Window.partitionBy("c", "turn").orderBy("role", "text"))
    names = [F.xxhash64(F.lit(i), "role", "text").alias(f"k{i + 1}") for i in (0, 1)]
    turns = written(turns.select("c", "turn", ties.alias("tie"), *names, F.size(words(F.col("text"))).cast("long").alias("words")), "turns")
    out = written(_ranges.positions(turns, ["c"], [F.asc_nulls_first("turn"), F.asc("tie")], "placed").drop("turn", "tie"), "named")
    forget(turns)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns as (c, d, k1, k2, words), conversations as (c)): each conversation after the first turns of its family's least.

    d counts from 1.  How many turns are taken follows from the conv_id.
    """
    convs = turns.groupBy("c").agg(F.max("total").alias("total"))
    taken = F.crc32(F.col("c").cast("string")) % MOST_TAKEN
    convs = convs.withColumn("h", taken).withColumn("family", F.col("c") - F.col("c") % FAMILY)
    heads = convs.select(F.col("c").alias("family"), F.col("total").alias("first"))
    convs = written(convs.join(heads, "family", "left").select("c", "h", "family", "total", F.least("h", F.coalesce("first", F.lit(0))).alias("got")), "convs")
    part = F.floor(F.col("place") / _ranges.ROWS)  # a conversation may have any number of turns
    parts = convs.select("c", "h", "got", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / _ranges.ROWS))).alias("part"))
    own = turns.withColumn("part", part).join(parts, ["c", "part"]).where("place >= h").select("c", (F.col("place") - F.col("h") + F.col("got") + 1).alias("d"), "k1", "k2", "words")
    first = turns.where(F.col("place") < MOST_TAKEN - 1).withColumnRenamed("c", "family")
    start = convs.select("c", "family", "h").join(first, "family").where("place < h").select("c", (F.col("place") + 1).alias("d"), "k1", "k2", "words")
    return own.union(start), convs.select("c")


def _classes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (c, cid), classes (cid, weight, len)): conversations that are the same throughout, named by their least id."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "d", "k1", "k2")).alias(f"s{i}") for i in (0, 1)]
    whole = turns.groupBy("c").agg(*marks, F.count("*").alias("len"))
    whole = written(convs.join(whole, "c", "left").select("c", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("s0", "s1", "len")]), "whole")
    classes = written(whole.groupBy("s0", "s1", "len").agg(F.min("c").alias("cid"), F.count("*").alias("weight")), "classes")
    return whole.join(classes.where("weight > 1"), ["s0", "s1", "len"]).select("c", "cid"), classes.select("cid", "weight", "len")


def _ends(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, ends_sha256) of each class: its members' ids, read one after the other from a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for of, c in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if of == cid:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((cid, state.hexdigest()))
                    cid, state = of, hashlib.sha256()
                state.update(str(c).encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["cid", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([cid], pa.int64()), pa.array([state.hexdigest()])], names=["cid", "ends"])

    many = members.select(F.col("cid").cast("long").alias("cid"), F.col("c").cast("long").alias("c")).repartition("cid").sortWithinPartitions("cid", "c").mapInArrow(run, "cid long, ends string")
    return many.union(classes.where("weight = 1").select("cid", F.sha2(F.col("cid").cast("string"), 256)))


def _sums_below(rows: DataFrame) -> DataFrame:
    """(cid, d, rest): for each row of a chain the sum of value from it to the chain's end, by blocks of depths."""
    rows = rows.withColumn("block", F.floor(F.col("d") / BLOCK))
    near = F.sum("value").over(Window.partitionBy("cid", "block").orderBy(F.desc("d")))
    blocks = rows.groupBy("cid", "block").agg(F.sum("value").alias("all"))
    far = F.sum("all").over(Window.partitionBy("cid").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("cid", "block", F.coalesce(far, F.lit(0)).alias("far"))
    return rows.withColumn("near", near).join(blocks, ["cid", "block"]).select("cid", "d", (F.col("near") + F.col("far")).alias("rest"))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the trie.

    turns: (c, d, k1, k2, words), d counting from 1 without gaps; convs: (c)
    of all conversations, those without turns among them.
    """
    members, classes = _classes(turns, convs)
    turns = written(turns.join(classes.select(F.col("cid").alias("c")), "c", "left_semi").withColumnRenamed("c", "cid").sortWithinPartitions("d"), "turns")
    root = classes.agg(F.min("cid").alias("conv"), F.sum("weight").alias("n")).where("n > 0")

    levels: list[DataFrame] = []  # (cid, weight, len, parent, conv, n, m, words): each live class and its node, in which are m classes
    live = classes.where("len > 0").crossJoin(F.broadcast(root.select(F.col("conv").alias("parent"))))  # one row
    while not live.isEmpty():
        key = ["parent", "k1", "k2"]
        step = live.join(turns.where(F.col("d") == len(levels) + 1).drop("d"), "cid")
        nodes = step.groupBy(*key).agg(F.min("cid").alias("conv"), F.sum("weight").alias("n"), F.count("*").alias("m"))
        levels.append(written(step.join(nodes, key).drop("k1", "k2"), "level"))
        live = levels[-1].where((F.col("m") > 1) & (F.col("len") > len(levels))).select("cid", "weight", "len", F.col("conv").alias("parent"))

    alone = [x.where((F.col("m") == 1) & (F.col("len") > i)).select("cid", "weight", "len", F.lit(i).alias("left")) for i, x in enumerate(levels, 1)]
    none = classes.limit(0)
    alone_ = reduce(DataFrame.union, alone, none.select("cid", "weight", "len", F.lit(0).alias("left")))
    chains = written(turns.join(alone_, "cid").where("d > left").select("cid", "d", "weight", "len", ((F.col("weight") - 1) * F.col("words")).alias("value")), "chains")
    below = chains.groupBy("cid").agg(F.sum("value").alias("more"))
    rest = _sums_below(chains.where("weight > 1"))
    chains = chains.join(rest, ["cid", "d"], "left")
    out = [chains.select(F.col("cid").alias("conv"), F.col("d").alias("depth"), F.col("cid").alias("parent"), F.col("weight").alias("n"), F.when(F.col("d") < F.col("len"), 1).otherwise(0).alias("children"), F.lit(1).alias("leaves"), _zero("rest").alias("saved"))]

    under = None  # (parent, children, leaves, saved) from the level below
    for i in range(len(levels), -1, -1):
        if i:
            nodes = levels[i - 1].where("cid = conv").select("conv", F.lit(i).alias("depth"), "parent", "n", ((F.col("n") - 1) * F.col("words")).alias("own"))
            nodes = nodes.join(below.withColumnRenamed("cid", "conv").join(alone[i - 1].select(F.col("cid").alias("conv")), "conv", "left_semi"), "conv", "left")
        else:
            nodes = root.select("conv", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), "n", F.lit(0).alias("own"), F.lit(None).cast("long").alias("more"))
        if under is None:
            under = none.select(F.col("cid").alias("parent"), *[F.col("weight").alias(c) for c in ("children", "leaves", "saved")])
        nodes = nodes.join(under.withColumnRenamed("parent", "conv"), "conv", "left")
        chain = F.col("more").isNotNull()
        sums = nodes.select("conv", "depth", "parent", "n", F.when(chain, 1).otherwise(_zero("children")).alias("children"), F.when(chain, 1).otherwise(F.coalesce("leaves", F.lit(1))).alias("leaves"), (F.col("own") + _zero("more") + _zero("saved")).alias("saved"))
        out.append(written(sums, "sums"))
        under = out[-1].groupBy("parent").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    last = [x.where(F.col("len") == i).select("cid", "conv", F.lit(i).cast("long").alias("depth")) for i, x in enumerate(levels, 1)]
    last += [alone_.select("cid", F.col("cid").alias("conv"), F.col("len").alias("depth")), classes.where("len = 0").select("cid", F.col("cid").alias("conv"), F.col("len").alias("depth")).crossJoin(F.broadcast(root.select(F.col("conv").alias("top")))).select("cid", F.col("top").alias("conv"), "depth")]
    ends = reduce(DataFrame.union, last).join(_ends(members, classes), "cid").drop("cid")
    nodes = reduce(DataFrame.union, out).join(ends, ["conv", "depth"], "left")
    names = {"conv": "conv_id", "depth": "depth", "parent": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    return nodes.select(*[F.col(k).cast("long").alias(v) for k, v in names.items()], F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(named(conversations)))
