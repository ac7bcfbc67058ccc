"""Decisions that depend on what came before under the same key: in batch form.

``strokewise.streaming.ordered`` has the same rules for streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seen_recently(prints: DataFrame, value: str, at: str, order: list[str], ttl: float) -> DataFrame:
    """The rows with whether their value came at most ttl before, anywhere; each sight counts anew.  Null values were never seen, and take no part in the window."""
    before = F.lag(at).over(Window.partitionBy(value).orderBy(at, *order))
    known = prints.where(F.col(value).isNotNull()).withColumn("seen", F.coalesce(F.col(at) - before <= ttl, F.lit(False)))
    return known.unionByName(prints.where(F.col(value).isNull()).withColumn("seen", F.lit(False)))


def consumed(tries: DataFrame, challenges: DataFrame, order: list[str]) -> DataFrame:
    """The tries with accepted and reason: the first valid try of a challenge consumes it.

    tries: challenge, binding, at; challenges: challenge, binding, expires.
    """
    rows = tries.join(challenges.select("challenge", F.col("binding").alias("_bound"), "expires"), "challenge", "left")
    valid = (F.col("binding") == F.col("_bound")) & (F.col("expires") > F.col("at"))
    rows = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    w = Window.partitionBy("challenge").orderBy(*order)
    done = F.coalesce(F.max("_valid").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_done", done)
    reason = F.when(F.col("_bound").isNull(), "challenge_not_found").when(F.col("_done"), "challenge_already_consumed").when(F.col("expires") <= F.col("at"), "challenge_expired").when(~F.col("_valid"), "challenge_binding_invalid").otherwise("consumed")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "consumed").drop("_bound", "_valid", "_done", "expires")


def delivery(batches: DataFrame, key: str, least_ratio: float = 0.35, least_corr: float = 0.80, least_batches: int = 3, short_ms: float = 800.0) -> DataFrame:
    """(key, ok, reason, n_batches): whether a drag's batches arrived as it went on.  batches: key, received, first, last, mean (of client times)."""
    sd = F.stddev_pop("mean") * F.stddev_pop("received")
    found = batches.groupBy(key).agg(F.count("*").alias("n_batches"), (F.max("last") - F.min("first")).cast("double").alias("client"), (F.max("received") - F.min("received")).cast("double").alias("server"), F.coalesce(F.when(sd > 0, F.covar_pop("mean", "received") / sd), F.lit(0.0)).alias("corr"))
    ratio = F.when(F.col("client") > 0, F.col("server") / F.col("client")).otherwise(0.0)
    reason = F.when(F.col("client") < short_ms, None).when(F.col("n_batches") < least_batches, "too_few_batches_for_timeline").when(ratio < least_ratio, "events_delivered_in_burst").when(F.col("corr") < least_corr, "delivery_timeline_uncorrelated")
    return found.select(key, reason.isNull().alias("ok"), reason.alias("reason"), "n_batches")


#: Marks of a key that are folded in one piece.
BLOCK = 4_096


def suspicion(marks: DataFrame, key: str, order: list[str], top: int = 30, threshold: int = 10) -> DataFrame:
    """(key, score, peak, flagged): a counter that rises and falls by `step` and never leaves 0..top; a null step sets it back to 0.

    What a block of marks does to the counter is again a shift between two
    bounds, so blocks are folded apart, where each begins follows from the
    blocks before it, and no task folds all of a key's marks.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = marks.select(key, number.alias("_n"), F.col("step").cast("long").alias("step")).withColumn("_block", F.floor(F.col("_n") / BLOCK))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_n", "step"))), lambda x: x["step"])  # a block of marks
    blocks = rows.groupBy(key, "_block").agg(steps.alias("s"))
    long = lambda v: F.lit(v).cast("long")
    clamp = lambda v, low, high: F.least(high, F.greatest(low, v))

    def then(f: Column, shift: Column, low: Column, high: Column) -> Column:
        return F.struct((f["shift"] + shift).alias("shift"), clamp(f["low"] + shift, low, high).alias("low"), clamp(f["high"] + shift, low, high).alias("high"))

    nothing = F.struct(long(0).alias("shift"), long(0).alias("low"), long(top).alias("high"))
    effect = F.aggregate("s", nothing, lambda f, x: F.when(x.isNull(), F.struct(long(0).alias("shift"), long(0).alias("low"), long(0).alias("high"))).otherwise(then(f, x, long(0), long(top))))
    past = F.collect_list("f").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # one for each block
    begin = F.aggregate("past", long(0), lambda now, f: clamp(now + f["shift"], f["low"], f["high"]))
    blocks = blocks.withColumn("f", effect).withColumn("past", past).withColumn("begin", begin)

    def step(acc: Column, x: Column) -> Column:
        now = F.when(x.isNull(), long(0)).otherwise(clamp(acc["now"] + x, long(0), long(top)))
        return F.struct(now.alias("now"), F.greatest(acc["peak"], now).alias("peak"))

    done = blocks.withColumn("s", F.aggregate("s", F.struct(F.col("begin").alias("now"), long(0).alias("peak")), step))
    out = done.groupBy(key).agg(F.max_by("s.now", "_block").alias("score"), F.max("s.peak").alias("peak"))
    return out.select(key, "score", "peak", (F.col("peak") >= threshold).alias("flagged"))


def chained(receipts: DataFrame, key: str = "session") -> DataFrame:
    """(session, ok, reason, n): receipts numbered from 0 without a gap, each holding the digest of the one before.

    receipts: session, seq, digest, previous.
    """
    w = Window.partitionBy(key).orderBy("seq")
    rows = receipts.withColumns({"_gap": F.col("seq") != F.row_number().over(w) - 1, "_broken": F.coalesce(F.lag("digest").over(w), F.lit("")) != F.coalesce("previous", F.lit(""))})
    found = rows.groupBy(key).agg(F.bool_or("_gap").alias("gap"), F.bool_or("_broken").alias("broken"), F.count("*").alias("n"))
    reason = F.when(F.col("gap"), "sequence_gap").when(F.col("broken"), "chain_broken")
    return found.select(key, reason.isNull().alias("ok"), reason.alias("reason"), "n")


def fresh(rows: DataFrame, stored: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """Idempotent ingest: the rows whose id isn't stored yet, the first of each id."""
    first = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    return rows.join(stored.select(ident), ident, "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Both tables' rows, of each key the one of the highest version."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return old.unionByName(new).withColumn("_n", rank).where("_n = 1").drop("_n")
