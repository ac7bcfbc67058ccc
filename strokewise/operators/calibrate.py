"""Thresholds that keep every fold and every person within a budget of rejections, and out-of-fold scores to take them from."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import confusion, share
from .running import running
from .splits import hash_order

#: Share of humans that may be rejected, and the score that is always a candidate.
BUDGET, HALF = 0.03, 0.5


def group_key(label: str = "label", participant: str = "participant", family: str = "family", generator: str = "generator") -> Column:
    """What must not be split between training and judging: a person, or a bot family's generator; null for humans whose person isn't known."""
    person = F.when(F.trim(F.col(participant)) != "", F.concat_ws("::", F.lit("human"), F.col(participant)))
    named = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    bot = F.concat_ws("::", F.lit("bot"), named(family, "unknown_family"), named(generator, "unknown_generator"))
    return F.when(F.col(label) == "human", person).otherwise(bot)


def counts(rows: DataFrame, human: str, score: str, *keys: str) -> DataFrame:
    """(keys, score, humans, bots): all that thresholds depend on.  Rows without a score or label have no say."""
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(human).isNotNull())
    return known.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(human)).alias("humans"), F.count_if(~F.col(human)).alias("bots"))


def limits(held: DataFrame, budget: float, *keys: str) -> DataFrame:
    """(keys, humans, bots, limit): the greatest threshold that rejects no more than the budget of a group's humans; null for none in it.

    Above a group's greatest score only a budget of 1 can be kept.
    """
    sums = lambda h, b: [F.sum("humans").alias(h), F.sum("bots").alias(b)]
    each = held.groupBy(*keys, "score").agg(*sums("humans", "bots"))
    totals = each.groupBy(*keys).agg(*sums("_humans", "_bots")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    ranked = running(each, "score", {"below": "humans"}, by=keys)
    if keys:
        joined = ranked.join(totals, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]))
    else:
        joined = ranked.crossJoin(F.broadcast(totals))  # one row
    kept = F.max(F.when((F.col("humans") > 0) & (F.col("below") / F.nullif(F.col("_humans"), F.lit(0)) <= budget), F.col("score")))
    top = F.when(F.lit(budget >= 1.0) & (F.max("_humans") > 0), F.lit(float("inf"))).otherwise(kept)
    return joined.groupBy(*keys).agg(F.max("_humans").alias("humans"), F.max("_bots").alias("bots"), top.alias("limit"))


def threshold(held: DataFrame, budget: float = BUDGET, pooled: bool = True, per: tuple[tuple[str, ...], ...] = (), both: bool = False) -> DataFrame:
    """(threshold, human_rejected, bot_recall): one row, from counts (see ``counts``).

    Candidates are all scores and a half.  Rejections grow with the threshold,
    so each group allows all thresholds up to a limit; of those within all
    limits the greatest catches the most bots.  pooled bounds all humans
    together; each of per names keys whose groups are bounded each (groups
    without humans bound nothing; with both, every group must hold humans and
    bots).  Without humans or bots, or where both fails, the threshold is null.
    """
    every = held.groupBy("score").agg(F.sum("humans").alias("humans"), F.sum("bots").alias("bots"))
    bounds = [limits(held, budget).withColumn("_pooled", F.lit(True))] + [limits(held, budget, *keys).select("humans", "bots", "limit").withColumn("_pooled", F.lit(False)) for keys in per]
    bound = reduce(DataFrame.union, bounds)
    counted = F.lit(True) if pooled else ~F.col("_pooled")
    lacking = F.count_if((F.col("humans") == 0) | (F.col("bots") == 0)) if both else F.count_if(F.col("_pooled") & ((F.col("humans") == 0) | (F.col("bots") == 0)))
    bound = bound.agg(F.min(F.when(counted, F.col("limit"))).alias("_limit"), F.coalesce(lacking, F.lit(0)).alias("_lacking"), F.max(F.when(F.col("_pooled"), F.col("humans"))).alias("_humans"), F.max(F.when(F.col("_pooled"), F.col("bots"))).alias("_bots"))
    candidates = F.array_max(F.filter(F.array(F.col("_score"), F.when(F.lit(HALF) <= F.col("_limit"), F.lit(HALF))), lambda c: c.isNotNull()))
    best = every.crossJoin(F.broadcast(bound))  # one row of bounds
    best = best.agg(F.max("_limit").alias("_limit"), F.max("_lacking").alias("_lacking"), F.max("_humans").alias("_humans"), F.max("_bots").alias("_bots"), F.max(F.when(F.col("score") <= F.col("_limit"), F.col("score"))).alias("_score"))
    best = best.select(F.when((F.col("_lacking") == 0) & (F.col("_humans") > 0), candidates).alias("_at"), "_humans", "_bots")
    at = every.crossJoin(F.broadcast(best))  # one row
    below = lambda c: F.coalesce(F.sum(F.when(F.col("score") < F.col("_at"), F.col(c))), F.lit(0))
    out = at.agg(F.max("_at").alias("threshold"), F.max("_humans").alias("_h"), F.max("_bots").alias("_b"), below("humans").alias("_hb"), below("bots").alias("_bb"))
    known = F.col("threshold").isNotNull()
    return out.select("threshold", F.when(known, share(F.col("_hb"), F.col("_h"))).alias("human_rejected"), F.when(known, share(F.col("_bb"), F.col("_b"))).alias("bot_recall"))


def folds(rows: DataFrame, group: str, stratum: str, n: int, salt: str = "fold") -> DataFrame:
    """The rows with ``fold``, 0 to n-1: groups whole, their rows shared out evenly within each stratum.

    Groups stand in the order of a salted hash; a group's fold is the one in
    which the middle of its rows falls.  A null group has no fold, and its
    rows get null.
    """
    sizes = rows.where(F.col(group).isNotNull()).groupBy(stratum, group).agg(F.count("*").alias("_n"))
    order, part = hash_order(group, salt)
    placed = running(sizes.withColumn("_order", order), "_order", {"_before": "_n"}, by=(stratum,), part=part)
    total = sizes.groupBy(F.col(stratum).alias("_s")).agg(F.sum("_n").alias("_all"))
    placed = placed.join(total, F.col(stratum).eqNullSafe(F.col("_s")))
    fold = F.least(F.lit(n - 1), F.floor((F.col("_before") + F.col("_n") / 2) * n / F.col("_all"))).cast("int")
    chosen = placed.select(F.col(stratum).alias("_s"), F.col(group).alias("_g"), fold.alias("fold"))
    return rows.join(chosen, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col(group) == F.col("_g")), "left").drop("_s", "_g")


def possible_folds(rows: DataFrame, group: str, human: str, n: int) -> int:
    """n, or as many as the class of fewest groups allows; an error below two."""
    groups = rows.where(F.col(group).isNotNull()).groupBy(human, group).count().groupBy(human).count().collect()  # two rows
    most = min([n, *(r["count"] for r in groups)]) if len(groups) == 2 else 0
    if most < 2:
        raise ValueError("calibration needs at least two groups of humans and of bots")
    return most


def out_of_fold(rows: DataFrame, n: int, fit: Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows of each fold as scored by what ``fit`` makes of the others: n fits."""
    made = [fit(rows.where(F.col("fold") != i), i)(rows.where(F.col("fold") == i)) for i in range(n)]
    return reduce(DataFrame.unionByName, made)


def fold_report(scored: DataFrame, held: DataFrame, budget: float, at: float, human: str = "human", score: str = "score", group: str = "group") -> DataFrame:
    """(fold, humans, bots, human_groups, bot_groups, standalone_threshold, human_rejected, bot_recall) at a shared threshold; standalone ones bound their own fold only."""
    alone = limits(held, budget, "fold").select("fold", F.col("limit").alias("standalone_limit"))
    scores = held.select("fold", "score").union(held.select("fold", F.lit(HALF)).distinct())
    alone = scores.join(alone, "fold").where("score <= standalone_limit").groupBy("fold").agg(F.max("score").alias("standalone_threshold"))
    h, low = F.col(human), F.col(score) < at
    groups = scored.groupBy("fold", group).agg(F.max(h).alias("h"), F.count_if(h).alias("nh"), F.count_if(~h).alias("nb"), F.count_if(h & low).alias("fr"), F.count_if(~h & low).alias("tb")).groupBy("fold")
    out = groups.agg(F.sum("nh").alias("humans"), F.sum("nb").alias("bots"), F.count_if("h").alias("human_groups"), F.count_if(~F.col("h")).alias("bot_groups"), share(F.sum("fr"), F.sum("nh")).alias("human_rejected"), share(F.sum("tb"), F.sum("nb")).alias("bot_recall"))
    return out.join(alone, "fold", "left").select("fold", "humans", "bots", "human_groups", "bot_groups", "standalone_threshold", "human_rejected", "bot_recall")


def pooled_report(scored: DataFrame, at: float, human: str = "human", score: str = "score") -> DataFrame:
    return confusion(scored.withColumn("_p", F.col(score) >= at), human, "_p")
