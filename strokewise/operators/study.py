"""Choices and gates of evaluation runs: thresholds against replays, rate limits, rankings of models, families held out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scorers
from .evaluate import share
from .pair_signals import SIGNALS
from .running import running

#: Candidates that are always there, and the gates of a ranking.
HALF, FULL = 0.5, 1.0
GATES = {"experiment_human": 0.03, "deployment_human": 0.01, "known_asr": 0.05, "unseen_asr": 0.10, "replay_asr": 0.05}


def _floor(held: DataFrame, budget: float, *keys: str) -> DataFrame:
    """(keys, negatives, positives, floor): thresholds above the floor flag no more than the budget of a group's negatives; null if all do."""
    each = held.groupBy(*keys, "score").agg(F.sum("negatives").alias("negatives"), F.sum("positives").alias("positives"))
    totals = each.groupBy(*keys).agg(F.sum("negatives").alias("_n"), F.sum("positives").alias("_p")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    ranked = running(each, "score", {"above": "negatives"}, descending=True, by=keys)
    joined = ranked.join(totals, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])) if keys else ranked.crossJoin(F.broadcast(totals))  # one row
    over = (F.col("negatives") > 0) & ((F.col("above") + F.col("negatives")) / F.nullif(F.col("_n"), F.lit(0)) > budget)
    return joined.groupBy(*keys).agg(F.max("_n").alias("negatives"), F.max("_p").alias("positives"), F.max(F.when(over, F.col("score"))).alias("floor"))


def replay_threshold(rows: DataFrame, replay: str, score: str, budget: float, fold: str | None = None) -> DataFrame:
    """(threshold, replay_recall, human_flagged): one row, of the threshold from which on scores are called replays.

    It flags no more than the budget of humans, of all and in each fold, and
    catches the most replays; of equal ones it is the greatest.  Candidates are
    all scores, a half and 1; where none keeps the budget it is 1.  Null
    without humans or replays, of all or in a fold.
    """
    keys = [fold] if fold else []
    known = rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(replay).isNotNull())
    held = known.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count_if(~F.col(replay)).alias("negatives"), F.count_if(F.col(replay)).alias("positives"))
    floors = _floor(held, budget)
    if fold:
        floors = floors.union(_floor(held, budget, fold).select("negatives", "positives", "floor"))
    bound = floors.agg(F.max("floor").alias("_floor"), F.coalesce(F.count_if((F.col("negatives") == 0) | (F.col("positives") == 0)), F.lit(0)).alias("_lacking"))
    every = held.groupBy("score").agg(F.sum("negatives").alias("negatives"), F.sum("positives").alias("positives"))
    free = lambda c: F.coalesce(c > F.col("_floor"), F.lit(True))
    own = every.crossJoin(F.broadcast(bound))  # one row
    best = own.agg(
        F.min(F.when((F.col("positives") > 0) & free(F.col("score")), F.col("score"))).alias("_hit"),
        F.max(F.when(free(F.col("score")), F.col("score"))).alias("_top"),
        F.max("_floor").alias("_floor"),
        F.max("_lacking").alias("_lacking"),
        F.count("*").alias("_n"),
    )
    greatest = F.array_max(F.array_compact(F.array("_top", *[F.when(free(F.lit(c)), F.lit(c)) for c in (HALF, FULL)])))
    at = F.when((F.col("_n") > 0) & (F.col("_lacking") == 0), F.coalesce("_hit", greatest, F.lit(FULL)))
    out = every.crossJoin(F.broadcast(best.select(at.alias("threshold"))))  # one row
    from_ = F.col("score") >= F.col("threshold")
    sums = out.agg(F.max("threshold").alias("threshold"), *[F.coalesce(F.sum(F.when(from_, F.col(c))), F.lit(0)).alias(f"_{c}") for c in ("positives", "negatives")], F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    there = F.col("threshold").isNotNull()
    return sums.select("threshold", F.when(there, share(F.col("_positives"), F.col("p"))).alias("replay_recall"), F.when(there, share(F.col("_negatives"), F.col("n"))).alias("human_flagged"))


def rate_limit(counts: DataFrame, count: str, budget: float = 0.01) -> DataFrame:
    """(limit, human_flagged): the smallest number of earlier attempts, 1 at least, that no more than the budget of humans reach; null without rows."""
    each = counts.where(F.col(count).isNotNull()).groupBy(F.col(count).cast("double").alias("v")).agg(F.count("*").alias("c"))
    total = each.agg(F.sum("c").alias("n"))
    ranked = running(each, "v", {"above": "c"}, descending=True).crossJoin(F.broadcast(total))  # one row
    over = F.max(F.when((F.col("above") + F.col("c")) / F.col("n") > budget, F.col("v")))
    limit = ranked.agg(over.alias("t"), F.max("n").alias("n")).select(F.when(F.col("n").isNotNull(), F.greatest(F.lit(1), F.coalesce(F.col("t"), F.lit(0.0)).cast("long") + 1)).alias("limit"))
    flagged = each.crossJoin(F.broadcast(limit)).agg(F.max("limit").alias("limit"), F.sum(F.when(F.col("v") >= F.col("limit"), F.col("c")).otherwise(0)).alias("f"), F.sum("c").alias("n"))  # one row
    return flagged.select("limit", F.when(F.col("limit").isNotNull(), F.col("f") / F.col("n")).alias("human_flagged"))


def ranked_models(tests: DataFrame, families: DataFrame, external: DataFrame) -> DataFrame:
    """Models that reject few enough humans everywhere, with their gates and place.

    tests: model, human_rejected, bot_recall, f1, ms; families (each held out
    once): model, family, human_rejected, bot_recall; external: model, asr,
    fresh.  First come models that pass the experiment's gates, then those of
    the least worst unseen share of bots let through, then of known ones, then
    by mean recall, F1 and speed.
    """
    f = families.groupBy(F.col("model").alias("_fm")).agg(F.max("human_rejected").alias("_fr"), F.min("bot_recall").alias("least_recall"), F.avg("bot_recall").alias("mean_recall"), F.max(1 - F.col("bot_recall")).alias("_fa"), F.max(F.when(F.col("family") == "replay_warp", 1 - F.col("bot_recall"))).alias("_replay"))
    e = external.groupBy(F.col("model").alias("_em")).agg(F.max("asr").alias("_ea"), F.max(F.when(F.col("fresh"), F.col("asr"))).alias("_fresh"))
    rows = tests.join(f, F.col("model") == F.col("_fm"), "left").join(e, F.col("model") == F.col("_em"), "left")
    rows = rows.withColumns({"worst_human_rejected": F.greatest("human_rejected", "_fr"), "known_asr": 1 - F.col("bot_recall"), "worst_unseen_asr": F.coalesce(F.greatest("_fa", "_ea"), F.lit(1.0)), "replay_asr": F.coalesce("_replay", F.lit(1.0)), "least_recall": F.coalesce("least_recall", F.lit(0.0)), "mean_recall": F.coalesce("mean_recall", F.lit(0.0))})
    rows = rows.where(F.col("worst_human_rejected") <= GATES["experiment_human"])
    experiment = (F.col("known_asr") <= GATES["known_asr"]) & (F.col("worst_unseen_asr") <= GATES["unseen_asr"]) & (F.col("replay_asr") <= GATES["replay_asr"])
    shadow = F.col("experiment") & (F.col("human_rejected") <= GATES["experiment_human"]) & F.coalesce(F.col("_fresh") <= GATES["known_asr"], F.lit(False))
    rows = rows.withColumn("experiment", experiment).withColumn("shadow", shadow).withColumn("deployment", F.col("shadow") & (F.col("human_rejected") <= GATES["deployment_human"]))
    order = [F.desc("experiment"), F.asc("worst_unseen_asr"), F.asc("known_asr"), F.desc("mean_recall"), F.desc("f1"), F.asc_nulls_last("ms"), F.asc("model")]
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "model", "experiment", "shadow", "deployment", "worst_human_rejected", "known_asr", "worst_unseen_asr", "replay_asr", "least_recall", "mean_recall")  # a few models


def people(rows: DataFrame, aliases: DataFrame, code: str = "participant") -> DataFrame:
    """The rows with ``person``: whom the code stands for, or the code itself.  aliases: code, person, one row for each code (of several the least person)."""
    known = aliases.where(F.col("person").isNotNull()).groupBy(F.col("code").alias("_code")).agg(F.min("person").alias("_person"))
    return rows.join(known, F.col(code) == F.col("_code"), "left").withColumn("person", F.coalesce("_person", F.col(code))).drop("_code", "_person")


def development_only(rows: DataFrame, usage: str = "training_usage", allowed: str = "development_only") -> DataFrame:
    """The rows, each of which must be free for training; one that is not fails the query."""
    ok = F.coalesce(F.col(usage) == allowed, F.lit(True))
    return rows.withColumn(usage, F.when(ok, F.col(usage)).otherwise(F.raise_error(F.lit("held-out data must not be trained on")).cast("string")))


def families_left_out(rows: DataFrame, family: str, human: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], threshold: float) -> DataFrame:
    """(family, bots, bot_recall): each bot family as seen by what ``fit`` makes of all other rows; one fit for each family."""
    names = [r[0] for r in rows.where(~F.col(human) & F.col(family).isNotNull()).select(family).distinct().orderBy(family).collect()]  # a few families
    made = []
    for name in names:
        score = fit(rows.where(F.col(human) | (F.col(family) != name)))
        held = score(rows.where(~F.col(human) & (F.col(family) == name)))
        made.append(held.agg(F.lit(name).alias("family"), F.count("*").alias("bots"), F.avg((F.col("score") < threshold).cast("double")).alias("bot_recall")))
    if not made:
        raise ValueError("no bot families")
    return reduce(DataFrame.unionByName, made)


def replay_model(pairs: DataFrame, replay: str, ident: str, kind: str = "logistic_regression", seed: int = 42) -> PipelineModel:
    """A model of whether a pair is a replay, over the pair signals."""
    return scorers.fit(pairs, SIGNALS, kind, human=replay, ident=ident, seed=seed, trees=50, depth=5)


def replay_scores(pairs: DataFrame, model: PipelineModel) -> DataFrame:
    """The pairs with replay_score."""
    return scorers.probability(pairs, model, SIGNALS, "replay_score")
