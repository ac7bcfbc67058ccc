"""Thresholds, limits, rankings and held-out families against loops over all candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokewise.operators import pair_signals, scorers, study


def frame(spark, scores, replay, fold):
    return spark.createDataFrame([(float(s), bool(r), int(f)) for s, r, f in zip(scores, replay, fold, strict=True)], "score double, replay boolean, fold int")


@pytest.mark.parametrize("budget", [0.0, 0.05, 0.3, 1.0])
def test_replay_thresholds(spark, budget):
    rng = np.random.default_rng(int(100 * budget))
    score, replay, fold = np.round(rng.random(90), 2), rng.random(90) < 0.4, rng.integers(0, 3, 90)
    rows = frame(spark, score, replay, fold)
    for by in (None, "fold"):
        best = None
        for c in sorted({*score, 0.5, 1.0}):
            groups = [np.ones(90, bool)] + ([fold == f for f in range(3)] if by else [])
            if all((score[~replay & g] >= c).mean() <= budget for g in groups):
                recall = (score[replay] >= c).mean()
                if best is None or recall >= best[1]:
                    best = (c, recall)
        got = study.replay_threshold(rows, "replay", "score", budget, by).first()
        want = best or (1.0, 0.0)
        assert (got.threshold, got.replay_recall) == pytest.approx(want)
        assert got.human_flagged == pytest.approx((score[~replay] >= want[0]).mean())
    for odd in (rows.where("replay"), rows.where("not replay"), rows.limit(0)):
        assert tuple(study.replay_threshold(odd, "replay", "score", budget).first()) == (None, None, None)
    high = frame(spark, [1.0, 1.0, 0.2], [False, False, True], [0, 0, 0])
    assert study.replay_threshold(high, "replay", "score", 0.0).first().threshold == 1.0


def test_rate_limits(spark):
    rng = np.random.default_rng(4)
    for counts in ([0, 0, 0], [0, 1, 1, 2, 9], rng.integers(0, 12, 50).tolist()):
        table = spark.createDataFrame([(int(c),) for c in counts], "c int")
        for budget in (0.0, 0.01, 0.3, 1.0):
            want = next(limit for limit in range(1, max(counts) + 2) if np.mean(np.array(counts) >= limit) <= budget)
            got = study.rate_limit(table, "c", budget).first()
            assert (got.limit, got.human_flagged) == (want, pytest.approx(np.mean(np.array(counts) >= want)))
    assert tuple(study.rate_limit(table.limit(0), "c").first()) == (None, None)


def test_people_and_guard(spark):
    rows = spark.createDataFrame([("a", None), ("b", "development_only"), ("c", "development_only"), (None, None)], "participant string, training_usage string")
    aliases = spark.createDataFrame([("b", "a"), ("b", "z"), ("c", None)], "code string, person string")
    assert sorted(map(str, (r.person for r in study.people(rows, aliases).collect()))) == ["None", "a", "a", "c"]
    assert study.development_only(rows).count() == 4
    with pytest.raises(Exception, match="held-out"):
        study.development_only(rows.union(spark.createDataFrame([("d", "lockbox")], rows.schema))).collect()


def test_families_left_out(spark):
    rng = np.random.default_rng(6)
    kinds = {"human": (2.0, 2.0), "x": (0.0, 0.0), "y": (0.0, 2.5), "z": (2.1, 2.1)}
    rows = [(f"{k}{i}", None if k == "human" else k, k == "human", *map(float, rng.normal(kinds[k], 0.3))) for k in kinds for i in range(40)]
    table = spark.createDataFrame(rows, "attempt_id string, family string, human boolean, f double, g double")

    def fit(train):
        model = scorers.fit(train, ("f", "g"), "random_forest", trees=10, depth=4)
        return lambda t: scorers.probability(t, model, ("f", "g"), "score")

    got = {r.family: (r.bots, r.bot_recall) for r in study.families_left_out(table, "family", "human", fit, 0.5).collect()}
    assert set(got) == {"x", "y", "z"} and all(n == 40 for n, _ in got.values())
    assert got["x"][1] > 0.9 and got["z"][1] < 0.6  # a family among the humans is only caught if it was seen
    with pytest.raises(ValueError):
        study.families_left_out(table.where("human"), "family", "human", fit, 0.5)


def test_replay_model_over_pair_signals(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2 == 0, *[float(np.clip(rng.normal(0.8 if i % 2 == 0 else 0.5, 0.1), 0, 1)) for _ in pair_signals.SIGNALS]) for i in range(120)]
    table = spark.createDataFrame(rows, ["pair", "replay", *pair_signals.SIGNALS])
    made = study.replay_scores(table, study.replay_model(table.where("pair < 80"), "replay", "pair")).where("pair >= 80")
    assert made.where((F.col("replay_score") >= 0.5) == F.col("replay")).count() >= 38
