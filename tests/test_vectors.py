"""Paths that don't move, are too short or not finite, as arrays of fixed length."""

import numpy as np
from pyspark.sql import functions as F

from strokewise.operators import pair_signals, vectors


def rows(paths):
    return [(k, s, float(x), float(y), float(t)) for k, p in paths.items() for s, (x, y, t) in enumerate(p)]


def test_degenerate_paths(spark):
    line = [(0, 0, 0), (1, 1, 10), (2, 4, 20)]
    paths = {"line": line, "turned": [(5 - 2 * y, 3 + 2 * x, 7 + 3 * t) for x, y, t in line], "round": [(1, 1, 5), (2, 2, 5), (1, 1, 5)], "one": [(1, 1, 1)], "nan": [(0, 0, 0), (float("nan"), 1, 1), (1, 1, 2)], "still": [(3, 3, 0)] * 4}
    table = spark.createDataFrame(rows(paths), "attempt_id string, seq int, x double, y double, t double")
    held = pair_signals.paths(table, ["attempt_id"])
    got = {r.attempt_id: np.array([r.p.xs, r.p.ys, r.p.ts]).T for r in held.select("attempt_id", vectors.canonical(F.col("path")).alias("p")).where("attempt_id <> 'nan'").collect()}
    assert all(v.shape == (64, 3) for v in got.values())
    assert np.allclose(got["line"], got["turned"]) and np.allclose(got["line"][[0, -1]], [[0, 0, 0], [1, 0, 1]])
    assert (got["one"] == 0).all() and np.allclose(got["round"][[0, -1]], [[0, 0, 0], [0, 0, 1]]) and np.allclose(got["still"][:, :2], 0)
    pairs = held.alias("l").crossJoin(held.alias("r")).select(F.col("l.attempt_id").alias("a"), F.col("r.attempt_id").alias("b"), vectors.box_similarity(F.col("l.path"), F.col("r.path")).alias("s"))
    like = {(r.a, r.b): r.s for r in pairs.collect()}
    assert like["line", "line"] == 1 and like["line", "one"] == like["nan", "nan"] == 0 and 0 < like["line", "round"] < 1 and like["still", "still"] == 1
    few = vectors.vectors(table.withColumn("t", F.col("t").cast("long")), "attempt_id", 10.0, 10.0, 5).collect()
    assert [r.attempt_id for r in few] == ["still"] and few[0].gaps == [0.0] * 5


def test_points_as_rows_are_those_of_the_arrays(spark):
    """Also for paths that end where they began, stand still or take no time; and thousands of paths are quickly done."""
    paths = {"line": [(0, 0, 0), (1, 1, 10), (2, 4, 20)], "round": [(1, 1, 5), (2, 2, 5), (1, 1, 5)], "one": [(1, 1, 1)], "still": [(3, 3, 0)] * 4}
    held = pair_signals.paths(spark.createDataFrame(rows(paths), "attempt_id string, seq int, x double, y double, t double"), ["attempt_id"])
    want = {r.attempt_id: np.array([r.p.xs, r.p.ys, r.p.ts]).T for r in held.select("attempt_id", vectors.canonical(F.col("path")).alias("p")).where("attempt_id <> 'one'").collect()}
    made = {}
    for r in vectors.canonical_points(held, "attempt_id").orderBy("attempt_id", "i").collect():
        made.setdefault(r.attempt_id, []).append((r.x, r.y, r.t))
    assert set(made) == set(want) and all(np.allclose(made[k], want[k]) for k in want)
    plan = vectors.canonical_points(held, "attempt_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan.split("Aggregate")[0] and "zip_with(" not in plan  # no path is made anew for each point


def test_digests_tell_inputs_apart(spark):
    table = spark.createDataFrame([("a", 0, "k", 1, 0.5, 1.0), ("a", 1, "k", 2, 0.7, None), ("b", 0, "k", 1, 0.5 + 1e-9, 1.0), ("b", 1, "k", 2, 0.7, None), ("c", 0, "k", 1, 0.6, 1.0), ("c", 1, None, 2, 0.7, None)], "attempt_id string, seq int, kind string, t long, x double, y double")
    features = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 3)], "attempt_id string, f double, g int")
    made = {r.attempt_id: r for r in vectors.audit(table, features).collect()}
    assert made["a"].input_digest == made["b"].input_digest != made["c"].input_digest
    assert made["a"].feature_digest != made["b"].feature_digest and made["c"].feature_digest is None and made["a"].event_count == 2
