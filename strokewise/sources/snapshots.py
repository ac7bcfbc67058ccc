"""Snapshots of stored behaviour: pseudonymous, judged, in tables that belong together; and training data curated from one.

A snapshot is one version of a ``Store``: the summaries of all rows, the
attempts that can be used, the features of valid ones, and what was decided
about each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokewise.functions.hashing import pseudonym
from strokewise.operators import features

from .store import Store, Version

#: Points of a trace at least, and the speed (in boxes a millisecond) from which on a hand is doubted.
LEAST_POINTS, FASTEST = 4, 0.02
#: Results that count as correct.
CORRECT = ("correct", "success", "pass")


def trace_points(points: Column) -> Column:
    """array<struct<t,x,y>> from JSON of [t, x, y] or {t_ms, x, y}; null where it isn't an array of such."""
    items = F.try_variant_get(F.try_parse_json(points), "$", "array<variant>")
    value = lambda p, name, at: F.coalesce(F.try_variant_get(p, f"$.{name}", "double"), F.try_variant_get(p, f"$[{at}]", "double"))
    return F.transform(items, lambda p: F.struct(value(p, "t_ms", 0).alias("t"), value(p, "x", 1).alias("x"), value(p, "y", 2).alias("y")))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def judged(rows: DataFrame) -> DataFrame:
    """The rows (points, box_w, box_h, participant) with events, quality_status and reasons."""
    w, h = (F.col(c).try_cast("double") for c in ("box_w", "box_h"))
    p = F.col("_p")
    pairs = F.when(F.size(p) > 1, F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    solid = F.forall(p, lambda q: _finite(q["t"]) & _finite(q["x"]) & _finite(q["y"]))
    back = F.exists(pairs, lambda q: q["b"]["t"] < q["a"]["t"])
    bad = (
        F.when(p.isNull() | (F.size(p) == 0), "missing_or_invalid_trace")
        .when(~(F.coalesce(_finite(w) & _finite(h) & (w > 0) & (h > 0), F.lit(False))), "invalid_trace_dimensions")
        .when(F.size(p) < LEAST_POINTS, "too_few_points")
        .when(~solid, "missing_or_invalid_trace")
        .when(back, "non_monotonic_time")
    )
    n = F.size(p)
    kind = lambda i: F.when(i == 0, "pointerdown").when(i == n - 1, "pointerup").otherwise("pointermove")
    event = lambda q, i: F.struct(i.cast("long").alias("seq"), kind(i).alias("kind"), q["t"].alias("t"), (q["x"] * w).alias("x"), (q["y"] * h).alias("y"), q["x"].alias("x_normalized"), q["y"].alias("y_normalized"))
    speed = lambda q: F.when(q["b"]["t"] > q["a"]["t"], F.sqrt(F.pow(q["b"]["x"] - q["a"]["x"], 2) + F.pow(q["b"]["y"] - q["a"]["y"], 2)) / (q["b"]["t"] - q["a"]["t"]))
    doubts = F.array_compact(F.array(F.when(F.col("participant").isNull(), "participant_group_unknown"), F.when(F.coalesce(F.array_max(F.transform(pairs, speed)), F.lit(0.0)) > FASTEST, "extreme_normalized_speed_review")))
    rows = rows.withColumn("_p", trace_points(F.col("points"))).withColumn("_bad", bad)
    rows = rows.withColumns({"events": F.when(F.col("_bad").isNull(), F.transform("_p", event)), "reasons": F.when(F.col("_bad").isNotNull(), F.array("_bad")).otherwise(doubts)})
    status = F.when(F.col("_bad").isNotNull(), "rejected").when(F.size("reasons") > 0, "pending").otherwise("valid")
    return rows.withColumn("quality_status", status).drop("_p", "_bad", "points")


def _flat(attempts: DataFrame) -> DataFrame:
    return attempts.select("attempt_id", F.explode("events").alias("e")).select("attempt_id", "e.*")


def feature_rows(attempts: DataFrame) -> DataFrame:
    """attempt_id and the features of its events; one that isn't finite fails the query."""
    flat = _flat(attempts)
    made = features.basic(flat).join(features.intervals(flat), "attempt_id", "left")
    return made.select("attempt_id", *[F.when(F.col(c).isNull() | _finite(F.col(c).cast("double")), F.col(c)).otherwise(F.raise_error(F.lit(f"feature {c} is not finite")).cast(made.schema[c].dataType)).alias(c) for c in made.columns if c != "attempt_id"])


def export(summaries: DataFrame, traces: DataFrame, store: Store, key: bytes) -> Version:
    """The next version of the store from behaviour summaries and their traces; its notes hold the counts.

    summaries: id, organization_id, student_id, input_type, interaction_result,
    risk_level, sample_label, dataset_status, retry_count, drop_distance_norm,
    actor_band; traces: behavior_id, points, box_w, box_h.  Ids leave only as
    names made with the key, which isn't stored.
    """
    # the join's columns are written once, so that the four tables agree whatever becomes of the sources
    joined = summaries.join(traces.select(F.col("behavior_id").alias("id"), "points", "box_w", "box_h"), "id", "left")
    named = joined.select(
        pseudonym("human_db", F.col("id"), key).alias("attempt_id"),
        pseudonym("organization", F.col("organization_id"), key).alias("organization"),
        pseudonym("participant", F.col("student_id"), key).alias("participant"),
        F.coalesce(F.col("input_type"), F.lit("unknown")).alias("input_type"),
        "interaction_result",
        "risk_level",
        F.col("sample_label").alias("source_sample_label"),
        F.col("dataset_status").alias("source_dataset_status"),
        F.coalesce(F.col("retry_count"), F.lit(0)).cast("int").alias("retry_count"),
        F.coalesce(F.col("drop_distance_norm").cast("double"), F.lit(0.0)).alias("final_drop_error"),
        F.coalesce(F.col("actor_band"), F.lit("unknown")).alias("age_group"),
        F.coalesce(F.col("interaction_result").isin(*CORRECT), F.lit(False)).alias("interaction_success"),
        "points",
        "box_w",
        "box_h",
    )
    rows = store.staged(judged(named), "snapshot")
    usable = rows.where("quality_status <> 'rejected'").drop("reasons")
    valid = rows.where("quality_status = 'valid'")
    tables = {
        "snapshot": rows.drop("reasons", "quality_status"),
        "attempts": usable.drop("source_sample_label", "source_dataset_status", "risk_level"),
        "features": valid.select("attempt_id", "participant", F.lit("human").alias("label"), F.lit("controlled_collection").alias("label_source"), "age_group", "input_type", "interaction_success", "final_drop_error").join(feature_rows(valid), "attempt_id"),
        "curation": rows.select("attempt_id", "participant", "quality_status", "reasons", "source_sample_label", "source_dataset_status", "input_type", "risk_level"),
    }
    c = rows.agg(F.count("*").alias("total"), F.count("participant").alias("linked"), F.count_distinct("participant").alias("participants"), F.count("events").alias("with_trace"), *[F.count_if(F.col("quality_status") == s).alias(f"quality_{s}") for s in ("valid", "pending", "rejected")]).first()
    return store.commit(tables, append=False, notes={"counts": c.asDict()})


def curate(snapshot: Store, store: Store, confirmed_human: bool) -> Version:
    """Training data from a snapshot's newest version, as the next version of another store.

    Rejected rows and those that the source excludes are left out and listed;
    all others are humans', which their collector must have confirmed.
    """
    if not confirmed_human:
        raise ValueError("human labels need the collector's confirmation")
    source = snapshot.version()
    attempts, curation = snapshot.read("attempts", source), snapshot.read("curation", source)
    if attempts is None or curation is None:
        raise ValueError("no snapshot")
    if not attempts.groupBy("attempt_id").count().where("count > 1").isEmpty():
        raise ValueError("duplicate attempt_id")
    away = F.col("quality_status") == "rejected"
    shut = ~away & F.coalesce(F.col("source_dataset_status") == "excluded", F.lit(False))
    excluded = curation.where(away | shut).withColumn("reasons", F.when(shut, F.array_append("reasons", F.lit("source_dataset_status_excluded"))).otherwise(F.col("reasons")))
    kept = store.staged(attempts.join(curation.where(~away & ~shut).select("attempt_id", F.col("quality_status").alias("previous_quality_status"), F.col("reasons").alias("previous_quality_reasons")), "attempt_id").drop("quality_status"), "curated")
    label = [F.lit("human").alias("label"), F.lit("controlled_collection").alias("label_source")]
    made = {
        "attempts": kept.drop("previous_quality_status", "previous_quality_reasons"),
        "features": kept.select("attempt_id", "participant", *label, F.lit("valid").alias("quality_status"), "previous_quality_status", "previous_quality_reasons", "age_group", "input_type", "interaction_success", "final_drop_error").join(feature_rows(kept), "attempt_id"),
        "labels": kept.select("attempt_id", "participant", *label, F.lit(True).alias("collection_ownership_confirmed")),
        "excluded": excluded,
    }
    c = kept.agg(F.count("*").alias("included"), F.count("participant").alias("linked"), F.count_distinct("participant").alias("participants")).first()
    reasons = {r["reason"]: r["n"] for r in excluded.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).collect()}  # one row for each reason
    counts = {"source_rows": source.notes["counts"]["total"], **c.asDict(), "excluded": excluded.count(), "excluded_by_reason": reasons}
    return store.commit(made, append=False, notes={"source_version": source.number, "counts": counts})
