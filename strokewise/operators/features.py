"""Trajectory features: one ordered pass of windows per attempt, then one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

EPS = 1e-9
#: Pixels below which a segment is a pause, or no turn is counted.
STILL = 1.0


def _order() -> WindowSpec:
    return Window.partitionBy("attempt_id").orderBy("seq")


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def segments(trace: DataFrame) -> DataFrame:
    """The trace with what leads to each event: dx, dy, dist, dt, speed, accel, jerk; null where there is none."""
    out = trace.withColumns({"dx": F.col("x") - F.lag("x").over(_order()), "dy": F.col("y") - F.lag("y").over(_order()), "dt": F.greatest(F.col("t") - F.lag("t").over(_order()), F.lit(0)).cast("double")})
    out = out.withColumn("dt", F.when(F.col("dx").isNotNull(), F.col("dt"))).withColumn("dist", _length(F.col("dx"), F.col("dy")))
    out = out.withColumn("speed", F.when(F.col("dt") > 0, F.col("dist") / F.col("dt")).when(F.col("dt").isNotNull(), 0.0))
    out = out.withColumn("accel", (F.col("speed") - F.lag("speed").over(_order())) / F.greatest("dt", F.lit(EPS)))
    return out.withColumn("jerk", (F.col("accel") - F.lag("accel").over(_order())) / F.greatest("dt", F.lit(EPS)))


def basic(trace: DataFrame) -> DataFrame:
    """The fifteen basic features of each attempt; zeros where there are too few events."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    rows = segments(trace)
    moving = F.when(F.col("dist") >= STILL, F.struct("dx", "dy"))
    rows = rows.withColumn("last_move", F.last(moving, ignorenulls=True).over(before))
    ends = Window.partitionBy("attempt_id")
    for c in ("x", "y"):
        rows = rows.withColumn(f"{c}0", F.min_by(c, "seq").over(ends)).withColumn(f"{c}1", F.max_by(c, "seq").over(ends))
    line = _length(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    away = F.when(line < EPS, _length(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).otherwise(
        F.abs((F.col("x1") - F.col("x0")) * (F.col("y0") - F.col("y")) - (F.col("x0") - F.col("x")) * (F.col("y1") - F.col("y0"))) / line
    )
    turn = (F.col("dist") >= STILL) & (F.col("dx") * F.col("last_move.dx") + F.col("dy") * F.col("last_move.dy") < 0)
    still = F.col("dist") < STILL
    found = rows.groupBy("attempt_id").agg(
        F.count("*").alias("event_count"),
        (F.max_by("t", "seq") - F.min_by("t", "seq")).alias("span"),
        F.sum("dist").alias("total"),
        F.max(line).alias("displacement"),
        F.max("speed").alias("max_speed"),
        F.stddev_pop("speed").alias("speed_std"),
        F.avg(F.abs("accel")).alias("avg_acceleration"),
        F.max(F.abs("accel")).alias("max_acceleration"),
        F.avg(F.abs("jerk")).alias("jerk_mean"),
        F.count_if(turn).alias("direction_changes"),
        F.count_if(still).alias("pause_count"),
        F.sum(F.when(still, F.col("dt"))).alias("paused"),
        F.max(away).alias("y_deviation"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    span, total = F.greatest("span", F.lit(0)).cast("double"), zero(F.col("total"))
    enough = F.col("event_count") >= 2
    return found.select(
        "attempt_id",
        "event_count",
        span.alias("duration_ms"),
        total.alias("total_distance"),
        F.when(enough, F.col("displacement")).otherwise(0.0).alias("displacement"),
        F.when(span > 0, total / (span + EPS)).otherwise(0.0).alias("avg_speed"),
        *[zero(F.col(c)).alias(c) for c in ("max_speed", "speed_std", "avg_acceleration", "max_acceleration", "jerk_mean")],
        "direction_changes",
        "pause_count",
        F.when(span > 0, zero(F.col("paused")) / (span + EPS)).otherwise(0.0).alias("pause_ratio"),
        F.when(total > 0, F.col("displacement") / (total + EPS)).otherwise(0.0).alias("linearity"),
        F.when(enough, F.col("y_deviation")).otherwise(0.0).alias("y_deviation"),
    )


def intervals(trace: DataFrame) -> DataFrame:
    """Mean, deviation and variation of the intervals, and the share of intervals whose value repeats."""
    values = segments(trace).where("dt is not null").groupBy("attempt_id", "dt").agg(F.count("*").alias("n"))
    mean = F.sum(F.col("dt") * F.col("n")) / F.sum("n")
    found = values.groupBy("attempt_id").agg(mean.alias("mean"), (F.sum(F.col("dt") * F.col("dt") * F.col("n")) / F.sum("n")).alias("square"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"))
    std = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return found.select("attempt_id", F.col("mean").alias("interval_mean_ms"), std.alias("interval_std_ms"), F.when(F.col("mean") > 0, std / (F.col("mean") + EPS)).otherwise(0.0).alias("interval_cv"), (F.col("again") / (F.col("n") + EPS)).alias("duplicate_interval_ratio"))


def normalised(trace: DataFrame, width: float, height: float) -> DataFrame:
    """Path length, speed percentiles (interpolated), turn angles and dwell runs on coordinates scaled to the box."""
    rows = segments(trace.withColumns({"x": F.col("x") / width, "y": F.col("y") / height}))
    heading = F.when(F.col("dist") > 1e-6, F.atan2("dy", "dx"))
    rows = rows.where("dist is not null").withColumn("heading", heading)
    last = F.last("heading", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("heading") - last
    turn = F.abs(F.atan2(F.sin(gap), F.cos(gap)))
    share = F.percentile("dt", 0.9).over(Window.partitionBy("attempt_id"))
    rows = rows.withColumn("turn", turn).withColumn("dwell", F.col("dt") >= F.greatest(F.lit(100.0), share))
    rows = rows.withColumn("begins", F.col("dwell") & ~F.coalesce(F.lag("dwell").over(_order()), F.lit(False)))
    pct = F.percentile("speed", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    found = rows.groupBy("attempt_id").agg(F.sum("dist").alias("normalized_path_length"), pct.alias("p"), F.avg("turn").alias("turn_angle_mean"), F.stddev_pop("turn").alias("turn_angle_std"), F.count_if("begins").alias("dwell_burst_count"))
    return found.select("attempt_id", "normalized_path_length", *[F.col("p")[i].alias(f"normalized_speed_p{q}") for i, q in enumerate((10, 50, 90))], F.coalesce("turn_angle_mean", F.lit(0.0)).alias("turn_angle_mean"), F.coalesce("turn_angle_std", F.lit(0.0)).alias("turn_angle_std"), "dwell_burst_count")


#: Counters that come with an attempt, and the features that have a stored column of their own.
COUNTERS = ("regrab_count", "retry_count", "pointercancel_count", "empty_click_count", "failed_drop_count")
STORED = ("event_count", "duration_ms", "total_distance", "displacement", "avg_speed", "speed_std", "avg_acceleration", "jerk_mean", "direction_changes", "linearity")


def _whole(name: str) -> Column:
    c = F.col(name).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)


def counters(interactions: DataFrame, key: str = "attempt_id") -> DataFrame:
    """(key, five interaction counters) as finite numbers; those that are missing, null or not finite are 0."""
    return interactions.select(key, *[(_whole(c) if c in interactions.columns else F.lit(0.0)).alias(c) for c in COUNTERS])


def stored(rows: DataFrame, version: str, key: str = "attempt_id") -> DataFrame:
    """(key, feature_schema_version, the features with a column of their own, extra_features): a row as it is stored.

    extra_features holds all of them by name; linearity's column stays within 0..1.
    """
    names = [c for c in rows.columns if c != key]
    own = [F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))).alias(c) if c == "linearity" else F.col(c).cast("double").alias(c) for c in STORED if c in names]
    every = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])
    return rows.select(key, F.lit(version).alias("feature_schema_version"), *own, every.alias("extra_features"))
