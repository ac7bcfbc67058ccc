"""Shape and rhythm of a trajectory: spread, turning, entropy, peaks, bursts, corrections.

Everything is a window or an aggregate within one attempt, so each plan has the
one exchange on attempt_id that ordering needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .features import EPS, STILL, _order, segments

MOVING, LEVEL, NOTHING = 1e-9, 1e-6, 1e-12
#: What counts as the last part of the way to the target.
FINAL = 0.75


def _each() -> WindowSpec:
    return Window.partitionBy("attempt_id")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation as an aggregate; 0 where one side doesn't vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return _zero(F.when(spread * F.count(x) > NOTHING, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y) / spread))))


def entropy(rows: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """(attempt_id, name): entropy of an equal-width histogram, as a share of the greatest possible; the last bin holds the maximum."""
    low, high = F.min(value).over(_each()), F.max(value).over(_each())
    placed = rows.where(F.col(value).isNotNull()).withColumns({"low": low, "high": high})
    cell = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)))
    return cell_entropy(placed.withColumn("cell", cell).where("cell is not null"), bins, name)


def cell_entropy(rows: DataFrame, cells: int, name: str) -> DataFrame:
    n = rows.groupBy("attempt_id", "cell").agg(F.count("*").alias("n"))
    total = F.sum("n")
    return n.groupBy("attempt_id").agg(((F.log(total.cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / total) / math.log(cells)).alias(name))


def _parts(trace: DataFrame, width: float, height: float) -> DataFrame:
    """The segments on scaled coordinates, numbered from 0 (k of m)."""
    rows = segments(trace.withColumns({"x": F.col("x") / width, "y": F.col("y") / height})).where("dist is not null")
    return rows.withColumns({"k": F.row_number().over(_order()) - 1, "m": F.count("*").over(_each())})


def turning(parts: DataFrame) -> DataFrame:
    """p90, sign changes and smoothness of turns, and how speed goes with them."""
    moving = parts.where(F.col("dist") > MOVING).withColumn("heading", F.atan2("dy", "dx"))
    gap = F.col("heading") - F.lag("heading").over(_order())
    turns = moving.withColumns({"moves": F.count("*").over(_each()), "turn": F.atan2(F.sin(gap), F.cos(gap))}).where("turn is not null").withColumn("size", F.abs("turn"))
    turns = turns.withColumn("change", F.abs(F.col("size") - F.lag("size").over(_order())))
    signs = turns.where(F.col("size") > LEVEL).withColumn("same", F.signum("turn") == F.lag(F.signum("turn")).over(_order())).groupBy("attempt_id").agg(F.avg((~F.col("same")).cast("double")).alias("turn_direction_change_ratio"))
    enough = F.max("moves") >= 3
    found = turns.groupBy("attempt_id").agg(F.percentile("size", 0.9).alias("turn_angle_p90"), F.when(enough, _zero(F.avg("change"))).otherwise(0.0).alias("turn_change_smoothness"), F.when(enough, correlation("speed", "size")).otherwise(0.0).alias("speed_turn_abs_correlation"))
    return found.join(signs, "attempt_id", "left")


def speeds(parts: DataFrame) -> DataFrame:
    """Peaks, where the greatest one is, how speed is spread over the way, and how it rises and falls."""
    rows = parts.withColumns({"last": F.lag("speed").over(_order()), "next": F.lead("speed").over(_order()), "floor": F.percentile("speed", 0.5).over(_each()) + F.stddev_pop("speed").over(_each()), "top": F.max("speed").over(_each())})
    rows = rows.withColumn("peak", F.min(F.when(F.col("speed") == F.col("top"), F.col("k"))).over(_each()))
    step = F.col("speed") - F.col("last")
    part = lambda test: _zero(F.avg(F.when(test, F.col("speed"))))
    found = rows.groupBy("attempt_id").agg(
        F.max("m").alias("m"),
        F.count_if((F.col("speed") > F.col("last")) & (F.col("speed") >= F.col("next")) & (F.col("speed") > F.col("floor"))).alias("speed_peak_count"),
        F.max("peak").alias("peak"),
        F.max("top").alias("top"),
        part(F.col("k") < F.greatest(F.lit(1), F.ceil(F.col("m") * 0.25))).alias("early"),
        part((F.col("k") >= F.floor(F.col("m") * 0.35)) & (F.col("k") < F.greatest(F.lit(1), F.ceil(F.col("m") * 0.65)))).alias("middle"),
        part(F.col("k") >= F.floor(F.col("m") * 0.75)).alias("late"),
        _zero(F.avg(F.when((F.col("k") > 0) & (F.col("k") <= F.col("peak")), F.greatest(step, F.lit(0.0))))).alias("rise"),
        _zero(F.avg(F.when(F.col("k") > F.col("peak"), F.greatest(-step, F.lit(0.0))))).alias("fall"),
        F.avg("speed").alias("mean"),
        F.sum("dist").alias("path"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "speed"))), lambda s: s["speed"]).alias("speeds"),  # one attempt's
    )
    some = (F.col("m") >= 3) & (F.col("top") > NOTHING)
    width = F.greatest(F.lit(2), F.ceil(F.col("m") * 0.2)).cast("int")
    rolled = F.array_max(F.transform(F.sequence(F.lit(1), F.col("m").cast("int") - width + 1), lambda i: F.aggregate(F.slice("speeds", i, width), F.lit(0.0), lambda a, x: a + x))) / width
    strong = F.greatest("rise", "fall")
    out = {
        "speed_peak_position_ratio": F.col("peak") / F.greatest(F.col("m") - 1, F.lit(1)),
        "mid_to_edge_speed_ratio": F.col("middle") / F.greatest((F.col("early") + F.col("late")) / 2, F.lit(1e-9)),
        "speed_burst_concentration": rolled / F.greatest("mean", F.lit(1e-9)),
        "peak_accel_decel_symmetry": F.when(strong > NOTHING, F.least("rise", "fall") / strong),
    }
    return found.select("attempt_id", "path", F.when(F.col("m") >= 3, F.col("speed_peak_count")).otherwise(0).alias("speed_peak_count"), *[_zero(F.when(some, c)).alias(n) for n, c in out.items()])


def rhythm(trace: DataFrame) -> DataFrame:
    """Correlation of neighbouring intervals and of their changes, and how much changes change; of intervals that aren't 0."""
    dt = F.greatest(F.col("t") - F.lag("t").over(_order()), F.lit(0)).cast("double")
    rows = trace.withColumns({"n": F.count("*").over(_each()), "dt": dt}).where("dt > 0 and n >= 4")
    rows = rows.withColumns({"was": F.lag("dt").over(_order()), "p": F.count("*").over(_each())}).withColumn("delta", F.col("dt") - F.col("was"))
    rows = rows.withColumn("delta_was", F.lag("delta").over(_order())).where("p >= 3")
    return rows.groupBy("attempt_id").agg(
        correlation("was", "dt").alias("interval_lag1_autocorrelation"),
        F.when(F.max("p") >= 4, correlation("delta_was", "delta")).otherwise(0.0).alias("interval_delta_lag1_autocorrelation"),
        _zero(F.avg(F.abs(F.col("delta") - F.col("delta_was"))) / F.greatest(F.avg("dt"), F.lit(1.0))).alias("interval_second_difference_relative"),
    )


def shapes(trace: DataFrame, width: float, height: float) -> DataFrame:
    """One row per attempt of two or more events: all of the above; zeros where there is too little to tell."""
    parts = _parts(trace, width, height)
    quarter = F.percentile(F.when(F.col("dist") > 0, F.col("dist")), 0.25).over(_each())
    rows = parts.withColumns({"micro": F.greatest(F.lit(0.002), F.coalesce(quarter * 0.5, F.lit(0.002))), "long": F.greatest(F.lit(100.0), F.percentile("dt", 0.9).over(_each())), "gone": F.sum("dist").over(_order()), "all": F.sum("dist").over(_each())})
    base = rows.groupBy("attempt_id").agg(F.stddev_pop("accel").alias("normalized_acceleration_std"), F.stddev_pop("jerk").alias("normalized_jerk_std"), F.avg((F.col("dist") <= F.col("micro")).cast("double")).alias("micro_move_ratio"), F.count_if(F.col("dt") >= F.col("long")).alias("pauses"))
    scaled = lambda c: F.when(F.max(c).over(_each()) - F.min(c).over(_each()) > NOTHING, (F.col(c) - F.min(c).over(_each())) / (F.max(c).over(_each()) - F.min(c).over(_each()))).otherwise(0.0)
    at = lambda c: F.least(F.floor(F.col(c) * 4), F.lit(3))
    grid = trace.withColumns({"x": F.col("x") / width, "y": F.col("y") / height}).withColumns({"gx": scaled("x"), "gy": scaled("y")}).withColumn("cell", at("gx") * 4 + at("gy"))
    progress = rows.where((F.col("dt") >= F.col("long")) & (F.col("all") > NOTHING)).withColumn("progress", F.col("gone") / F.col("all"))
    ends = trace.groupBy("attempt_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    out = base
    for more in (turning(parts), speeds(parts), entropy(parts, "dt", 8, "timing_entropy"), cell_entropy(grid, 16, "spatial_entropy"), entropy(progress, "progress", 4, "pause_position_entropy"), rhythm(trace), ends):
        out = out.join(more, "attempt_id", "left")
    line = F.sqrt(F.pow((F.col("b.x") - F.col("a.x")) / width, 2) + F.pow((F.col("b.y") - F.col("a.y")) / height, 2))
    out = out.withColumn("straight_burst_score", F.when(F.col("path") > NOTHING, line / F.col("path")).otherwise(0.0) * F.col("speed_burst_concentration"))
    return out.select("attempt_id", "speed_peak_count", *[_zero(F.col(c)).alias(c) for c in SHAPES])


SHAPES = (
    "normalized_acceleration_std", "normalized_jerk_std", "turn_angle_p90", "turn_direction_change_ratio", "micro_move_ratio", "timing_entropy", "spatial_entropy",
    "speed_peak_position_ratio", "mid_to_edge_speed_ratio", "speed_burst_concentration", "peak_accel_decel_symmetry", "straight_burst_score",
    "interval_lag1_autocorrelation", "interval_delta_lag1_autocorrelation", "interval_second_difference_relative", "speed_turn_abs_correlation", "turn_change_smoothness", "pause_position_entropy",
)


def corrections(trace: DataFrame) -> DataFrame:
    """Overshoot beyond the target, and turns, time and speed on the last quarter of the way; zeros for a single event."""
    ends = {f"{c}{i}": f(c, "seq").over(_each()) for c in ("x", "y") for i, f in ((0, F.min_by), (1, F.max_by))}
    rows = trace.withColumns({**ends, "n": F.count("*").over(_each()), "k": F.row_number().over(_order()) - 1})
    axis = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    rows = rows.withColumn("axis", axis)
    flat = F.col("axis") < EPS
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    along = F.when(flat, F.sqrt(dx * dx + dy * dy)).otherwise((dx * (F.col("x1") - F.col("x0")) + dy * (F.col("y1") - F.col("y0"))) / F.col("axis"))
    rows = rows.withColumns({"along": along}).withColumn("beyond", F.col("along") - F.when(flat, 0.0).otherwise(F.col("axis")))
    rows = rows.withColumn("over", F.col("beyond") > STILL).withColumn("begins", F.col("over") & ~F.coalesce(F.lag("over").over(_order()), F.lit(False)))
    over = rows.groupBy("attempt_id").agg(F.count_if("begins").alias("overshoot_count"), _zero(F.max(F.when(F.col("over"), F.col("beyond")))).alias("overshoot_distance"))
    final = F.when(flat, F.col("k") >= F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(2), F.floor(F.col("n") / 4)))).otherwise(F.col("along") >= F.col("axis") * FINAL)
    last = segments(rows.where(final & (F.col("n") >= 2)).select("attempt_id", "seq", "t", "x", "y"))
    moved = F.when(F.col("dist") >= STILL, F.struct("dx", "dy"))
    last = last.withColumn("before", F.last(moved, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)))
    turned = (F.col("dist") >= STILL) & (F.col("dx") * F.col("before.dx") + F.col("dy") * F.col("before.dy") < 0)
    ended = last.groupBy("attempt_id").agg(F.count_if(turned).alias("correction_count"), F.greatest(F.max_by("t", "seq") - F.min_by("t", "seq"), F.lit(0)).cast("double").alias("endpoint_adjustment_time"), _zero(F.avg("speed")).alias("final_segment_speed"))
    out = over.join(ended, "attempt_id", "left")
    return out.select("attempt_id", "overshoot_count", "overshoot_distance", F.coalesce("correction_count", F.lit(0)).alias("correction_count"), _zero(F.col("endpoint_adjustment_time")).alias("endpoint_adjustment_time"), _zero(F.col("final_segment_speed")).alias("final_segment_speed"))
