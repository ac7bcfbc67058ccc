"""Features of aiming bursts, and of clocks and steps that generators leave in traces.

Each burst (or attempt) is one window partition: its rows are sorted once,
and one aggregate makes all of its features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares of the peak that are slow, fast, and a submovement's least height and rise; shares of the way; the sampler's floor.
SLOW, FAST, TALL, RISE = 0.2, 0.6, 0.25, 0.15
HALF, NEAR, FLOOR_MS = 0.5, 0.15, 45.0
#: Points of a burst at least, and of a track that can be judged.
LEAST, TRACK_GAP_MS, TRACK_POINTS = 8, 2000.0, 31
#: Features in which a larger screen or a slower hand shows, and no habit.
MAGNITUDES = ("duration_ms", "path_length", "straight_distance", "peak_speed", "mean_speed", "point_count")
FEATURES = (*MAGNITUDES, "peak_at", "slow_fraction", "fast_fraction", "half_distance_at", "final_speed_ratio", "first_speed_ratio", "decel_ratio", "straightness", "speed_cv", "step_len_cv", "submovement_count", "turn_abs_mean", "turn_signed_mean", "turn_cv", "accel_std", "accel_sign_flips", "overshoot", "interval_median_ms", "interval_cv", "interval_at_floor")
EPS = 1e-9


def _distance(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def _share(test: Column) -> Column:
    """Mean of a test; rows where it is null have no say."""
    return F.avg(test.cast("double"))


def burst_features(bursts: DataFrame, key: list[str], order: str = "seq", x: str = "x", y: str = "y", t: str = "t") -> DataFrame:
    """(key, 26 features) of each burst of three points or more; times in milliseconds.  What isn't finite is 0."""
    w = Window.partitionBy(*key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = bursts.select(*key, order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(t).cast("double").alias("t"))
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w), "gap": F.col("t") - F.lag("t").over(w), "left": _distance(F.col("x") - F.last("x").over(whole), F.col("y") - F.last("y").over(whole))})
    rows = rows.where("n >= 3").withColumns({"m": F.col("n") - 1, "j": F.col("i") - 1, "step": _distance(F.col("dx"), F.col("dy")), "angle": F.atan2("dy", "dx")})
    rows = rows.withColumn("speed", F.col("step") / (F.greatest(F.col("gap"), F.lit(1e-6)) / 1000))
    raw = F.col("angle") - F.lag("angle").over(w)
    wrapped = raw - 2 * F.pi() * F.floor((raw + F.pi()) / (2 * F.pi()))
    turn = F.when((F.abs(wrapped + F.pi()) < 1e-15) & (raw > 0), F.pi()).otherwise(wrapped)
    rows = rows.withColumns({"turn": F.when(F.col("i") >= 2, turn), "accel": F.when(F.col("i") >= 2, (F.col("speed") - F.lag("speed").over(w)) / F.greatest(F.col("gap") / 1000, F.lit(1e-6))), "top": F.max("speed").over(whole), "start": F.first("left").over(whole)})
    flip = F.signum("accel") != F.lag(F.signum("accel")).over(w)
    valley = F.min("speed").over(w.rowsBetween(-3, -1))
    peak = (F.col("speed") >= F.lag("speed").over(w)) & (F.col("speed") > F.lead("speed").over(w)) & (F.col("speed") > TALL * F.col("top")) & (F.col("speed") - valley > RISE * F.col("top"))
    rows = rows.withColumns({"flip": F.when(F.col("i") >= 3, flip), "crest": F.when(F.col("i") >= 2, peak), "rest": F.col("left") / (F.col("start") + EPS)})
    rows = rows.withColumn("came", F.min(F.when(F.col("rest") <= NEAR, F.col("i"))).over(whole))
    high = F.when(F.col("top") != 0, F.col("top")).otherwise(EPS)
    m = F.col("m")
    early, late = F.col("j") < F.greatest(F.floor(m / 4), F.lit(1)), F.col("j") >= F.floor(3 * m / 4)
    of_speed = lambda test: F.avg(F.when((F.col("i") >= 1) & test, F.col("speed")))
    at = lambda j: F.max(F.when(F.col("j") == j, F.col("speed")))
    ratio = lambda c: F.stddev_pop(c) / (F.avg(c) + EPS)
    found = rows.groupBy(*key).agg(
        (F.max_by("t", "i") - F.min_by("t", "i")).alias("duration_ms"),
        F.max("n").cast("double").alias("point_count"),
        F.sum("step").alias("path_length"),
        F.max("start").alias("straight_distance"),
        F.max(high).alias("peak_speed"),
        F.avg("speed").alias("mean_speed"),
        (F.min(F.when(F.col("speed") == F.col("top"), F.col("j"))) / F.max(F.greatest(m - 1, F.lit(1)))).alias("peak_at"),
        _share(F.col("speed") < SLOW * high).alias("slow_fraction"),
        _share(F.col("speed") > FAST * high).alias("fast_fraction"),
        (F.min(F.when(F.col("rest") <= HALF, F.col("i"))) / F.max(m)).alias("half_distance_at"),
        (at(m - 1) / F.max(high)).alias("final_speed_ratio"),
        (at(F.lit(0)) / F.max(high)).alias("first_speed_ratio"),
        (of_speed(late) / (of_speed(early) + EPS)).alias("decel_ratio"),
        ratio("speed").alias("speed_cv"),
        ratio("step").alias("step_len_cv"),
        F.count_if("crest").cast("double").alias("submovement_count"),
        F.avg(F.abs("turn")).alias("turn_abs_mean"),
        F.avg("turn").alias("turn_signed_mean"),
        ratio(F.abs("turn")).alias("turn_cv"),
        F.stddev_pop("accel").alias("accel_std"),
        F.coalesce(_share(F.col("flip")), F.lit(0.0)).alias("accel_sign_flips"),
        (F.greatest(F.lit(0.0), F.max(F.when(F.col("i") >= F.col("came"), F.col("left")))) / (F.max("start") + EPS)).alias("overshoot"),
        F.percentile("gap", 0.5).alias("interval_median_ms"),  # a burst has few points
        ratio("gap").alias("interval_cv"),
        _share(F.col("gap") <= FLOOR_MS).alias("interval_at_floor"),
    )
    found = found.withColumn("straightness", F.when(F.col("path_length") > EPS, F.col("straight_distance") / F.col("path_length")).otherwise(0.0))
    finite = lambda c: F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)).alias(c)
    return found.select(*key, *[finite(f) for f in FEATURES])


def clock_features(trace: DataFrame, key: str = "attempt_id", order: str = "seq") -> DataFrame:
    """(key, dt_distinct_ratio, dt_entropy, dt_cv, dt_mode_share, speed_autocorr, step_quantisation): habits of a clock and a step, not of a hand.

    Gaps are those of sorted times; speeds and steps those of the events in
    order.
    """
    sorted_ = Window.partitionBy(key).orderBy("t")
    w = Window.partitionBy(key).orderBy(order)
    rows = trace.select(key, order, *[F.col(c).cast("double").alias(c) for c in ("t", "x", "y")])
    gap = F.col("t") - F.lag("t").over(sorted_)
    dx, dy, dt = (F.col(c) - F.lag(c).over(w) for c in ("x", "y", "t"))
    rows = rows.withColumns({"gap": gap, "dx": dx, "dy": dy, "dt": dt})
    rows = rows.withColumn("v", F.when(F.col("dt") > 0, _distance(F.col("dx"), F.col("dy")) / F.col("dt")).when(F.col("dt").isNotNull(), 0.0))
    rows = rows.withColumn("was", F.lag("v").over(w))
    known, d = F.col("was").isNotNull(), F.col("gap")
    of = lambda c: F.when(known, F.col(c))
    spread = F.stddev_pop(of("v")) * F.stddev_pop(of("was"))
    corr = F.when((F.count("v") >= 3) & (F.stddev_pop("v") > 0) & (spread > 1e-300), F.covar_pop(of("v"), of("was")) / spread).otherwise(0.0)
    step = F.when(F.col("dx").isNotNull(), F.struct(F.bround("dx", 3), F.bround("dy", 3)))
    tenths = F.collect_list(F.when(d.isNotNull(), F.bround(d, 1)))  # an attempt has few events
    found = rows.groupBy(key).agg(
        F.count(d).alias("n"),
        F.size(F.collect_set(F.bround(d, 3))).alias("distinct"),
        F.avg(d).alias("mean"),
        F.stddev_pop(d).alias("sd"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr)).alias("speed_autocorr"),
        F.size(F.collect_set(step)).alias("steps"),
        tenths.alias("tenths"),
    )
    counts = F.transform(F.array_distinct("tenths"), lambda v: F.size(F.filter("tenths", lambda u: u == v)))
    found = found.withColumn("counts", counts)
    p = lambda c: c / F.col("n")
    entropy = F.aggregate("counts", F.lit(0.0), lambda a, c: a - p(c) * F.log(p(c)))
    n = F.col("n")
    return found.select(
        key,
        F.when(n > 0, F.col("distinct") / n).otherwise(0.0).alias("dt_distinct_ratio"),
        F.when((n >= 2) & (F.size("counts") > 1), entropy / F.log(F.size("counts"))).otherwise(0.0).alias("dt_entropy"),
        F.when((n >= 2) & (F.col("mean") != 0), F.col("sd") / F.col("mean")).otherwise(0.0).alias("dt_cv"),
        F.when(n > 0, F.array_max("counts") / n).otherwise(0.0).alias("dt_mode_share"),
        "speed_autocorr",
        F.when(n > 0, 1 - F.col("steps") / n).otherwise(0.0).alias("step_quantisation"),
    )
