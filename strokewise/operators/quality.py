"""The quality gate of an attempt: hard and soft rules, reasons in rule order, and what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .filters import outside_timing

#: How far beyond the box, events and places at least.
MARGIN, LEAST_EVENTS, LEAST_PLACES = 0.5, 2, 2
#: Names of the rules, in order.
HARD = ("seq_not_sequential", "t_ms_decreasing", "missing_pointerdown", "missing_pointerup_or_cancel", "non_finite_value", "coordinates_out_of_bounds", "duration_not_positive", "too_few_distinct_coordinates")
SOFT = ("normalized_out_of_range", "duplicate_timestamps", "duplicate_events")
FEW = "event_count_lt_2"
NUMBERS = ("t", "x", "y", "x_normalized", "y_normalized")


def _finite(c: str) -> Column:
    value = F.col(c).cast("double")
    return value.isNull() | (~F.isnan(value) & (F.abs(value) < float("inf")))


def _different(*columns: str) -> Column:
    """How many different tuples: an attempt has few events, so one pass holds them as a set; nulls count as a value."""
    return F.size(F.collect_set(F.struct(*columns)))


def gate(trace: DataFrame, width: Column | float | None = None, height: Column | float | None = None, presented: str | None = None, submitted: str | None = None, enforced: bool = False) -> DataFrame:
    """(attempt_id, status, reasons, checks) of each attempt: rejected, pending or valid, why, and measurements by name.

    The trace needs attempt_id, seq, t (milliseconds), x, y and pointer_type;
    x_normalized and y_normalized are judged where they exist.  width and
    height may be columns; without them no coordinate is out of bounds.
    presented and submitted name columns of server times in milliseconds, the
    same in all of an attempt's rows; enforced demands them and that the events
    lie between.  Null times decrease, null kinds are none of the kinds asked
    for, null coordinates are in bounds.
    """
    w, h = (F.lit(v) if v is None or isinstance(v, (int, float)) else v for v in (width, height))
    normalized = [c for c in ("x_normalized", "y_normalized") if c in trace.columns]
    order = Window.partitionBy("attempt_id").orderBy("seq")
    number = F.row_number().over(order)
    back = (number > 1) & ~F.coalesce(F.col("t") >= F.lag("t").over(order), F.lit(False))
    beyond = lambda c, size: (F.col(c) < -MARGIN * size) | (F.col(c) > (1 + MARGIN) * size)
    is_number = lambda c: ~F.isnan(F.col(c).cast("double"))  # noqa: E731  NaN is neither beyond nor within
    outside = (F.coalesce(beyond("x", w), F.lit(False)) & is_number("x")) | (F.coalesce(beyond("y", h), F.lit(False)) & is_number("y"))
    sized = F.coalesce((w != 0) & (h != 0), F.lit(False)) & F.col("x").isNotNull() & F.col("y").isNotNull()
    loose = sum((F.coalesce(((F.col(c) < 0) | (F.col(c) > 1)) & is_number(c), F.lit(False)).cast("int") for c in normalized), F.lit(0))
    odd = ~F.lit(True)
    for c in (c for c in NUMBERS if c in trace.columns):
        odd = odd | ~_finite(c)
    kind = lambda *names: F.coalesce(F.bool_or(F.col("pointer_type").isin(*names)), F.lit(False))
    server = [F.max(F.col(c)).alias(f"_{n}") if c else F.lit(None).cast("long").alias(f"_{n}") for n, c in (("presented", presented), ("submitted", submitted))]
    found = trace.withColumn("back", back).groupBy("attempt_id").agg(
        F.count("*").alias("n"),
        ((F.min("seq") == 0) & (F.max("seq") == F.count("*") - 1) & (_different("seq") == F.count("*"))).alias("seq_ok"),
        F.bool_or("back").alias("back"),
        kind("pointerdown").alias("down"),
        kind("pointerup", "pointercancel").alias("up"),
        F.bool_or(odd).alias("odd"),
        F.count_if(sized & outside).alias("outside"),
        F.sum(loose).alias("loose"),
        (F.max_by("t", "seq") - F.min_by("t", "seq")).alias("span"),
        (F.count("*") - _different("t")).alias("times"),
        (F.count("*") - _different("pointer_type", "t", "x", "y")).alias("events"),
        _different("x", "y").alias("places"),
        F.min("t").alias("_first"),
        F.max("t").alias("_last"),
        *server,
    )
    found = found.withColumn("seq_ok", F.coalesce("seq_ok", F.lit(False)))
    timing = outside_timing(found, "_presented", "_submitted", "_first", "_last", enforced)
    hard = [~F.col("seq_ok"), F.col("back"), ~F.col("down"), ~F.col("up"), F.col("odd"), F.col("outside") > 0, F.coalesce(F.col("span") <= 0, F.lit(True)), F.col("places") < LEAST_PLACES]
    soft = [F.col("loose") > 0, F.col("times") > 0, F.col("events") > 0]
    few = F.col("n") < LEAST_EVENTS
    text = lambda names, tests, *more: F.concat_ws(";", *[F.when(t, n) for n, t in zip(names, tests, strict=True)], *more)
    found = found.withColumn("_hard", F.when(few, FEW).otherwise(text(HARD, hard, timing))).withColumn("_soft", F.when(few, "").otherwise(text(SOFT, soft)))
    status = F.when(F.col("_hard") != "", "rejected").when(F.col("_soft") != "", "pending").otherwise("valid")
    window = enforced & F.col("_presented").isNotNull() & (F.col("_submitted") >= F.col("_presented"))
    measured = {
        "event_count": F.col("n"),
        "seq_ok": F.when(~few, F.col("seq_ok")),
        "t_ms_non_decreasing": F.when(~few, ~F.col("back")),
        "out_of_bounds_count": F.when(~few, F.col("outside")),
        "normalized_out_of_range_count": F.when(~few, F.col("loose")),
        "duration_ms": F.when(~few, F.col("span")),
        "duplicate_timestamp_count": F.when(~few, F.col("times")),
        "duplicate_event_count": F.when(~few, F.col("events")),
        "distinct_coordinates": F.when(~few, F.col("places")),
        "server_duration_ms": F.when(~few & window, F.col("_submitted") - F.col("_presented")),
        "event_first_t_ms": F.when(~few & window, F.col("_first")),
        "event_last_t_ms": F.when(~few & window, F.col("_last")),
        "event_timestamps_within_server_window": F.when(~few & window, timing.isNull()),
    }
    checks = F.create_map(*[v for k, c in measured.items() for v in (F.lit(k), c.cast("string"))])
    return found.select("attempt_id", status.alias("status"), F.when(F.col("_hard") != "", F.col("_hard")).otherwise(F.col("_soft")).alias("reasons"), F.map_filter(checks, lambda _, v: v.isNotNull()).alias("checks"))


def reason_counts(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode(F.split("reasons", ";")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))
