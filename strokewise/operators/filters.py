"""Projections, filters and samples of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stored names of verdicts, labels and risk levels.
STATUS = {"valid": "valid", "rejected": "invalid", "pending": "pending"}
LABELS = ("human", "bot")
RISK_LABEL = {"low": "human", "high": "bot"}
#: Columns that tell the answer or the person, and never are model input.
NOT_INPUT = ("attempt_id", "user_id", "session_id", "participant", "label", "label_source", "family", "generator", "quality_status", "created_at")


def clamped(c: Column) -> Column:
    """Within 0..1; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def stored_status(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in STATUS.items() for v in kv]), c), F.lit("review"))


def known_label(c: Column) -> Column:
    return F.when(c.isin(*LABELS), c)


def risk_label(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in RISK_LABEL.items() for v in kv]), c), F.lit("uncertain"))


def valid_labelled(rows: DataFrame, status: str, label: str, source: str) -> DataFrame:
    return rows.where((F.col(status) == "valid") & F.col(label).isin(*LABELS) & F.col(source).isNotNull() & (F.trim(source) != ""))


def model_input(rows: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The feature columns alone: those of a view, or all that don't tell the answer."""
    return rows.select(*keep) if keep else rows.drop(*NOT_INPUT)


def without_aim(trace: DataFrame, aim: str = "aimmove") -> DataFrame:
    """The trace without aim moves, numbered anew from 0."""
    kept = trace.where(F.col("kind") != aim)
    return kept.withColumn("seq", (F.row_number().over(Window.partitionBy("attempt_id").orderBy("seq")) - 1).cast("long"))


def speed_review(trace: DataFrame, width: float, height: float, fastest: float = 0.02, least: int = 4) -> DataFrame:
    """(attempt_id, review, fastest): too few points, time that goes back, or a step too fast for a hand; null if none of these."""
    w = Window.partitionBy("attempt_id").orderBy("seq")
    dt = F.col("t") - F.lag("t").over(w)
    dist = F.sqrt(F.pow((F.col("x") - F.lag("x").over(w)) / width, 2) + F.pow((F.col("y") - F.lag("y").over(w)) / height, 2))
    rows = trace.withColumns({"dt": dt, "speed": F.when(dt > 0, dist / dt)})
    found = rows.groupBy("attempt_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("dt") < 0), F.lit(False)).alias("back"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("fastest"))
    return found.select("attempt_id", F.when(F.col("n") < least, "too_few_points").when(F.col("back"), "not_monotonic").when(F.col("fastest") > fastest, "extreme_speed").alias("review"), "fastest")


def complete(trace: DataFrame, least: int = 2) -> DataFrame:
    """(attempt_id): those with a press, a release and enough events."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    found = trace.groupBy("attempt_id").agg(has("pointerdown").alias("down"), has("pointerup").alias("up"), F.count("*").alias("n"))
    return found.where(F.col("down") & F.col("up") & (F.col("n") >= least)).select("attempt_id")


def sampled(rows: DataFrame, ident: str, n: int, salt: str) -> DataFrame:
    """n rows by a salted hash of their id: the same ones each time, however the table is cut."""
    return rows.orderBy(F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col(ident).cast("string")), 256), ident).limit(n)


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows, one of each group after another."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", group, order).limit(n)


def event_counts(trace: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(attempt_id, n_<kind>...) of the given kinds, and n_other."""
    known = F.col("kind").isin(*kinds)
    return trace.groupBy("attempt_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count_if(~known).alias("n_other"))


def outside_timing(rows: DataFrame, presented: str, submitted: str, first: str, last: str, enforced: bool, tolerance: int = 5_000) -> Column:
    """The reason why an attempt's events can't lie in the server's window, or null; all times in milliseconds."""
    p, s, a, b = F.col(presented), F.col(submitted), F.col(first), F.col(last)
    within = (a >= p - tolerance) & (b <= s + tolerance) & (b - a <= s - p + tolerance)
    missing = p.isNull() | s.isNull()
    out = F.when(missing, "missing_server_timing" if enforced else None).when(s < p, "submitted_before_presented")
    return out.when(~within, "event_timestamps_outside_server_window") if enforced else out
