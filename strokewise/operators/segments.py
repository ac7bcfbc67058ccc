"""Cutting traces: drags from press to release, bursts between gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strokewise.functions.rounding import rounded


#: Event types that press, release and move, with their synonyms; moves without which a drag is a jump.
PRESS = ("pointerdown", "pointer_down", "drag_start")
RELEASE = ("pointerup", "pointer_up", "drop", "drag_end")
MOVE = ("pointermove", "pointer_move")
LEAST_MOVES = 2
#: Event types of aiming, grabbing and dragging in a recorded challenge.
AIM, GRAB = "aim_move", "pointer_down"
DRAG = ("pointer_move", "drop")


def drags(trace: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ano", "seq")) -> DataFrame:
    """(key, drag, n_events, n_moves, closed): one row per press; a press while pressed begins anew, moves without a press are dropped.

    A drag that is never released counts only if it holds more than its press,
    so a press told twice is one drag.  Other kinds of events, cancelled
    pointers among them, belong to the drag without ending it.
    """
    w = Window.partitionBy(key).orderBy(*order)
    up = F.coalesce(F.col("kind").isin(*RELEASE), F.lit(False))
    rows = trace.withColumn("drag", F.sum(F.coalesce(F.col("kind").isin(*PRESS), F.lit(False)).cast("int")).over(w)).where("drag > 0")
    released = F.coalesce(F.sum(up.cast("int")).over(Window.partitionBy(key, "drag").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("released", released).where("released = 0")
    out = rows.groupBy(key, "drag").agg(F.count("*").alias("n_events"), F.count_if(F.col("kind").isin(*MOVE)).alias("n_moves"), F.bool_or(up).alias("closed"))
    return out.where(F.col("closed") | (F.col("n_events") > 1))


def session_scores(scored_drags: DataFrame, key: str, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """(key, drag_count, starved_drags, human_score, prediction, reason) from drags with n_moves and a score.

    The median of the drags' scores; drags of too few moves have no say.  Where
    all are such, the session is a bot's, of score 0.
    """
    fed = F.col("n_moves") >= LEAST_MOVES
    out = scored_drags.groupBy(key).agg(F.count("*").alias("drag_count"), F.count_if(~fed).alias("starved_drags"), F.percentile(F.when(fed, F.col(score)), 0.5).alias("median"))  # a session has few drags
    starved = F.col("drag_count") == F.col("starved_drags")
    return out.select(
        key,
        "drag_count",
        "starved_drags",
        rounded(F.when(starved, 0.0).otherwise(F.col("median"))).alias("human_score"),
        F.when(~starved & (F.col("median") >= threshold), "human").otherwise("bot").alias("prediction"),
        F.when(starved, "every_drag_below_move_floor").alias("reason"),
    )


def runs(trace: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ano", "seq")) -> DataFrame:
    """The events of aims and drags with ``run``: an aim and the drag that follows it are one; a grab while dragging, and an aim after a drag, begin another.

    Runs without drag events are dropped, as are drag events before a grab.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("kind").isin(AIM, GRAB), F.col("kind"))
    open_ = F.coalesce(F.last(mark, ignorenulls=True).over(before) == GRAB, F.lit(False))
    rows = trace.withColumn("mark", mark).withColumn("open", open_)
    rows = rows.withColumn("run", F.sum((F.col("mark").isNotNull() & F.col("open")).cast("int")).over(w))
    drag = F.col("kind").isin(*DRAG) & F.col("open") & F.col("mark").isNull()
    part = F.when(F.col("mark") == AIM, "aim").when(drag, "drag")
    rows = rows.withColumn("part", part).where("part is not null")
    held = F.bool_or(F.col("part") == "drag").over(Window.partitionBy(key, "run"))
    return rows.withColumn("held", held).where("held").drop("mark", "open", "held")


def joined_paths(of_runs: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ano", "seq"), least: int = 31) -> DataFrame:
    """(key, run, n_aim, n_drag, n_points, judgeable): aim and drag as one path.

    A drag's first point that repeats the aim's last is left out of the path;
    points without coordinates are left out before.  From ``least`` points on a
    path can be judged.
    """
    w = Window.partitionBy(key, "run").orderBy(*order)
    rows = of_runs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    seam = (F.col("part") == "drag") & (F.lag("part").over(w) == "aim") & (step < 1e-9)
    rows = rows.withColumn("seam", F.coalesce(seam, F.lit(False))).where("not seam")
    out = rows.groupBy(key, "run").agg(F.count_if(F.col("part") == "aim").alias("n_aim"), F.count_if(F.col("part") == "drag").alias("n_drag"), F.count("*").alias("n_points"))
    return out.withColumn("judgeable", F.col("n_points") >= least)


def bursts(trace: DataFrame, gap: int, least: int = 1, key: str = "attempt_id", time: str = "t", order: str = "seq") -> DataFrame:
    """(key, burst, n, start, end): runs whose steps are at most gap; a longer step cuts, an equal one doesn't."""
    w = Window.partitionBy(key).orderBy(order)
    cut = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    rows = trace.withColumn("burst", F.sum(F.coalesce(cut, F.lit(0))).over(w))
    return rows.groupBy(key, "burst").agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("end")).where(F.col("n") >= least)


def last_burst(trace: DataFrame, gap: int = 400) -> DataFrame:
    """The last burst of each attempt."""
    found = bursts(trace, gap)
    return found.groupBy("attempt_id").agg(F.max_by(F.struct("n", "start", "end"), "burst").alias("b")).select("attempt_id", "b.*")
