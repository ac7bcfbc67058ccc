"""From the stored tables to ordered pointer traces and learning attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Events in one attempt, and microseconds in one tick of its clock.
ATTEMPT, TICK = 16, 600_000_000
WIDTH, HEIGHT = 500.0, 200.0
#: Pointer kinds for the stored event types.
POINTER = {"click": "pointerdown", "view": "pointermove", "purchase": "pointerup", "error": "pointercancel", "signup": "aimmove"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(events: DataFrame) -> DataFrame:
    """(user_id, ano, attempt_id, seq, t, at_us, x, y, kind): each user's events in order, sixteen to an attempt."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.select("user_id", "event_id", "ts", "event_type", micros.alias("at_us"), F.col("value").alias("x"), (2 * F.get_json_object("props", "$.k").cast("double")).alias("y"), order.alias("rn"))
    ano = F.floor(F.col("rn") / ATTEMPT)
    kind = F.create_map(*[F.lit(v) for pair in POINTER.items() for v in pair])[F.col("event_type")]
    rows = rows.select("user_id", ano.alias("ano"), F.concat_ws("-", "user_id", ano).alias("attempt_id"), (F.col("rn") % ATTEMPT).alias("seq"), "at_us", "x", "y", kind.alias("kind"))
    start = F.min("at_us").over(Window.partitionBy("user_id", "ano"))
    return rows.withColumn("t", F.floor((F.col("at_us") - start) / TICK).cast("long"))


def learning(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """(student, concept, question, difficulty, presentation, line, answered_at, correct, options)."""
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("student"), F.substring("p_brand", 1, 7).alias("concept"), F.col("p_partkey").alias("question"), (F.col("p_size") / 50.0).alias("difficulty"),
            F.col("l_orderkey").alias("presentation"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("date").alias("answered_at"), (F.col("l_returnflag") != "R").alias("correct"), (F.col("p_size") % 5).cast("long").alias("options"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("supplier"),
        )
    )
