"""Streams that need no rule of their own: idempotent ingest, counts per window, outcomes of known attempts.

Event times are in ``at`` (timestamp).  Rules that depend on what came before
are in ``strokewise.streaming.ordered``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(stream: DataFrame, ident: str, late: str = "1 hour") -> DataFrame:
    """Idempotent ingest: each id passes once within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark([ident])


def counted(stream: DataFrame, key: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(key, window, n): events per key and tumbling window; an addition, the rules know no windows."""
    return stream.withWatermark("at", late).groupBy(key, F.window("at", width)).agg(F.count("*").alias("n"))


def with_prediction(outcomes: DataFrame, predictions: DataFrame, ident: str = "attempt_id") -> DataFrame:
    """Outcomes whose attempt has a stored prediction; others are dropped."""
    return outcomes.join(predictions.select(ident).distinct(), ident, "left_semi")
