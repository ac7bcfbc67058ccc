"""Risk fusion: model, replay and rate evidence as one explained decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Weights, floors, levels, reasons and actions of the policy.
@dataclass(frozen=True)
class Policy:
    model_weight: float = 50.0
    similarity_weight: float = 35.0
    rate_weight: float = 30.0
    human_threshold: float = 0.5
    step_up_threshold: float | None = None
    similarity_threshold: float = 0.99
    most_per_minute: float = 20.0
    exact_replay_enabled: bool = True
    exact_floor: float = 80.0
    medium: float = 40.0
    high: float = 70.0

    def __post_init__(self) -> None:
        unit = {"human_threshold": self.human_threshold, "similarity_threshold": self.similarity_threshold}
        for name, value in unit.items():
            if not 0.0 <= value <= 1.0:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.step_up_threshold is not None and not self.human_threshold <= self.step_up_threshold <= 1.0:
            raise ValueError("step_up_threshold must be between human_threshold and 1")
        if self.most_per_minute <= 0:
            raise ValueError("most_per_minute must be positive")
        if not 0.0 <= self.medium < self.high <= 100.0:
            raise ValueError("levels must satisfy 0 <= medium < high <= 100")


def unit_score(score: Column) -> Column:
    """The score; a null one, NaN, and one outside 0..1 fail the query."""
    return F.when(score.between(0.0, 1.0), score).otherwise(F.raise_error(F.lit("human_score must be between 0 and 1")).cast("double"))


def fuse(rows: DataFrame, policy: Policy = Policy(), score: str = "human_score", exact: str = "exact_replay_detected", similarity: str = "similarity", rate: str = "attempts_per_minute", rejected: str = "quality_rejected") -> DataFrame:  # noqa: B008
    """The rows with risk_score, risk_level, action and reasons.

    Floors and weights apply in a fixed order.  Evidence that is null counts as
    absent; a score must be in 0..1.
    """
    s = unit_score(F.col(score))
    low = s < policy.human_threshold
    band = ~low & (s < policy.step_up_threshold) if policy.step_up_threshold is not None else F.lit(False)
    steps: list[tuple[Column, str, float, float]] = [
        (low, "ml_bot_score", 0.0, policy.medium),
        (band, "ml_step_up_band", 0.0, policy.medium),
        (F.col(exact) if policy.exact_replay_enabled else F.lit(False), "exact_trace_fingerprint", 0.0, policy.exact_floor),
        (F.col(similarity) >= policy.similarity_threshold, "dtw_similar_trace", policy.similarity_weight, policy.medium),
        (F.col(rate) >= policy.most_per_minute, "session_rate_exceeded", policy.rate_weight, policy.medium),
        (F.col(rejected), "invalid_event_telemetry", 0.0, policy.medium),
    ]
    risk, reasons = (1 - s) * policy.model_weight, []
    for test, name, add, floor in steps:
        risk = F.when(test, F.greatest(risk + add, F.lit(floor))).otherwise(risk)
        reasons.append(F.when(test, name))
    out = rows.withColumn("risk_score", F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), risk)), 2)).withColumn("reasons", F.concat_ws(";", *reasons))
    at = lambda high, medium, low: F.when(F.col("risk_score") >= policy.high, high).when(F.col("risk_score") >= policy.medium, medium).otherwise(low)
    return out.withColumn("risk_level", at("high", "medium", "low")).withColumn("action", at("step_up_and_rate_limit", "step_up", "allow"))
