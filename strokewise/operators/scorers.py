"""Trained scorers of attempts: fitting, bundles on disk, and scoring by the least of several views.

A bundle is a folder of one fitted pipeline for each view and a manifest that
is written last, so a half-written bundle is never found.  Trees are bounded
by their depth and number, whatever the rows; the rows are never collected.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokewise.functions.rounding import rounded

from .density import Density

#: How several views become one score, and what every manifest holds.
FUSION = "two_view_min"
MANIFEST = ("model_name", "model_version", "feature_schema_version", "threshold", "feature_views")
#: Partitions of training rows: fits don't depend on how the input was cut.
FIT_PARTS = 16


class ModelNotReady(RuntimeError):
    """No bundle can be served."""


def estimators(seed: int = 42, trees: int = 100, depth: int = 10) -> dict:
    """The candidates by name, unfitted; boosting takes half as many, shallower trees."""
    common = {"featuresCol": "_v", "labelCol": "_y", "weightCol": "_w"}
    return {
        "random_forest": RandomForestClassifier(**common, numTrees=trees, maxDepth=depth, seed=seed),
        "gradient_boosting": GBTClassifier(**common, maxIter=max(1, trees // 2), maxDepth=max(2, depth // 2), stepSize=0.1, subsamplingRate=0.9, seed=seed),
        "logistic_regression": LogisticRegression(**common, regParam=1e-3, maxIter=100),
    }


def number(name: str) -> Column:
    """A feature as a finite number: null and what isn't finite are 0."""
    c = F.col(name).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)


def with_features(rows: DataFrame, features: tuple[str, ...], prefix: str = "_f_") -> DataFrame:
    """The rows with a finite column for each feature; those that are missing are 0."""
    have = set(rows.columns)
    return rows.withColumns({f"{prefix}{f}": number(f) if f in have else F.lit(0.0) for f in features})


def balanced(rows: DataFrame, human: str) -> DataFrame:
    """The rows with a weight by which both classes count the same."""
    sizes = rows.agg(F.count("*").alias("_n"), F.count_if(F.col(human)).alias("_h"))
    own = F.when(F.col(human), F.col("_h")).otherwise(F.col("_n") - F.col("_h"))
    return rows.crossJoin(F.broadcast(sizes)).withColumn("_w", F.col("_n") / (2.0 * own)).drop("_n", "_h")  # one row


def fit(rows: DataFrame, features: tuple[str, ...], kind: str = "gradient_boosting", human: str = "human", ident: str = "attempt_id", seed: int = 42, trees: int = 100, depth: int = 10) -> PipelineModel:
    """A fitted pipeline that adds ``probability``; features are named in the order that scoring uses."""
    known = rows.where(F.col(human).isNotNull()).select(ident, human, *[c for c in features if c in rows.columns])
    ready = with_features(known, features).withColumn("_y", F.col(human).cast("double"))
    ready = balanced(ready, human).repartition(FIT_PARTS, F.col(ident)).sortWithinPartitions(ident)
    assembler = VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="_v")
    return PipelineModel([assembler, estimators(seed, trees, depth)[kind].fit(assembler.transform(ready))])


def probability(rows: DataFrame, model: PipelineModel, features: tuple[str, ...], out: str) -> DataFrame:
    """The rows with the model's probability of a human."""
    made = model.transform(with_features(rows, features))
    return made.withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


@dataclass(frozen=True)
class Bundle:
    """Fitted views, the threshold chosen for them, and a density veto that belongs to both."""

    models: dict[str, PipelineModel]
    feature_views: dict[str, tuple[str, ...]]
    threshold: float
    model_name: str
    model_version: str
    feature_schema_version: str = "1.0"
    step_up_threshold: float | None = None
    veto: Density | None = None
    veto_below: float | None = None
    uses_aim: bool = False
    notes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.models or set(self.models) != set(self.feature_views) or not all(self.feature_views.values()):
            raise ValueError("each view needs a model and features")
        if not 0.0 <= self.threshold <= 1.0:
            raise ValueError("threshold must be between 0 and 1")


def save(bundle: Bundle, spark: SparkSession, folder: str) -> str:
    """Writes the bundle under its version and returns its path; the manifest goes last."""
    path = f"{folder.rstrip('/')}/{bundle.model_version}"
    for view, model in bundle.models.items():
        model.write().overwrite().save(f"{path}/models/{view}")
    if bundle.veto is not None:
        bundle.veto.save(spark, f"{path}/veto")
    manifest = {
        "model_name": bundle.model_name,
        "model_version": bundle.model_version,
        "feature_schema_version": bundle.feature_schema_version,
        "threshold": bundle.threshold,
        "step_up_threshold": bundle.step_up_threshold,
        "feature_views": {k: list(v) for k, v in bundle.feature_views.items()},
        "score_fusion": FUSION,
        "veto_below": bundle.veto_below,
        "has_veto": bundle.veto is not None,
        "uses_aim": bundle.uses_aim,
        "notes": bundle.notes,
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def versions(spark: SparkSession, folder: str) -> dict[str, str]:
    """The manifests' texts by path, of all finished bundles in a folder; none where it doesn't exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/manifest/_SUCCESS")) or []
    folders = [x.getPath().getParent().toString() for x in done]
    if not folders:
        return {}
    text = spark.read.text(folders, wholetext=True).withColumn("path", F.input_file_name())
    return {r["path"].rsplit("/manifest/", 1)[0]: r["value"] for r in text.collect()}  # one short row for each bundle


def load_newest(spark: SparkSession, folder: str) -> Bundle | None:
    """The bundle of the greatest path; None without any, or if that one's manifest is malformed: an older one is never served instead."""
    found = versions(spark, folder)
    if not found:
        return None
    path = max(found)
    try:
        held = json.loads(found[path])
    except ValueError:
        return None
    if not isinstance(held, dict) or any(k not in held for k in MANIFEST) or held.get("score_fusion") != FUSION or not held["feature_views"] or not all(held["feature_views"].values()):
        return None
    views = {k: tuple(v) for k, v in held["feature_views"].items()}
    models = {v: PipelineModel.load(f"{path}/models/{v}") for v in views}
    veto = Density.load(spark, f"{path}/veto") if held.get("has_veto") else None
    return Bundle(models, views, float(held["threshold"]), held["model_name"], held["model_version"], str(held["feature_schema_version"]), held.get("step_up_threshold"), veto, held.get("veto_below"), bool(held.get("uses_aim")), held.get("notes") or {})


def scored(rows: DataFrame, bundle: Bundle | None) -> DataFrame:
    """The rows with human_score, bot_risk_score, prediction, bot_decision and the thresholds that were used.

    The score is the least of the views', and 0 where the density veto finds
    the row below its floor; where there is no density (null), the veto says
    nothing.  Scores have six decimals.
    """
    if bundle is None:
        raise ModelNotReady("model_not_ready")
    views = [f"_view_{v}" for v in bundle.models]
    out = rows
    for view, model in bundle.models.items():
        out = probability(out, model, bundle.feature_views[view], f"_view_{view}")
    least = F.least(*views) if len(views) > 1 else F.col(views[0])
    if bundle.veto is not None and bundle.veto_below is not None:
        out = bundle.veto.scored(out, "_density")
        least = F.when(F.col("_density") < bundle.veto_below, 0.0).otherwise(least)
    human = least >= bundle.threshold
    out = out.withColumns({"human_score": rounded(least), "_human": human})
    return out.select(
        *rows.columns,
        "human_score",
        rounded(1 - F.col("human_score")).alias("bot_risk_score"),
        F.when(F.col("_human"), "human").otherwise("bot").alias("prediction"),
        F.when(F.col("_human"), "low_risk").otherwise("high_risk").alias("bot_decision"),
        F.lit(bundle.threshold).alias("threshold"),
        F.lit(bundle.step_up_threshold).cast("double").alias("step_up_threshold"),
        F.lit(bundle.model_version).alias("model_version"),
    )


def best_model(reports: DataFrame, most_rejected: float = 0.03) -> DataFrame:
    """The one model of greatest bot recall, then F1, then speed, among those that reject few enough humans; none if all reject too many.

    reports: model, human_rejected, bot_recall, f1, inference_ms.
    """
    return reports.where(F.col("human_rejected") <= most_rejected).orderBy(F.desc("bot_recall"), F.desc("f1"), F.asc_nulls_last("inference_ms"), "model").limit(1)
