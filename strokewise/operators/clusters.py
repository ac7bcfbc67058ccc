"""Clusters of weak rows: k-means from a fixed start, the same however the table is cut."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import quantiles
from .scorers import with_features

#: Rows that the start is chosen from, at most.
SAMPLE = 2_000
#: Decimals that centres keep, so that sums in another order give the same ones.
DIGITS = 9


def _start(z: np.ndarray, k: int) -> np.ndarray:
    """Farthest first: from the row nearest to the middle, always the row farthest from those chosen; of equal ones the first."""
    chosen = [int((z * z).sum(1).argmin())]
    far = ((z - z[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((z - z[chosen[-1]]) ** 2).sum(1))
    return z[chosen]


def clusters(rows: DataFrame, features: tuple[str, ...], k: int, ident: str, most: int = 50) -> DataFrame:
    """The rows with ``cluster``, 1 to k from the largest to the smallest (of equal ones the one of the least centre first).

    Features are scaled to mean 0 and deviation 1; those that are missing,
    null or not finite are 0.  Each round sends k centres to the tasks and
    gets k sums back; rounds end when no centre moves, at ``most``.
    """
    if k < 2:
        raise ValueError("clusters need at least two")
    names = [f"_f_{f}" for f in features]
    ready = with_features(rows, features)
    sums = ready.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{i}") for i, c in enumerate(names) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if sums["n"] < k:
        raise ValueError("fewer rows than clusters")
    scale = [(sums[f"m{i}"], sums[f"s{i}"] or 1.0) for i in range(len(names))]
    z = F.array(*[(F.col(c) - m) / s for c, (m, s) in zip(names, scale, strict=True)])
    ready = ready.withColumn("_z", z).drop(*names)
    first = ready.select("_z", ident).orderBy(F.xxhash64(F.lit(0), F.col(ident)), ident).limit(SAMPLE).collect()  # a bounded sample
    centres = np.round(_start(np.array([r["_z"] for r in first]), k), DIGITS)

    def labelled(centres: np.ndarray) -> DataFrame:
        known = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
        gaps = F.transform(known, lambda c: F.aggregate(F.zip_with("_z", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        return ready.withColumn("_c", F.array_position(gaps, F.array_min(gaps)) - 1)

    for _ in range(most):
        found = labelled(centres).groupBy("_c").agg(*[F.avg(F.col("_z")[i]).alias(f"v{i}") for i in range(len(features))]).collect()  # k rows
        moved = centres.copy()
        for r in found:
            moved[r["_c"]] = [round(r[f"v{i}"], DIGITS) for i in range(len(features))]
        if (moved == centres).all():
            break
        centres = moved
    sizes = {r["_c"]: r["count"] for r in labelled(centres).groupBy("_c").count().collect()}  # k rows
    order = sorted(range(k), key=lambda c: (-sizes.get(c, 0), centres[c].tolist()))
    number = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i + 1))])
    return labelled(centres).withColumn("cluster", F.element_at(number, F.col("_c").cast("int"))).drop("_z", "_c")


def summary(clustered: DataFrame, score: str, threshold: float, means: tuple[str, ...]) -> DataFrame:
    """(cluster, count, score_median, passed, mean_...) of each cluster."""
    out = clustered.groupBy("cluster").agg(F.count("*").alias("count"), F.count_if(F.col(score) >= threshold).alias("passed"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    middle = quantiles(clustered, score, [0.5], ("cluster",)).withColumnsRenamed({"cluster": "_k", "q0": "score_median"})
    return out.join(middle, F.col("cluster") == F.col("_k"), "left").select("cluster", "count", "score_median", "passed", *[f"mean_{m}" for m in means])
