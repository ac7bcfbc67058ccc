"""How dense the human region is around a row: scaled nearest neighbours and an isolation forest.

Both are fitted on a bounded sample of humans (``SAMPLE`` rows by a hash, the
same whatever the partitioning); every row is scored against it, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the neighbours are searched among, at most.
SAMPLE = 20_000
#: Neighbours with the row itself, trees, rows of a tree, percentiles of the references, and the logistic's slope and shift.
NEIGHBOURS, TREES, TREE_ROWS = 15, 300, 256
FAR, LOW, HIGH = 95.0, 5.0, 95.0
SLOPE, SHIFT = 4.0, 2.0
#: Features that a larger window changes, which density must not rest on.
EXCLUDED = ("event_count", "duration_ms", "total_distance", "displacement", "y_deviation", "interval_mean_ms", "interval_std_ms")
EULER = 0.5772156649015329


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth at which a search among n ends without success."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3.0)
    long = 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, depth at a leaf) of one random tree; a leaf has feature -1 and counts what it still holds."""
    nodes: list[tuple[int, float, int, int, float]] = []
    todo = [(np.arange(len(rows)), 0, -1, 0)]
    while todo:
        own, level, above, side = todo.pop()
        at = len(nodes)
        if above >= 0:
            f, cut, left, right, d = nodes[above]
            nodes[above] = (f, cut, at if side == 0 else left, at if side == 1 else right, d)
        low, high = (rows[own].min(axis=0), rows[own].max(axis=0)) if len(own) > 1 else (np.zeros(rows.shape[1]),) * 2
        spread = np.flatnonzero(high > low)
        if level >= depth or not len(spread):
            nodes.append((-1, 0.0, at, at, level + float(expected_path(np.array(len(own))))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append((f, cut, -1, -1, 0.0))
        below = rows[own, f] <= cut
        todo += [(own[below], level + 1, at, 0), (own[~below], level + 1, at, 1)]
    return nodes


@dataclass(frozen=True)
class Density:
    """The fitted references; ``score`` is in 0..1 and falls without end beyond the humans."""

    names: tuple[str, ...]
    mean: np.ndarray
    spread: np.ndarray
    sample: np.ndarray
    neighbours: int
    reference: float
    trees: list[np.ndarray]
    tree_rows: int
    low: float
    high: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) - self.mean) / self.spread

    def distances(self, z: np.ndarray) -> np.ndarray:
        """Mean distance to the nearest of the sample, the very nearest left out."""
        out = np.zeros(len(z))
        square = (self.sample * self.sample).sum(axis=1)
        for i in range(0, len(z), 256):
            part = z[i : i + 256]
            d = np.maximum((part * part).sum(axis=1)[:, None] + square[None] - 2 * part @ self.sample.T, 0.0)
            near = np.sqrt(np.sort(np.partition(d, self.neighbours - 1, axis=1)[:, : self.neighbours], axis=1))
            out[i : i + 256] = near[:, 1:].mean(axis=1) if self.neighbours > 1 else 0.0
        return out

    def isolation(self, z: np.ndarray) -> np.ndarray:
        """Minus 2 to the power of minus the mean depth over the expected one: near -1 for rows that are soon alone."""
        depth = np.zeros(len(z))
        rows = np.arange(len(z))
        for tree in self.trees:
            feature, cut, left, right, end = tree[:, 0].astype(int), tree[:, 1], tree[:, 2].astype(int), tree[:, 3].astype(int), tree[:, 4]
            at = np.zeros(len(z), int)
            inner = feature[at] >= 0
            while inner.any():
                below = z[rows, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
                inner = feature[at] >= 0
            depth += end[at]
        return -(2.0 ** (-depth / max(len(self.trees), 1) / max(float(expected_path(np.array(self.tree_rows))), 1e-9)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x)
        near = np.exp(-self.distances(z) / self.reference)
        steep = SLOPE / max(self.high - self.low, 1e-9)
        return np.minimum(near, 1.0 / (1.0 + np.exp(-(self.isolation(z) - self.low) * steep + SHIFT)))

    def scored(self, rows: DataFrame, out: str) -> DataFrame:
        """The rows with their density; features that are missing, null or not finite count as 0."""
        held = rows.sparkSession.sparkContext.broadcast(self)  # SAMPLE rows and TREES trees at most
        names = [f"c{i}" for i in range(len(rows.columns))]
        values = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0) for n in self.names])
        ready = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=True)], values.alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            for batch in batches:
                x = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(model.score(x) if len(x) else np.zeros(0))], names=[*names, "d"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
        return ready.mapInArrow(run, f"{fields}, d double").toDF(*rows.columns, out)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of references, the sample and the trees as Parquet."""
        one = [(list(self.names), self.mean.tolist(), self.spread.tolist(), self.neighbours, self.reference, self.tree_rows, self.low, self.high)]
        spark.createDataFrame(one, "names array<string>, mean array<double>, spread array<double>, neighbours int, reference double, tree_rows int, low double, high double").coalesce(1).write.mode("overwrite").parquet(f"{path}/references")
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(self.sample)], "i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/sample")
        spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(self.trees)], "i int, nodes array<array<double>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Density:
        r = spark.read.parquet(f"{path}/references").first()
        sample = np.array([x["v"] for x in spark.read.parquet(f"{path}/sample").orderBy("i").collect()])  # SAMPLE rows
        trees = [np.array(x["nodes"]) for x in spark.read.parquet(f"{path}/trees").orderBy("i").collect()]  # TREES rows
        return cls(tuple(r["names"]), np.array(r["mean"]), np.array(r["spread"]), sample, r["neighbours"], r["reference"], trees, r["tree_rows"], r["low"], r["high"])


def fit(humans: DataFrame, features: tuple[str, ...], ident: str = "attempt_id", sample: int = SAMPLE, trees: int = TREES, seed: int = 7) -> Density:
    """Scaled by all humans; neighbours, trees and references from a bounded sample of them.

    Trees grow in tasks, each from its own rows of the sample.
    """
    names = tuple(f for f in features if f not in EXCLUDED)
    spark = humans.sparkSession
    clean = [F.when(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n).cast("double")) < float("inf")), F.col(n).cast("double")).otherwise(0.0).alias(n) for n in names]
    rows = humans.select(F.col(ident).alias("_i"), *clean)
    sums = rows.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if sums["m0"] is None:
        raise ValueError("density needs humans to be fitted on")
    mean, spread = (np.array([sums[f"{k}{i}"] for i in range(len(names))], float) for k in ("m", "s"))
    spread[spread == 0] = 1.0
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "_i"), "_i").limit(sample).toArrow()  # a bounded sample
    z = (np.stack([chosen.column(n).to_numpy() for n in names], axis=1) - mean) / spread
    own = min(TREE_ROWS, len(z))
    shared = spark.sparkContext.broadcast(z)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                made.append([list(map(float, n)) for n in grow(shared.value[rng.choice(len(shared.value), own, replace=False)], rng, int(np.ceil(np.log2(max(own, 2)))))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.list_(pa.float64())))], names=["id", "nodes"])

    grown = spark.range(trees).repartition(8).mapInArrow(plant, "id long, nodes array<array<double>>").orderBy("id").collect()  # TREES rows
    first = Density(names, mean, spread, z, min(NEIGHBOURS, len(z)), 1.0, [np.array(t["nodes"]) for t in grown], own, 0.0, 1.0)
    held = spark.sparkContext.broadcast(first)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            model = held.value
            yield pa.RecordBatch.from_arrays([pa.array(model.distances(model.sample[at])), pa.array(model.isolation(model.sample[at]))], names=["d", "s"])

    seen = spark.range(len(z)).repartition(8).mapInArrow(measure, "d double, s double").toArrow()  # SAMPLE rows
    far, low, high = float(np.percentile(seen.column("d"), FAR)), *(float(np.percentile(seen.column("s"), p)) for p in (LOW, HIGH))
    return Density(names, mean, spread, z, first.neighbours, far or 1.0, first.trees, own, low, high)
