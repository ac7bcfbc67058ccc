"""Running sums over a whole table, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 64


def running(rows: DataFrame, order: str, values: dict[str, str], descending: bool = False, by: tuple[str, ...] = (), part: Column | None = None) -> DataFrame:
    """The rows with, for each new name, the sum of its column over all rows of lower order (higher, if descending), of the same ``by``.

    Equal orders must not occur twice within a ``by``.  Rows are cut into
    ranges at approximate quantiles, or by ``part``, a number that rises with
    the order; sums run within ranges, and a table of one row per range (and
    ``by``) gives what lies before each.  Nothing runs while the query is built.
    """
    if part is None:
        cuts = rows.agg(F.percentile_approx(order, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), 2_000).alias("_cuts"))
        rows = rows.crossJoin(F.broadcast(cuts))  # one row
        part = F.size(F.filter(F.array_distinct("_cuts"), lambda b: b <= F.col(order)))
    rows = rows.withColumn("_part", part).drop("_cuts")
    to = F.desc if descending else F.asc
    before = Window.partitionBy(*by, "_part").orderBy(to(order)).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in values.items()])
    ranges = Window.partitionBy(*by).orderBy(to("_part")).rowsBetween(Window.unboundedPreceding, -1)  # over at most as many rows as ranges
    totals = totals.select(*by, F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(ranges), F.lit(0)).alias(f"_{n}") for n in values]).withColumnsRenamed({c: f"_by_{c}" for c in by})
    inside = rows.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in values.items()})
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = inside.join(totals if by else F.broadcast(totals), same)  # without by: as many rows as ranges
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop("_part", "_of", *[f"_by_{c}" for c in by], *[f"_{n}" for n in values])
