"""Rows in range-sorted partitions, and their places in groups that span partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import written

#: Rows in a range, about.
ROWS = 200_000
_MASK = (1 << 33) - 1


def tasks(table: DataFrame, rows: int = ROWS) -> int:
    """How many ranges a written table is cut into: so many rows in each, and fewer where cores would idle."""
    count, least = table.count(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-count // rows), min(least, count // 1000))


def ranges(table: DataFrame, *order: Column, rows: int = ROWS) -> DataFrame:
    """The written table in sorted ranges, which no key can make large as long as the order tells its rows apart."""
    return table.repartitionByRange(tasks(table, rows), *order).sortWithinPartitions(*order)


def placed(table: DataFrame, groups: list[str], order: list[Column], what: str, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(the rows with ``range`` and ``at``, counts): a written table sorted by groups, then by the order.

    ``at`` numbers the rows of a range.  counts holds for each range and group
    where the group begins (``least``, an ``at``), its rows there (``n``), its
    rows in earlier ranges (``before``), its ``total``, and the first range it
    stands in (``home``).  A window of counts holds a row for each range.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups]
    at = F.monotonically_increasing_id()
    out = written(ranges(table, *keys, *order, rows=rows).select("*", F.spark_partition_id().cast("long").alias("range"), at.bitwiseAND(F.lit(_MASK)).alias("at")), what)
    counts = out.groupBy("range", *groups).agg(F.min("at").alias("least"), F.count("*").alias("n"))
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("n").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out, counts.select("*", before.alias("before"), F.sum("n").over(w).alias("total"), F.min("range").over(w).alias("home"))


def positions(table: DataFrame, groups: list[str], order: list[Column], what: str, rows: int = ROWS) -> DataFrame:
    """The written table's rows with ``place`` (from 0 in their group) and ``total``; a group may span any number of tasks."""
    out, counts = placed(table, groups, order, what, rows)
    counts = counts.select(F.col("range").alias("_range"), *[F.col(g).alias(f"_{g}") for g in groups], "least", "before", "total")
    same = F.col("range") == F.col("_range")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return out.join(counts, same).select(*table.columns, (F.col("at") - F.col("least") + F.col("before")).alias("place"), "total")
