"""Path reuse: fingerprints, session history, similarity of paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Fixed value: decimals that a path's fingerprint keeps.
DECIMALS = 6


def fingerprints(trace: DataFrame) -> DataFrame:
    """(user_id, ano, attempt_id, fingerprint, duration, end_x, end_y, at_us): a hash of each path moved to the origin, in fixed decimals.

    Points that aren't finite are left out; the number of points is part of the
    hash, and a path of fewer than two has none (null).
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    solid = finite("x") & finite("y")
    w = Window.partitionBy("attempt_id")
    start = lambda c: F.min_by(F.when(solid, F.col(c)), F.when(solid, F.col("seq"))).over(w)
    rows = trace.withColumns({"px": F.col("x") - start("x"), "py": F.col("y") - start("y")})
    scaled = lambda c: F.rint(F.col(c) * 10**DECIMALS)
    number = lambda c: F.coalesce(scaled(c).try_cast("long").cast("string"), F.col(c).cast("string"))
    point = F.when(solid, F.struct("seq", F.concat_ws(",", number("px"), number("py")).alias("p")))
    points = F.array_sort(F.collect_list(point))  # an attempt has few events
    path = F.concat(F.size(points).cast("string"), F.lit(";"), F.array_join(F.transform(points, lambda s: s["p"]), ";"))
    out = rows.groupBy("user_id", "ano", "attempt_id").agg(F.when(F.size(points) >= 2, F.sha2(path, 256)).alias("fingerprint"), (F.max("t") - F.min("t")).alias("duration"), F.max_by("x", "seq").alias("end_x"), F.max_by("y", "seq").alias("end_y"), F.max("at_us").alias("at_us"))
    return out


def seen_before(prints: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The rows with whether their value came earlier under their key."""
    return prints.withColumn("seen_before", F.row_number().over(Window.partitionBy(key, value).orderBy(*order)) > 1)


def history(prints: DataFrame, window_us: int, newest: int, duration_tolerance: float = 2.0, end_tolerance: float = 0.01, recent_us: int = 60_000_000) -> DataFrame:
    """Replay features of each attempt against the newest attempts of its session in the window before it.

    The past is a frame of the last ``newest`` rows, so no attempt is paired with its whole session.
    """
    past = Window.partitionBy("user_id").orderBy("at_us", "ano").rowsBetween(-newest, -1)
    rows = prints.withColumn("past", F.filter(F.collect_list(F.struct("fingerprint", "duration", "end_x", "end_y", "at_us")).over(past), lambda h: F.col("at_us") - h["at_us"] <= window_us))
    count = lambda test: F.size(F.filter("past", test)).cast("long")
    out = rows.select(
        "attempt_id",
        F.exists("past", lambda h: F.coalesce(h["fingerprint"] == F.col("fingerprint"), F.lit(False))).alias("exact_replay_detected"),
        count(lambda h: F.abs(h["duration"] - F.col("duration")) <= duration_tolerance).alias("repeated_duration_count"),
        count(lambda h: (F.abs(h["end_x"] - F.col("end_x")) <= end_tolerance) & (F.abs(h["end_y"] - F.col("end_y")) <= end_tolerance)).alias("repeated_endpoint_count"),
        count(lambda h: F.col("at_us") - h["at_us"] <= recent_us).alias("recent_attempt_count"),
    )
    return out.withColumn("attempts_per_minute", F.col("recent_attempt_count") * 60_000_000.0 / recent_us)


def resampled(trace: DataFrame, points: int = 32) -> DataFrame:
    """(user_id, ano, attempt_id, n, xs, ys): paths without repeated points, at equal steps of arc length; null where nothing moves."""
    order = Window.partitionBy("attempt_id").orderBy("seq")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2))
    rows = trace.where(finite("x") & finite("y")).withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("first", F.row_number().over(order) == 1)
    rows = rows.where("first or step > 1e-12").withColumn("arc", F.sum("step").over(order))
    rows = rows.withColumns({"next_arc": F.lead("arc").over(order), "next_x": F.lead("x").over(order), "next_y": F.lead("y").over(order), "total": F.max("arc").over(Window.partitionBy("attempt_id")), "n": F.count("*").over(Window.partitionBy("attempt_id"))})
    # each stretch makes the points that fall into it, so a path is never searched for them
    scale = (points - 1) / F.col("total")
    from_, to = F.ceil(F.col("arc") * scale - 1e-9), F.ceil(F.col("next_arc") * scale - 1e-9) - 1
    last = F.col("next_arc") >= F.col("total")
    numbers = F.sequence(from_.cast("int"), F.when(last, points - 1).otherwise(to).cast("int"))
    made = rows.where("total > 0 and next_arc is not null").where(F.when(last, F.lit(points - 1)).otherwise(to) >= from_).select("user_id", "ano", "attempt_id", "n", "x", "y", "next_x", "next_y", "arc", "next_arc", "total", F.explode(numbers).alias("i"))
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("i") * F.col("total") / (points - 1) - F.col("arc")) / (F.col("next_arc") - F.col("arc"))))
    point = F.struct("i", (F.col("x") + at * (F.col("next_x") - F.col("x"))).alias("x"), (F.col("y") + at * (F.col("next_y") - F.col("y"))).alias("y"))
    path = made.groupBy("user_id", "ano", "attempt_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(point)).alias("p"))  # `points` of them
    return path.select("user_id", "ano", "attempt_id", "n", F.transform("p", lambda q: q["x"]).alias("xs"), F.transform("p", lambda q: q["y"]).alias("ys"))


def unit(xs: Column, ys: Column) -> Column:
    """struct<xs,ys> around the mean and of unit norm; null for a path without extent."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    let = lambda value, body: F.transform(F.array(value), body)[0]
    square = lambda c: total(F.transform(c["xs"], lambda v: v * v)) + total(F.transform(c["ys"], lambda v: v * v))
    means = F.struct((total(xs) / F.size(xs)).alias("x"), (total(ys) / F.size(ys)).alias("y"))
    moved = lambda m: F.struct(F.transform(xs, lambda v: v - m["x"]).alias("xs"), F.transform(ys, lambda v: v - m["y"]).alias("ys"))
    scaled = lambda c: let(F.sqrt(square(c)), lambda n: F.when(n > 1e-12, F.struct(F.transform(c["xs"], lambda v: v / n).alias("xs"), F.transform(c["ys"], lambda v: v / n).alias("ys"))))
    return let(let(means, moved), scaled)


#: Paths in a block of pairs, at least and at most, and blocks of a group where that allows: each path is sent once for every block, and a task holds two.
BLOCK, MOST, BLOCKS = 128, 65_536, 8
#: Paths of either block that are compared at once in a task.
NEW, OLD = 256, 512


def _cells(rows: DataFrame, group: str, size: int | None, reach: int | None) -> DataFrame:
    """The rows (with rn, from 0 in their group) once for each pair of blocks that they take part in: (cur, old) are the blocks, ``as_old`` the part.

    Without a size, blocks grow with their group, so that what is sent does not grow faster than the rows.
    """
    n = F.count("*").over(Window.partitionBy(group))
    size = F.lit(size) if size else F.least(F.lit(MOST), F.greatest(F.lit(BLOCK), F.ceil(n / BLOCKS)))
    own = F.floor(F.col("rn") / size).cast("int")
    last = F.floor((n - 1) / size).cast("int")
    rows = rows.withColumns({"own": own, "last": last})
    low = F.greatest(F.lit(0), F.col("own") - reach) if reach is not None else F.lit(0)
    high = F.least(F.col("last"), F.col("own") + reach) if reach is not None else F.col("last")
    as_new = rows.withColumn("old", F.explode(F.sequence(low, F.col("own")))).withColumn("cur", F.col("own")).withColumn("as_old", F.lit(False))
    as_old = rows.withColumn("cur", F.explode(F.sequence(F.col("own"), high))).withColumn("old", F.col("own")).withColumn("as_old", F.lit(True))
    return as_new.unionByName(as_old).drop("own", "last")


def best_before(units: DataFrame, group: str, order: list[str], ident: str, newest: int | None = None, window: tuple[str, int] | None = None, sharpness: float = 4.0) -> DataFrame:
    """(ident, best, compared): each path's greatest similarity to those before it in its group, and how many these are.

    units has ``u``, a struct of xs and ys around their mean and of unit norm,
    or null, which is like nothing.  newest bounds how many before it, window
    (a column and a width) how long.  A task compares two blocks of paths by
    matrix products, some rows of each at a time: no group is ever held whole,
    and without newest all pairs of a group are compared.
    """
    width = window[1] if window else None

    def compare(cell: pa.Table) -> pa.Table:
        ids, _, parts = _likeness(cell, newest, width, sharpness)
        best, compared = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for row, _, like, past in parts:
            own = slice(row, row + len(like))
            best[own] = np.maximum(best[own], like.max(axis=1, initial=0.0))
            compared[own] += past.sum(axis=1)
        return pa.Table.from_arrays([ids, pa.array(best), pa.array(compared)], names=["i", "best", "compared"])

    kind = units.schema[ident].dataType.simpleString()
    cells = _compared(units, group, order, ident, newest, window).applyInArrow(compare, f"i {kind}, best double, compared long")
    return cells.groupBy(F.col("i").alias(ident)).agg(F.max("best").alias("best"), F.sum("compared").alias("compared"))


def similar_pairs(units: DataFrame, group: str, order: list[str], ident: str, least: float, newest: int | None = None, sharpness: float = 4.0) -> DataFrame:
    """(ident, source, similarity) of all pairs of a group, the source first in order, that are at least so similar."""

    def compare(cell: pa.Table) -> pa.Table:
        ids, sources, parts = _likeness(cell, newest, None, sharpness)
        rows, cols, likes = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        for at, old, like, past in parts:
            row, col = np.nonzero(past & (like >= least))
            rows, cols, likes = [*rows, row + at], [*cols, col + old], [*likes, like[row, col]]
        return pa.Table.from_arrays([ids.take(pa.array(np.concatenate(rows))), sources.take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(likes))], names=["i", "source", "similarity"])

    kind = units.schema[ident].dataType.simpleString()
    return _compared(units, group, order, ident, newest, None).applyInArrow(compare, f"i {kind}, source {kind}, similarity double").withColumnRenamed("i", ident)


def _compared(units: DataFrame, group: str, order: list[str], ident: str, newest: int | None, window: tuple[str, int] | None):
    """Pairs of blocks of a group's paths, grouped."""
    size = min(BLOCK, newest) if newest else None
    at = F.col(window[0]).cast("double") if window else F.lit(0.0)
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    rows = units.select(F.col(group).alias("g"), F.col(ident).alias("i"), rn.alias("rn"), at.alias("at"), F.col("u.xs").alias("xs"), F.col("u.ys").alias("ys"))
    return _cells(rows, "g", size, -(-newest // size) if newest else None).groupBy("g", "cur", "old")


def _likeness(cell: pa.Table, newest: int | None, width: float | None, sharpness: float) -> tuple[pa.ChunkedArray, pa.ChunkedArray, Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
    """The ids of a cell's two blocks, and by parts of them: where they begin, their similarities, and which pairs are asked for."""
    old = cell.column("as_old").to_numpy(zero_copy_only=False)
    sides = []
    for part in (cell.filter(pa.array(~old)), cell.filter(pa.array(old))):
        known = part.column("xs").is_valid().to_numpy(zero_copy_only=False)
        arrays = []
        for c in ("xs", "ys"):
            flat = part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            full = np.zeros((len(known), len(flat) // known.sum() if known.any() else 1))
            full[known] = flat.reshape(-1, full.shape[1]) if known.any() else 0.0
            arrays.append(full)
        sides.append((arrays, known, part.column("rn").to_numpy(), part.column("at").to_numpy(), part.column("i")))
    (a, ka, na, ta, ids), (b, kb, nb, tb, sources) = sides

    def parts() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i in range(0, len(na), NEW):
            for j in range(0, len(nb), OLD):
                own, other = slice(i, i + NEW), slice(j, j + OLD)
                gap = na[own, None] - nb[None, other]
                past = (gap > 0) & (gap <= newest) if newest else gap > 0
                if width is not None:
                    past &= (ta[own, None] - tb[None, other]) <= width
                like = np.zeros(past.shape)
                if past.any() and ka[own].any() and kb[other].any():
                    xx, xy, yx, yy = (p[own] @ q[other].T for p in a for q in b)
                    both = np.sqrt(np.maximum(xx**2 + xy**2 + yx**2 + yy**2 + 2 * np.abs(xx * yy - xy * yx), 0))  # the singular values' sum
                    like = 1 / (1 + sharpness * np.sqrt(np.maximum(2 - 2 * both, 0)))
                    like = np.where(past & ka[own, None] & kb[None, other], like, 0.0)
                yield i, j, like, past

    return ids, sources, parts()


def similarity(paths: DataFrame, previous: int, window: tuple[str, int] | None = None) -> DataFrame:
    """(attempt_id, max_similarity, compared): Procrustes similarity to the session's previous paths; 0 without any."""
    ready = paths.withColumn("u", unit(F.col("xs"), F.col("ys")))
    return best_before(ready, "user_id", ["ano"], "attempt_id", previous, window).withColumnRenamed("best", "max_similarity")


def warp_resistant(n: Column, least: int = 31) -> Column:
    """Whether a path has enough points for its similarity to withstand warping."""
    return n >= least


def centred(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Flat paths x0,y0,x1,y1,... as xs and ys around their mean, of unit norm; degenerate ones have null."""
    part = lambda first: F.transform(F.filter(F.col(column), lambda _, i: i % 2 == first), lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    out = vectors.withColumns({"xs": part(0), "ys": part(1)})
    for c in ("xs", "ys"):
        out = out.withColumn(f"{c}_mean", total(F.col(c)) / F.size(c)).withColumn(c, F.expr(f"transform({c}, v -> v - {c}_mean)"))
    norm = F.sqrt(total(F.transform("xs", lambda v: v * v)) + total(F.transform("ys", lambda v: v * v)))
    out = out.withColumn("norm", norm).withColumn("norm", F.when(F.col("norm") > 1e-12, F.col("norm")))
    return out.withColumns({"xs": F.expr("transform(xs, v -> v / norm)"), "ys": F.expr("transform(ys, v -> v / norm)")}).drop("norm", "xs_mean", "ys_mean")


def procrustes_best(paths: DataFrame, key: str, ident: str, previous: int | None = None) -> DataFrame:
    """(ident, best, n): the greatest similarity to the paths before it of the same key, to so many or all, and how many these are."""
    ready = centred(paths).select(key, ident, F.when(F.get("xs", F.lit(0)).isNotNull(), F.struct("xs", "ys")).alias("u"))
    return best_before(ready, key, [ident], ident, previous).withColumnRenamed("compared", "n")
