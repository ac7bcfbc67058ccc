"""Paths as arrays of fixed length, and digests by which a decision can be told to rest on the same input.

Native column expressions over one struct of arrays for each path (see
``pair_signals.paths``); a path has few points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points of a canonical path, of a compared one, events of a vector at least, and decimals of digests.
CANONICAL, COMPARED, LEAST, DIGITS = 64, 32, 4, 6
EPS = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def even_by_index(a: Column, count: int) -> Column:
    """count values at even places of an array's numbers, linear in between."""
    last = F.size(a) - 1

    def one(i: Column) -> Column:
        low = lambda p: F.floor(p).cast("int")
        return let(i * last / float(count - 1), lambda p: F.get(a, low(p)) + (p - F.floor(p)) * (F.get(a, F.least(low(p) + 1, last)) - F.get(a, low(p))))

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)


def canonical(path: Column, count: int = CANONICAL) -> Column:
    """struct<xs,ys,ts>: from (0, 0) to (1, 0), time from 0 to 1, at even numbers; zeros for fewer than two points.

    A path that ends where it began is only moved; one without duration has even times.
    """
    xs, ys, ts = path["xs"], path["ys"], path["ts"]
    n = F.size(xs)
    end = lambda a: F.element_at(a, -1) - a[0]
    about = F.struct(end(xs).alias("x"), end(ys).alias("y"), (end(xs) * end(xs) + end(ys) * end(ys)).alias("square"), end(ts).alias("span"))

    def made(v: Column) -> Column:
        turned = lambda d, e: F.when(F.sqrt(v["square"]) < EPS, d).otherwise((d * v["x"] + e * v["y"]) / v["square"])
        crossed = lambda d, e: F.when(F.sqrt(v["square"]) < EPS, e).otherwise((e * v["x"] - d * v["y"]) / v["square"])
        x = F.zip_with(xs, ys, lambda p, q: turned(p - xs[0], q - ys[0]))
        y = F.zip_with(xs, ys, lambda p, q: crossed(p - xs[0], q - ys[0]))
        t = F.transform(ts, lambda p, i: F.when(v["span"] > EPS, (p - ts[0]) / v["span"]).otherwise(i / (n - 1)))
        return F.struct(even_by_index(x, count).alias("xs"), even_by_index(y, count).alias("ys"), even_by_index(t, count).alias("ts"))

    zeros = F.array_repeat(F.lit(0.0), count)
    return F.when(n >= 2, let(about, made)).otherwise(F.struct(zeros.alias("xs"), zeros.alias("ys"), zeros.alias("ts")))


def canonical_points(paths: DataFrame, key: str, count: int = CANONICAL) -> DataFrame:
    """(key, i, x, y, t): the points of ``canonical`` as rows, of paths of two points or more.

    Each row computes the two points that it lies between, so a path is never
    worked through once for each of its points.
    """
    rows = paths.where(F.size("path.xs") >= 2).select(key, F.col("path.xs").alias("xs"), F.col("path.ys").alias("ys"), F.col("path.ts").alias("ts"))
    ends = {f"{c}{i}": F.element_at(f"{c}s", at) for c in "xyt" for i, at in ((0, 1), (1, -1))}
    rows = rows.withColumns({**ends, "last": F.size("xs") - 1})
    v, w = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = rows.withColumns({"v": v, "w": w, "square": v * v + w * w, "span": F.col("t1") - F.col("t0")})
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("p", F.col("i") * F.col("last") / float(count - 1))
    rows = rows.withColumn("low", F.floor("p").cast("int")).withColumns({"high": F.least(F.col("low") + 1, F.col("last")), "part": F.col("p") - F.floor("p")})

    def turned(at: str) -> tuple[Column, Column, Column]:
        d, e, t = (F.get(f"{c}s", F.col(at)) - F.col(f"{c}0") for c in "xyt")
        far, square = F.sqrt("square") >= EPS, F.col("square")
        return F.when(far, (d * F.col("v") + e * F.col("w")) / square).otherwise(d), F.when(far, (e * F.col("v") - d * F.col("w")) / square).otherwise(e), F.when(F.col("span") > EPS, t / F.col("span")).otherwise(F.col(at) / F.col("last"))

    between = [a + F.col("part") * (b - a) for a, b in zip(turned("low"), turned("high"), strict=True)]
    return rows.select(key, F.col("i").cast("long").alias("i"), *[c.alias(n) for c, n in zip(between, "xyt", strict=True)])


def vectors(trace: DataFrame, key: str, width: float, height: float, count: int) -> DataFrame:
    """(key, xs, ys, gaps) of attempts of four events or more: places within the box, and logarithms of the time between them, at even numbers."""
    w = Window.partitionBy(key).orderBy("seq")
    gone = F.max("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.first("t").over(w)
    clamp = lambda c, size: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / max(size, 1.0)))
    rows = trace.withColumns({"px": clamp("x", width), "py": clamp("y", height), "pt": gone.cast("double")})
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "px", "py", "pt"))).alias("p")).where(F.size("p") >= LEAST)
    times = even_by_index(F.col("p")["pt"], count)
    gaps = let(times, lambda t: F.transform(t, lambda v, i: F.log1p(F.greatest(F.lit(0.0), v - F.get(t, F.greatest(i - 1, F.lit(0)))))))
    return held.select(key, even_by_index(F.col("p")["px"], count).alias("xs"), even_by_index(F.col("p")["py"], count).alias("ys"), gaps.alias("gaps"))


def box_similarity(a: Column, b: Column, count: int = COMPARED) -> Column:
    """1 / (1 + mean distance) of two paths at even numbers, each axis from 0 to 1; 0 if either has fewer than two points or one that isn't finite."""

    def ready(values: Column) -> Column:
        return let(even_by_index(values, count), lambda v: let(F.struct(F.array_min(v).alias("l"), F.array_max(v).alias("h")), lambda s: F.transform(v, lambda x: F.when(s["h"] - s["l"] > EPS, (x - s["l"]) / (s["h"] - s["l"])).otherwise(0.0))))

    square = lambda p, q: F.zip_with(p, q, lambda x, y: (x - y) * (x - y))
    both = F.zip_with(square(ready(a["xs"]), ready(b["xs"])), square(ready(a["ys"]), ready(b["ys"])), lambda x, y: F.sqrt(x + y))
    mean = F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / count
    solid = lambda p: (F.size(p["xs"]) >= 2) & F.forall(F.concat(p["xs"], p["ys"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(solid(a) & solid(b), 1 / (1 + mean)).otherwise(0.0)


def _fixed(c: Column) -> Column:
    """A number in fixed decimals, as text; null stays empty."""
    scaled = F.rint(c.cast("double") * 10**DIGITS)
    return F.coalesce(scaled.try_cast("long").cast("string"), c.cast("string"), F.lit(""))


def audit(trace: DataFrame, features: DataFrame, key: str = "attempt_id") -> DataFrame:
    """(key, event_count, input_digest, feature_digest): what a score was computed from, in fixed decimals; other columns don't change it."""
    event = F.concat_ws(":", F.coalesce(F.col("seq").cast("string"), F.lit("")), F.coalesce(F.col("kind"), F.lit("")), *[_fixed(F.col(c)) for c in ("t", "x", "y")])
    events = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", event.alias("e")))), lambda s: s["e"]), ";")  # an attempt has few events
    seen = trace.groupBy(key).agg(F.count("*").alias("event_count"), F.sha2(events, 256).alias("input_digest"))
    names = sorted(c for c in features.columns if c != key)
    text = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), _fixed(F.col(n))) for n in names])
    return seen.join(features.select(key, F.sha2(text, 256).alias("feature_digest")), key, "left")
