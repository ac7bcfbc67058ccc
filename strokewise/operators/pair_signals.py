"""How alike two paths are: dynamic time warping and fourteen other signals, for batches of pairs.

A batch's paths lie flat, one after the other; all steps run over the whole
batch.  A path is points in order with times; those that aren't finite are
left out.  Signals are in 0..1, and 0 where either path has fewer than two
points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The signals' names, in order.
SIGNALS = (
    "dtw_similarity",
    "affine_median_similarity",
    "affine_p90_similarity",
    "direction_similarity",
    "curvature_similarity",
    "timing_similarity",
    "speed_profile_similarity",
    "multi_scale_shape_similarity",
    "event_count_ratio",
    "procrustes_shape_similarity",
    "arc_curvature_profile_similarity",
    "distance_shape_similarity",
    "trimmed_procrustes_shape_similarity",
    "aligned_chamfer_shape_similarity",
    "boundary_inlier_procrustes_similarity",
)
#: Points of resampled paths, the finer and coarser scales, points for chords, most points that are warped alone.
POINTS, SCALES, CHORD_POINTS, WARPED = 48, (16, 32, 64), 24, 96
#: Shares kept by trimming, and the margin within which a point counts as clamped.
KEPT, NEAREST, MARGIN = 0.72, 0.80, 0.003
#: Pairs compared at once.
TOGETHER = 512


class Paths:
    """Paths of any lengths, flat; ``first`` has each one's start, and the end of all."""

    def __init__(self, x: np.ndarray, y: np.ndarray, t: np.ndarray, first: np.ndarray):
        self.x, self.y, self.t, self.first = x, y, t, first

    @classmethod
    def of(cls, arrays: pa.StructArray) -> Paths:
        x, y, t = (arrays.field(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("xs", "ys", "ts"))
        owner = np.repeat(np.arange(len(arrays)), np.diff(arrays.field("xs").offsets.to_numpy()))
        return cls(x, y, t, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(arrays)))])).only(np.isfinite(x) & np.isfinite(y) & np.isfinite(t))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.sizes)

    def only(self, keep: np.ndarray) -> Paths:
        return Paths(self.x[keep], self.y[keep], self.t[keep], np.concatenate([[0], np.cumsum(keep)])[self.first])

    def steps(self) -> np.ndarray:
        """Each point's distance from the one before in its path; 0 for the first."""
        step = np.hypot(np.diff(self.x, prepend=0), np.diff(self.y, prepend=0))
        step[self.first[:-1][self.sizes > 0]] = 0
        return step

    def along(self) -> np.ndarray:
        """Each point's distance from its path's start along the path."""
        return _restart(self.steps(), self.first)

    def distinct(self) -> Paths:
        """Without points that repeat the one before."""
        same = np.concatenate([[False], (np.diff(self.x) == 0) & (np.diff(self.y) == 0)])[: len(self.x)]
        same[self.first[:-1][self.sizes > 0]] = False
        return self.only(~same)


def _restart(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each path."""
    sums = np.cumsum(steps)
    sizes = np.diff(first)
    before = np.where(sizes > 0, sums[np.minimum(first[:-1], max(len(sums) - 1, 0))], 0) if len(sums) else np.zeros(len(sizes))
    return sums - np.repeat(before, sizes)


def at_even(values: list[np.ndarray], at: np.ndarray, first: np.ndarray, count: int) -> list[np.ndarray]:
    """Each value, linear in between, at count even places of each path's ``at``, which rises from 0; 0 for paths of no extent."""
    sizes = np.diff(first)
    ends = np.where(sizes > 0, at[np.maximum(first[1:] - 1, 0)] if len(at) else 0.0, 0.0)
    moving = (ends > 0) & (sizes > 1)
    scale = np.where(moving, ends, 1.0)
    # where a place lies is found among all paths at once: path i has 2i .. 2i+1
    mark = np.repeat(2.0 * np.arange(len(sizes)), sizes) + at / np.repeat(scale, sizes)
    part = np.linspace(0.0, 1.0, count)
    found = np.searchsorted(mark, (2.0 * np.arange(len(sizes)))[:, None] + part[None, :], side="right") - 1
    low = np.clip(found, first[:-1, None], np.maximum(first[1:, None] - 2, first[:-1, None]))
    low = np.minimum(low, max(len(at) - 2, 0))
    if len(at) < 2:
        return [np.zeros((len(sizes), count)) for _ in values]
    width = at[low + 1] - at[low]
    share = np.clip((part[None, :] * ends[:, None] - at[low]) / np.where(width > 0, width, 1.0), 0.0, 1.0)
    return [np.where(moving[:, None], v[low] + share * (v[low + 1] - v[low]), 0.0) for v in values]


def by_index(values: list[np.ndarray], first: np.ndarray, count: int) -> list[np.ndarray]:
    at = np.arange(first[-1], dtype=float) - np.repeat(first[:-1], np.diff(first))
    return at_even(values, at, first, count)


def by_arc(paths: Paths, count: int) -> np.ndarray:
    """(paths, count, 2): points at even steps along each path; one that doesn't move stays where it is."""
    along = paths.along()
    apart = np.diff(along, prepend=-1.0) > 1e-12
    apart[paths.first[:-1][paths.sizes > 0]] = True
    kept = paths.only(apart)
    out = np.stack(at_even([kept.x, kept.y], along[apart], kept.first, count), axis=2)
    still = (kept.sizes == 1) & (paths.sizes > 0)
    start = kept.first[:-1][still]
    out[still] = np.stack([kept.x[start], kept.y[start]], axis=1)[:, None, :]
    return out


def _even(points: np.ndarray) -> Paths:
    """Paths from an array of equally long ones."""
    n, count, _ = points.shape
    return Paths(points[:, :, 0].ravel(), points[:, :, 1].ravel(), np.zeros(n * count), np.arange(n + 1) * count)


def warped(paths: Paths, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(padded points, counts): each path from its origin and of unit length, resampled where it has more points than most; 0 points if it doesn't move."""
    clean = paths.distinct()
    count = np.minimum(clean.sizes, most)
    width = max(int(count.max(initial=0)), 1)
    points = np.zeros((len(count), width, 2))
    few = clean.sizes <= most
    fits = np.repeat(few, clean.sizes)
    at = np.arange(len(clean.x)) - np.repeat(clean.first[:-1], clean.sizes)
    points[clean.owner[fits], at[fits]] = np.stack([clean.x, clean.y], axis=1)[fits]
    if not few.all():
        points[~few] = by_arc(clean.only(~fits), most)[np.diff(clean.only(~fits).first) > 0]
    inside = np.arange(width)[None, :] < count[:, None]
    points = np.where(inside[:, :, None], points - points[:, :1], 0.0)
    step = np.hypot(np.diff(points[:, :, 0], axis=1), np.diff(points[:, :, 1], axis=1))
    length = np.where(inside[:, 1:], step, 0.0).sum(axis=1)
    moves = (length > 1e-12) & (count >= 2)
    return points / np.where(moves, length, 1.0)[:, None, None], np.where(moves, count, 0)


def warping(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 / (1 + mean cost) of the cheapest warping of each pair; of equal predecessors up, left, diagonal is the order.

    Goes by anti-diagonals: all cells of one, of all pairs, at once.
    """
    (p, n), (q, m) = a, b
    high, wide, pairs = p.shape[1], q.shape[1], np.arange(len(n))
    cost = [np.full((len(n), high + 1), np.inf) for _ in range(2)]  # of the last diagonal and the one before, by row
    steps = [np.zeros((len(n), high + 1), np.int64) for _ in range(2)]
    cost[0][:, 0] = 0.0
    total, taken = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for d in range(1, high + wide + 1):
        new, count = np.full_like(cost[0], np.inf), np.zeros_like(steps[0])
        low, top = max(1, d - wide), min(high, d - 1)
        if low <= top:
            i = slice(low, top + 1)
            above = slice(low - 1, top)
            local = np.hypot(*(p[:, above] - q[:, d - top - 1 : d - low][:, ::-1]).transpose(2, 0, 1))
            best, came = cost[0][:, above], steps[0][:, above]
            for c, s in ((cost[0][:, i], steps[0][:, i]), (cost[1][:, above], steps[1][:, above])):
                less = c < best
                best, came = np.where(less, c, best), np.where(less, s, came)
            new[:, i], count[:, i] = best + local, came + 1
        cost, steps = [new, cost[0]], [count, steps[0]]
        done = (n + m == d) & (n > 0) & (m > 0)
        total[done], taken[done] = new[pairs[done], n[done]], count[pairs[done], n[done]]
    return np.where((n > 0) & (m > 0), 1.0 / (1.0 + total / np.maximum(taken, 1)), 0.0)


def _length(points: np.ndarray) -> np.ndarray:
    return np.hypot(points[..., 0], points[..., 1])


def _residuals(source: np.ndarray, current: np.ndarray) -> np.ndarray:
    """Distances after the best scale around the means, as shares of the current path's length."""
    left, right = source - source.mean(axis=1, keepdims=True), current - current.mean(axis=1, keepdims=True)
    square = (left * left).sum(axis=(1, 2))
    scale = np.where(square > 1e-12, (left * right).sum(axis=(1, 2)) / np.where(square > 1e-12, square, 1.0), 0.0)
    along = np.maximum(_length(np.diff(current, axis=1)).sum(axis=1), 1e-9)
    return _length(left * scale[:, None, None] - right) / along[:, None]


def _near(value: np.ndarray, factor: float) -> np.ndarray:
    return 1.0 / (1.0 + factor * value)


def _turns(points: np.ndarray) -> np.ndarray:
    step = np.diff(points, axis=1)
    turn = np.diff(np.arctan2(step[..., 1], step[..., 0]), axis=1)
    return np.arctan2(np.sin(turn), np.cos(turn))


def _rotation(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosine and sine of the rotation that brings centred points nearest, and their products' sum after it."""
    along = (left * right).sum(axis=(1, 2))
    across = (left[..., 0] * right[..., 1] - left[..., 1] * right[..., 0]).sum(axis=1)
    size = np.hypot(along, across)
    safe = np.where(size > 0, size, 1.0)
    return np.where(size > 0, along / safe, 1.0), across / safe, size


def _turned(points: np.ndarray, cosine: np.ndarray, sine: np.ndarray) -> np.ndarray:
    c, s = cosine[:, None], sine[:, None]
    return np.stack([points[..., 0] * c - points[..., 1] * s, points[..., 0] * s + points[..., 1] * c], axis=2)


def fitted(source: np.ndarray, current: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The source after the translation, rotation and scale that fit the used points best."""
    weight = used[:, :, None] / used.sum(axis=1)[:, None, None]
    here, there = (source * weight).sum(axis=1, keepdims=True), (current * weight).sum(axis=1, keepdims=True)
    left, right = np.where(used[:, :, None], source - here, 0.0), np.where(used[:, :, None], current - there, 0.0)
    square = (left * left).sum(axis=(1, 2))
    cosine, sine, size = _rotation(left, right)
    scale = np.where(square > 1e-12, size / np.where(square > 1e-12, square, 1.0), 0.0)
    return _turned(source - here, cosine, sine) * scale[:, None, None] + there


def _extent(points: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    if used is None:
        return _length(points.max(axis=1) - points.min(axis=1))
    keep = used[:, :, None]
    return _length(np.where(keep, points, -np.inf).max(axis=1) - np.where(keep, points, np.inf).min(axis=1))


def _span(*extents: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum.reduce(extents), 1e-9)


def _times(paths: Paths) -> np.ndarray:
    """Shares of the duration at even event numbers; times that go back stand still."""
    t = paths.t - np.repeat(paths.t[np.minimum(paths.first[:-1], max(len(paths.t) - 1, 0))], paths.sizes) if len(paths.t) else paths.t
    t = _latest(t, paths)
    end = np.where(paths.sizes > 0, t[np.maximum(paths.first[1:] - 1, 0)] if len(t) else 0.0, 0.0)
    return np.where((end > 1e-12)[:, None], by_index([t], paths.first, POINTS)[0] / np.where(end > 1e-12, end, 1.0)[:, None], 0.0)


def _latest(t: np.ndarray, paths: Paths) -> np.ndarray:
    """The greatest value so far in each path."""
    out, gap = t.copy(), 1
    at = np.arange(len(t)) - np.repeat(paths.first[:-1], paths.sizes)
    while gap < paths.sizes.max(initial=0):
        out[gap:] = np.where(at[gap:] >= gap, np.maximum(out[gap:], out[:-gap]), out[gap:])
        gap *= 2
    return out


def _speeds(paths: Paths) -> np.ndarray:
    """Logarithms of speed over the path's median speed, at even event numbers."""
    inner = np.ones(len(paths.x), bool)
    inner[paths.first[:-1][paths.sizes > 0]] = False
    gap = np.maximum(np.diff(_latest(paths.t, paths), prepend=0.0), 1e-6)
    speed, owner = (paths.steps() / gap)[inner], paths.owner[inner]
    moving = speed > 0
    order = np.lexsort((speed[moving], owner[moving]))
    ranked, n = speed[moving][order], np.bincount(owner[moving], minlength=len(paths.sizes))
    start = np.concatenate([[0], np.cumsum(n)])[:-1]
    pick = lambda k: ranked[np.minimum(start + k, max(len(ranked) - 1, 0))] if len(ranked) else np.ones(len(n))
    middle = np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, 1.0)
    first = np.concatenate([[0], np.cumsum(np.maximum(paths.sizes - 1, 0))])
    return by_index([np.log1p(speed / np.maximum(middle, 1e-12)[owner])], first, POINTS)[0]


def _correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    left, right = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    spread = [np.sqrt((v * v).mean(axis=1)) for v in (left, right)]
    flat = (spread[0] <= 1e-12) | (spread[1] <= 1e-12)
    r = (left * right).mean(axis=1) / np.where(flat, 1.0, spread[0] * spread[1])
    return np.where(flat, _near(np.abs(a - b).mean(axis=1), 1.0), (np.clip(r, -1.0, 1.0) + 1) / 2)


def signals(current: Paths, source: Paths) -> np.ndarray:
    """(pairs, 15) in the order of SIGNALS."""
    here, there = by_arc(current, POINTS), by_arc(source, POINTS)
    out = [warping(warped(current, POINTS), warped(source, POINTS))]
    plain = [np.stack(by_index([p.x, p.y], p.first, POINTS), axis=2) for p in (source, current)]
    rest = _residuals(*plain)
    out += [_near(np.median(rest, axis=1), 100.0), _near(np.percentile(rest, 90, axis=1), 100.0)]

    a, b = np.diff(there, axis=1), np.diff(here, axis=1)
    size = _length(a) * _length(b)
    both = size > 1e-12
    cosine = np.clip((a * b).sum(axis=2) / np.where(both, size, 1.0), -1.0, 1.0)
    out.append(np.where(both, (cosine + 1) / 2, 0.0).sum(axis=1) / np.maximum(both.sum(axis=1), 1))
    turns = [_turns(p) for p in (there, here)]
    out.append(((np.cos(turns[0] - turns[1]) + 1) / 2).mean(axis=1))
    out.append(_near(np.abs(_times(source) - _times(current)).mean(axis=1), 20.0))
    out.append(_correlation(_speeds(source), _speeds(current)))
    out.append(np.mean([_near(np.median(_residuals(by_arc(source, k), by_arc(current, k)), axis=1), 100.0) for k in SCALES], axis=0))
    n, m = current.sizes, source.sizes
    out.append(np.minimum(n, m) / np.maximum(np.maximum(n, m), 1))

    left, right = (p - p.mean(axis=1, keepdims=True) for p in (there, here))
    norms = [np.sqrt((p * p).sum(axis=(1, 2))) for p in (left, right)]
    solid = (norms[0] > 1e-12) & (norms[1] > 1e-12)
    left, right = (p / np.where(solid, k, 1.0)[:, None, None] for p, k in zip((left, right), norms, strict=True))
    rest = _length(_turned(left, *_rotation(left, right)[:2]) - right).mean(axis=1)
    out.append(np.where(solid, _near(rest, 12.0), 0.0))

    bends = [by_index([np.abs(t).ravel()], np.arange(len(t) + 1) * t.shape[1], POINTS)[0] for t in turns]
    scale = np.maximum(bends[0].mean(axis=1) + bends[1].mean(axis=1), 1e-6)
    out.append(_near(np.abs(bends[0] - bends[1]).mean(axis=1) / scale, 3.0))
    upper = np.triu_indices(CHORD_POINTS, k=1)
    chords = []
    for p in (there, here):
        q = by_arc(_even(p), CHORD_POINTS)
        chord = _length(q[:, :, None] - q[:, None, :])[:, upper[0], upper[1]]
        chords.append(chord / np.maximum(chord.max(axis=1), 1e-9)[:, None])
    out.append(_near(np.abs(chords[0] - chords[1]).mean(axis=1), 10.0))

    keep, used = int(np.ceil(POINTS * KEPT)), np.ones(here.shape[:2], bool)
    for _ in range(3):
        aligned = fitted(there, here, used)
        rest = _length(aligned - here)
        order = np.argsort(rest, axis=1, kind="stable")
        used = np.zeros_like(used)
        np.put_along_axis(used, order[:, :keep], True, axis=1)
    core = np.median(np.take_along_axis(rest, order[:, :keep], axis=1), axis=1)
    out.append(_near(core / _span(_extent(here), _extent(there)), 32.0))
    far = _length(aligned[:, :, None] - here[:, None, :])
    near = np.sort(np.concatenate([far.min(axis=1), far.min(axis=2)], axis=1), axis=1)
    out.append(_near(near[:, : int(np.ceil(2 * POINTS * NEAREST))].mean(axis=1) / _span(_extent(here), _extent(aligned)), 32.0))

    free = ((here > MARGIN) & (here < 1 - MARGIN)).all(axis=2)
    free |= (free.sum(axis=1) < 4)[:, None]
    rest = np.where(free, _length(fitted(there, here, free) - here), np.nan)
    out.append(_near(np.nanmedian(rest, axis=1) / _span(_extent(here, free), _extent(there, free)), 24.0))

    made = np.stack(out, axis=1)
    made[(n < 2) | (m < 2)] = 0.0
    return np.clip(np.nan_to_num(made, nan=0.0, posinf=0.0, neginf=0.0), 0.0, 1.0)


def paths(trace: DataFrame, key: list[str], order: str = "seq", x: str = "x", y: str = "y", t: str = "t") -> DataFrame:
    """(key, path): each key's points in order, as one struct of arrays; a key has few of them."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(t).cast("double").alias("t"))))
    held = trace.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(t).isNotNull()).groupBy(*key).agg(rows.alias("p"))
    return held.select(*key, F.struct(*[F.col("p")[c].alias(f"{c}s") for c in ("x", "y", "t")]).alias("path"))


def earlier(held: DataFrame, group: str, order: list[str], ident: str, newest: int) -> DataFrame:
    """(ident, source, current, path): each path with up to so many before it in its group."""
    past = Window.partitionBy(group).orderBy(*order).rowsBetween(-newest, -1)
    rows = held.withColumn("past", F.collect_list(F.struct(F.col(ident).alias("source"), "path")).over(past))
    return rows.select(ident, F.col("path").alias("current"), F.explode("past").alias("s")).select(ident, "s.source", "current", "s.path")


def _mapped(pairs: DataFrame, names: tuple[str, ...], compare) -> DataFrame:
    """The pairs' columns but current and path, and one column for each name."""
    keep = [c for c in pairs.columns if c not in ("current", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(i, TOGETHER)
                made = compare(*(Paths.of(pa.concat_arrays([batch.column(c)])) for c in ("current", "path")))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(made[:, k]) for k in range(len(names))]], names=[*keep, *names])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in keep] + [f"{n} double" for n in names])
    return pairs.mapInArrow(run, fields)


def compared(pairs: DataFrame) -> DataFrame:
    """The pairs (current, path) with the fifteen signals instead of their paths."""
    return _mapped(pairs, SIGNALS, signals)


def dtw(pairs: DataFrame, most: int = WARPED) -> DataFrame:
    """The pairs (current, path) with their similarity by dynamic time warping."""
    return _mapped(pairs, ("similarity",), lambda a, b: warping(warped(a, most), warped(b, most))[:, None])
