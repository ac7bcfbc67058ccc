import numpy as np
import pyarrow as pa
import pytest

from strokewise.operators import pair_signals as ps


def even(path, count):
    gone = np.hypot(*np.diff(path, axis=0).T)
    at = np.append(0, np.cumsum(gone))
    if at[-1] <= 1e-12:
        return np.tile(path[0], (count, 1))
    keep = np.append(True, gone > 1e-12)
    place = np.linspace(0, at[-1], count)
    return np.stack([np.interp(place, at[keep], path[keep, k]) for k in (0, 1)], axis=1)


def by_number(values, count):
    if len(values) < 2:
        return np.zeros(count)
    return np.interp(np.linspace(0, len(values) - 1, count), np.arange(len(values)), values)


def slow_dtw(a, b, most):
    def ready(p):
        p = p[np.append(True, (np.diff(p, axis=0) != 0).any(axis=1))]
        if len(p) > most:
            p = even(p, most)
        size = np.hypot(*np.diff(p, axis=0).T).sum()
        return (p - p[0]) / size if size > 1e-12 else None

    a, b = ready(a), ready(b)
    if a is None or b is None:
        return 0.0
    cell = {(0, 0): (0.0, 0)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            options = [cell.get(c, (np.inf, 0)) for c in ((i - 1, j), (i, j - 1), (i - 1, j - 1))]
            cost, n = min(options, key=lambda o: o[0])
            cell[i, j] = cost + np.hypot(*(a[i - 1] - b[j - 1])), n + 1
    cost, n = cell[len(a), len(b)]
    return 1 / (1 + cost / n)


def rigid(m):
    u, _, v = np.linalg.svd(m)
    if np.linalg.det(u @ v) < 0:
        u[:, 1] = -u[:, 1]
    return u @ v


def moved(s, c, use):
    p, q = s[use] - s[use].mean(0), c[use] - c[use].mean(0)
    r = rigid(p.T @ q)
    return (s - s[use].mean(0)) @ r * ((p @ r) * q).sum() / (p * p).sum() + c[use].mean(0)


def slow(cur, src):
    """One pair, (points, times) each, in plain loops and matrix algebra."""
    (a, ta), (b, tb) = src, cur
    A, B = even(a, 48), even(b, 48)
    norm = lambda d: np.sqrt((d * d).sum(-1))
    out = [slow_dtw(b, a, 48)]

    def scaled(p, q):
        pc, qc = p - p.mean(0), q - q.mean(0)
        k = (pc * qc).sum() / (pc * pc).sum() if (pc * pc).sum() > 1e-12 else 0
        return norm(pc * k + q.mean(0) - q) / max(norm(np.diff(q, axis=0)).sum(), 1e-9)

    plain = [np.stack([by_number(p[:, k], 48) for k in (0, 1)], axis=1) for p in (a, b)]
    rest = scaled(*plain)
    out += [1 / (1 + 100 * np.median(rest)), 1 / (1 + 100 * np.quantile(rest, 0.9))]
    cosines = [u @ v / (norm(u) * norm(v)) for u, v in zip(np.diff(A, axis=0), np.diff(B, axis=0), strict=True) if norm(u) * norm(v) > 1e-12]
    out.append(np.mean([(min(1, max(-1, c)) + 1) / 2 for c in cosines]) if cosines else 0)

    def bends(p):
        h = np.arctan2(*np.diff(p, axis=0).T[::-1])
        return np.angle(np.exp(1j * np.diff(h)))

    out.append(np.mean([(np.cos(x - y) + 1) / 2 for x, y in zip(bends(A), bends(B), strict=True)]))

    def clock(t):
        r = np.maximum.accumulate(t - t[0])
        return by_number(r / r[-1], 48) if r[-1] > 1e-12 else np.zeros(48)

    out.append(1 / (1 + 20 * np.mean(np.abs(clock(ta) - clock(tb)))))

    def pace(p, t):
        v = norm(np.diff(p, axis=0)) / np.maximum(np.diff(np.maximum.accumulate(t)), 1e-6)
        return by_number(np.log1p(v / max(np.median(v[v > 0]) if (v > 0).any() else 1.0, 1e-12)), 48)

    u, v = pace(a, ta), pace(b, tb)
    out.append((np.corrcoef(u, v)[0, 1] + 1) / 2 if u.std() > 1e-12 and v.std() > 1e-12 else 1 / (1 + np.mean(np.abs(u - v))))
    out.append(np.mean([1 / (1 + 100 * np.median(scaled(even(a, k), even(b, k)))) for k in (16, 32, 64)]))
    out.append(min(len(a), len(b)) / max(len(a), len(b)))
    p, q = A - A.mean(0), B - B.mean(0)
    if np.linalg.norm(p) > 1e-12 and np.linalg.norm(q) > 1e-12:
        p, q = p / np.linalg.norm(p), q / np.linalg.norm(q)
        out.append(1 / (1 + 12 * norm(p @ rigid(p.T @ q) - q).mean()))
    else:
        out.append(0)
    x, y = by_number(abs(bends(A)), 48), by_number(abs(bends(B)), 48)
    out.append(1 / (1 + 3 * np.mean(abs(x - y)) / max(x.mean() + y.mean(), 1e-6)))
    chords = []
    for p in (even(A, 24), even(B, 24)):
        d = np.array([norm(p[i] - p[j]) for i in range(24) for j in range(i + 1, 24)])
        chords.append(d / max(d.max(), 1e-9))
    out.append(1 / (1 + 10 * np.mean(abs(chords[0] - chords[1]))))
    use = np.arange(48)
    for _ in range(3):
        fit = moved(A, B, use)
        rest = norm(fit - B)
        use = np.argsort(rest, kind="stable")[:35]
    wide = lambda p: norm(p.max(0) - p.min(0))
    out.append(1 / (1 + 32 * np.median(rest[use]) / max(wide(A), wide(B), 1e-9)))
    far = norm(fit[:, None] - B[None])
    near = np.sort(np.append(far.min(0), far.min(1)))[:77]
    out.append(1 / (1 + 32 * near.mean() / max(wide(fit), wide(B), 1e-9)))
    free = ((B > 0.003) & (B < 0.997)).all(1)
    free = free if free.sum() >= 4 else np.ones(48, bool)
    out.append(1 / (1 + 24 * np.median(norm(moved(A, B, free) - B)[free]) / max(wide(A[free]), wide(B[free]), 1e-9)))
    return out


def arrays(paths):
    return ps.Paths.of(pa.array([{"xs": p[:, 0].tolist(), "ys": p[:, 1].tolist(), "ts": t.tolist()} for p, t in paths], pa.struct([(c, pa.list_(pa.float64())) for c in ("xs", "ys", "ts")])))


def walk(rng, n):
    p = np.cumsum(rng.normal(size=(n, 2)), axis=0) * 0.05 + 0.5
    p[rng.random(n) < 0.1] = p[0]
    return np.clip(p, 0, 1), np.cumsum(rng.integers(-2, 40, n)).astype(float)


def test_same_as_slow():
    rng = np.random.default_rng(4)
    some = [walk(rng, int(n)) for n in rng.choice([2, 3, 5, 16, 47, 48, 49, 100, 130], 60)]
    other = [walk(rng, int(n)) for n in rng.choice([2, 4, 17, 48, 60, 97], 50)] + [(p[::-1] @ np.array([[0.6, 0.8], [-0.8, 0.6]]) * 0.5 + 0.4, t) for p, t in some[50:]]
    got = ps.signals(arrays(some), arrays(other))
    want = np.array([slow(a, b) for a, b in zip(some, other, strict=True)])
    worst = np.abs(got - want).max(axis=0)
    assert dict(zip(ps.SIGNALS, worst < 1e-6, strict=True)) == dict.fromkeys(ps.SIGNALS, True), worst
    assert ((got >= 0) & (got <= 1)).all()


@pytest.mark.parametrize("most", [48, 96])
def test_warping_of_long_paths(most):
    rng = np.random.default_rng(most)
    some, other = ([walk(rng, int(n)) for n in rng.choice([2, 30, 95, 96, 97, 150], 20)] for _ in (0, 1))
    got = ps.warping(ps.warped(arrays(some), most), ps.warped(arrays(other), most))
    assert np.allclose(got, [slow_dtw(a[0], b[0], most) for a, b in zip(some, other, strict=True)], atol=1e-9)


def test_degenerate_paths():
    still, none, one = (np.full((5, 2), 0.3), np.arange(5.0)), (np.zeros((0, 2)), np.zeros(0)), (np.zeros((1, 2)), np.zeros(1))
    odd = (np.array([[0, 0], [np.nan, 1], [1, np.inf]]), np.arange(3.0))  # one point is left
    line = (np.stack([np.arange(9) / 9, np.zeros(9)], axis=1), np.arange(9.0))
    got = ps.signals(arrays([none, one, odd, line, line]), arrays([line, line, line, none, odd]))
    assert (got == 0).all()
    same = ps.signals(arrays([line]), arrays([line]))
    assert np.allclose(same, 1, atol=1e-6)
    assert np.isfinite(ps.signals(arrays([still, line, still]), arrays([line, still, still]))).all()


def test_pairs_in_spark(spark):
    rng = np.random.default_rng(1)
    made = {f"{u}-{a}": walk(rng, 12) for u in range(3) for a in range(5)}
    rows = [(int(k[0]), int(k[2]), k, i, float(p[i, 0]), float(p[i, 1]), int(t[i])) for k, (p, t) in made.items() for i in range(12)]
    trace = spark.createDataFrame(rows, "user_id int, ano int, attempt_id string, seq int, x double, y double, t long").repartition(4)
    pairs = ps.earlier(ps.paths(trace, ["user_id", "ano", "attempt_id"]), "user_id", ["ano"], "attempt_id", 2)
    got = {(r["attempt_id"], r["source"]): [r[s] for s in ps.SIGNALS] for r in ps.compared(pairs).collect()}
    assert set(got) == {(f"{u}-{a}", f"{u}-{a - d}") for u in range(3) for a in range(5) for d in (1, 2) if a >= d}
    for (a, b), values in got.items():
        assert np.allclose(values, slow(made[a], made[b]), atol=1e-6)
    assert ps.compared(pairs.limit(0)).count() == 0
