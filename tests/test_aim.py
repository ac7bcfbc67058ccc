"""Aim features against numpy, burst by burst."""

import numpy as np

from strokewise.operators import aim


def slow(xy, t):
    step = np.hypot(*np.diff(xy, axis=0).T)
    gap = np.diff(t)
    v = step / (np.maximum(gap, 1e-6) / 1000)
    n, top = len(v), v.max() or 1e-9
    left = np.hypot(*(xy - xy[-1]).T)
    rest = left / (left[0] + 1e-9)
    turn = np.diff(np.unwrap(np.arctan2(*np.diff(xy, axis=0).T[::-1])))
    acc = np.diff(v) / np.maximum(gap[1:] / 1000, 1e-6)
    crests = 0
    for i in range(1, n - 1):
        if v[i] >= v[i - 1] and v[i] > v[i + 1] and v[i] > 0.25 * v.max() and v[i] - v[max(0, i - 3) : i].min() > 0.15 * v.max():
            crests += 1
    cv = lambda a: a.std() / (a.mean() + 1e-9)
    out = {
        "duration_ms": t[-1] - t[0], "point_count": len(xy), "path_length": step.sum(), "straight_distance": left[0], "peak_speed": top, "mean_speed": v.mean(),
        "peak_at": v.argmax() / max(n - 1, 1), "slow_fraction": (v < 0.2 * top).mean(), "fast_fraction": (v > 0.6 * top).mean(), "half_distance_at": int(np.flatnonzero(rest <= 0.5)[0]) / n,
        "final_speed_ratio": v[-1] / top, "first_speed_ratio": v[0] / top, "decel_ratio": v[3 * n // 4 :].mean() / (v[: max(n // 4, 1)].mean() + 1e-9), "straightness": left[0] / step.sum() if step.sum() > 1e-9 else 0,
        "speed_cv": cv(v), "step_len_cv": cv(step), "submovement_count": crests, "turn_abs_mean": abs(turn).mean(), "turn_signed_mean": turn.mean(), "turn_cv": cv(abs(turn)), "accel_std": acc.std(),
        "accel_sign_flips": (np.diff(np.sign(acc)) != 0).mean() if len(acc) > 1 else 0, "overshoot": left[np.flatnonzero(rest <= 0.15)[0] :].max() / (left[0] + 1e-9),
        "interval_median_ms": np.median(gap), "interval_cv": cv(gap), "interval_at_floor": (gap <= 45).mean(),
    }
    return {k: v if np.isfinite(v) else 0.0 for k, v in out.items()}


def test_burst_features(spark):
    rng = np.random.default_rng(3)
    bursts = {}
    for b in range(40):
        n = int(rng.integers(2, 30))
        f = np.sort(rng.random(n)) if b % 2 else np.linspace(0, 1, n)
        xy = np.stack([f**2, np.sin(f * rng.integers(1, 9))], axis=1) + rng.normal(size=(n, 2)) * 0.01
        bursts[b] = (xy, np.cumsum(rng.integers(5, 90, n)).astype(float))
    bursts[90] = (np.zeros((6, 2)) + 0.5, np.arange(6.0) * 40)
    bursts[91] = (np.stack([np.arange(5.0), np.zeros(5)], axis=1), np.full(5, 3.0))
    rows = [(b, i, float(p[0]), float(p[1]), float(t)) for b, (xy, ts) in bursts.items() for i, (p, t) in enumerate(zip(xy, ts, strict=True))]
    got = {r.b: r.asDict() for r in aim.burst_features(spark.createDataFrame(rows, "b int, seq int, x double, y double, t double").repartition(3), ["b"]).collect()}
    assert set(got) == {b for b, (xy, _) in bursts.items() if len(xy) >= 3}
    for b, r in got.items():
        want = slow(*bursts[b])
        for k in aim.FEATURES:
            assert abs(r[k] - want[k]) <= 1e-6 * max(1, abs(want[k])), (b, k, r[k], want[k])


def test_clock_features(spark):
    rows = [("even", i, i * 16, float(i), 0.0) for i in range(9)] + [("one", 0, 0, 0.0, 0.0)] + [("mixed", i, t, float(i * i % 5), 1.0) for i, t in enumerate([0, 10, 30, 40, 65, 66])]
    got = {r.attempt_id: r for r in aim.clock_features(spark.createDataFrame(rows, "attempt_id string, seq int, t long, x double, y double")).collect()}
    assert tuple(got["even"])[1:] == (1 / 8, 0.0, 0.0, 1.0, 0.0, 1 - 1 / 8) and tuple(got["one"])[1:] == (0.0,) * 6
    gaps = np.array([10, 20, 10, 25, 1])
    p = np.array([2, 1, 1, 1]) / 5
    x = np.array([i * i % 5 for i in range(6)])
    v = abs(np.diff(x)) / np.diff([0, 10, 30, 40, 65, 66])
    want = (4 / 5, -(p * np.log(p)).sum() / np.log(4), gaps.std() / gaps.mean(), 2 / 5, np.corrcoef(v[:-1], v[1:])[0, 1], 1 - len(set(np.diff(x))) / 5)
    assert np.allclose(tuple(got["mixed"])[1:], want)
