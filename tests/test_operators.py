"""What SQL can't say shortly: compared with plain Python and numpy."""

import math
import tracemalloc
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from strokewise.functions.rounding import rounded
from strokewise.operators import evaluate, learning, quality, replay, risk, segments
from strokewise.plans import records


def test_recommendations(spark):
    weak = spark.createDataFrame([(1, "a", 1, "easy"), (1, "b", 2, "hard"), (2, "a", 1, "medium")], "student long, concept string, rank long, target_band string")
    bank = [(10, "a", 0.9), (11, "a", 0.8), (12, "a", 0.1), (13, "a", 0.5), (20, "b", 0.95), (21, "b", 0.75), (22, "b", 0.2), (23, "b", 0.6)]
    solved = spark.createDataFrame([(1, 12), (2, 99)], "student long, question long")
    made = learning.recommended(weak, spark.createDataFrame(bank, "question long, concept string, difficulty double"), solved).orderBy("student", "place").collect()
    preference = {"easy": ["easy", "medium", "hard"], "medium": ["medium", "easy", "hard"], "hard": ["hard", "medium", "easy"]}
    level = lambda d: "easy" if d < 0.4 else "medium" if d < 0.7 else "hard"
    for student, concepts, done in ((1, [("a", "easy"), ("b", "hard")], {12}), (2, [("a", "medium")], set())):
        out, hard = [], False
        for concept, target in concepts:
            for q, _, d in sorted((x for x in bank if x[1] == concept and x[0] not in done), key=lambda x: (preference[target].index(level(x[2])), x[0])):
                if len(out) == 4 or level(d) == "hard" and hard:
                    continue
                out.append(q)
                hard = level(d) == "hard"
        assert [r.question for r in made if r.student == student] == out


def test_recommendations_never_join_students_to_the_bank(spark):
    """Runs of solved questions, repeated rows and exhausted bands; unsolved ones come from gaps between numbers."""
    rng = np.random.default_rng(5)
    bank = [(q, "ab"[q % 2], (q % 7 + 1) / 8) for q in range(400)]
    weak = [(s, c, r + 1, ("easy", "medium", "hard")[(s + r) % 3]) for s in range(12) for r, c in enumerate("ab"[:: 1 if s % 2 else -1])]
    solved = [(s, int(q)) for s in range(12) for q in rng.choice(400, 40 * s % 401)] + [(s, q) for s in (3, 4) for q in range(390)]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = learning.recommended(of(weak, "student long, concept string, rank long, target_band string"), of(bank, "question long, concept string, difficulty double"), of(solved, "student long, question long"))
    made = out.orderBy("student", "place").collect()
    level = lambda d: "easy" if d < 0.4 else "medium" if d < 0.7 else "hard"
    for s in range(12):
        want, hard = [], False
        for _, concept, _, target in sorted((x for x in weak if x[0] == s), key=lambda x: x[2]):
            for q, _, d in sorted((x for x in bank if x[1] == concept and (s, x[0]) not in set(solved)), key=lambda x: (learning.PREFERENCE[target].index(level(x[2])), x[0])):
                if len(want) < 4 and not (level(d) == "hard" and hard):
                    want.append(q)
                    hard = level(d) == "hard"
        assert [r.question for r in made if r.student == s] == want
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()  # students times bank, less the solved


def test_ties_are_rounded_as_in_sql(spark):
    """0.2590625 is stored a little lower and its text is a tie; integers that are far from ties, signs and null stay."""
    values = [0.2590625, 0.34374999999999994, -0.2590625, 1e12 + 0.5, 0.1 + 0.2, 2.0, None, float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    made = [r.r for r in rows.select("i", rounded(replay.F.col("v")).alias("r")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert made[:7] == want[:7] and made[0] == 0.259062 and math.isnan(made[7])


def test_mastery_is_the_same_in_any_order_of_rows(spark):
    """Eleven answers whose chances add up to another last bit in another order; and a mastery just below a tie, rounded as in SQL."""
    options = [4, 3, 3, 2, 4, 3, 3, 3, 3, 4, 3]
    answers = lambda order, parts: spark.createDataFrame([(1, "a", options[i], i < 7) for i in order], "student long, concept string, options long, correct boolean").repartition(parts)
    made = {learning.mastery(answers(order, parts)).first()["guess"] for parts in (1, 2, 5) for order in (range(11), range(10, -1, -1), sorted(range(11), key=options.__getitem__))}
    assert made == {math.fsum(1 / o for o in options) / 11}
    rows = [(1, "a", 0, i < 2, "2000-01-01", 0.1, i) for i in range(124)]  # 4 / 128 = 0.03125
    near = spark.createDataFrame(rows, "student long, concept string, options long, correct boolean, answered_at string, difficulty double, i int").withColumn("answered_at", replay.F.to_date("answered_at"))
    weak = learning.weak_concepts(near, replay.F.lit("2000-01-02").cast("date"), ["i"]).first()
    assert weak["mastery"] == 0.0313


def path_of(rows):
    p = [rows[0]]
    for x in rows[1:]:
        if math.dist(x, p[-1]) > 1e-12:
            p.append(x)
    a = np.array(p, float)
    arc = np.append(0, np.cumsum(np.hypot(*np.diff(a, axis=0).T)))
    at = np.linspace(0, arc[-1], 32)
    return np.stack([np.interp(at, arc, a[:, 0]), np.interp(at, arc, a[:, 1])], axis=1)


def test_resampled_paths_and_their_similarity(spark):
    rng = np.random.default_rng(3)
    paths = [np.cumsum(rng.normal(size=(n, 2)), axis=0) for n in (5, 12, 40)]
    turn = np.array([[0, -1], [1, 0]])
    paths += [paths[1] @ turn * 3 + 7, np.repeat(paths[2], 2, axis=0), np.zeros((4, 2))]
    rows = [(1, i, f"p{i}", s, float(x), float(y)) for i, p in enumerate(paths) for s, (x, y) in enumerate(p)]
    trace = spark.createDataFrame(rows, "user_id long, ano long, attempt_id string, seq long, x double, y double")
    made = {r.attempt_id: r for r in replay.resampled(trace).collect()}
    assert "p5" not in made
    for i, p in enumerate(paths[:5]):
        assert np.allclose(np.stack([made[f"p{i}"].xs, made[f"p{i}"].ys], axis=1), path_of(p.tolist()), atol=1e-9)
    got = {r.attempt_id: r for r in replay.similarity(replay.resampled(trace), 5).collect()}

    def one(a, b):
        a, b = ((q - q.mean(0)) / np.linalg.norm(q - q.mean(0)) for q in (a, b))
        return 1 / (1 + 4 * math.sqrt(max(0, 2 - 2 * np.linalg.svd(a.T @ b)[1].sum())))

    for i in range(5):
        want = max((one(path_of(paths[i].tolist()), path_of(paths[j].tolist())) for j in range(i)), default=0.0)
        assert abs(got[f"p{i}"].max_similarity - want) < 1e-6 and got[f"p{i}"].compared == i
    assert got["p3"].max_similarity > 0.999 and got["p4"].max_similarity > 0.999


def test_every_quality_rule_fires(spark):
    good = [(s, s * 10, 10.0 * s, 20.0 + s, "pointerdown" if s == 0 else "pointerup" if s == 4 else "pointermove", 0.1, 0, 100) for s in range(5)]
    fields = ("seq", "t", "x", "y", "pointer_type", "x_normalized", "presented", "submitted")
    swap = lambda i, **kw: [tuple({**dict(zip(fields, e)), **(kw if i in (j, None) else {})}.values()) for j, e in enumerate(good)]
    cases = {
        "": good,
        "event_count_lt_2": good[:1],
        "seq_not_sequential": swap(2, seq=9),
        "t_ms_decreasing": swap(2, t=1),
        "missing_pointerdown": swap(0, pointer_type="pointermove"),
        "missing_pointerup_or_cancel": swap(4, pointer_type="pointermove"),
        "non_finite_value": swap(2, x=float("nan")),
        "coordinates_out_of_bounds": swap(2, x=5_000.0),
        "normalized_out_of_range": swap(2, x_normalized=-1.0),
        "duration_not_positive": swap(None, t=0),
        "duplicate_timestamps": swap(2, t=10),
        "duplicate_events": [*good[:2], (2, 10, 10.0, 21.0, "pointermove", 0.1, 0, 100), *good[3:]],
        "too_few_distinct_coordinates": swap(None, x=1.0, y=1.0),
        "missing_server_timing": swap(None, presented=None),
        "submitted_before_presented": swap(None, submitted=-1),
        "event_timestamps_outside_server_window": swap(None, presented=9_000, submitted=9_500),
        "non_finite_value;": swap(3, x_normalized=float("inf")),
    }
    rows = [(f"c{i}", *e) for i, c in enumerate(cases.values()) for e in c]
    table = spark.createDataFrame(rows, "attempt_id string, seq long, t long, x double, y double, pointer_type string, x_normalized double, presented long, submitted long")
    made = {r.attempt_id: r for r in quality.gate(table, 500, 200, "presented", "submitted", True).collect()}
    for i, name in enumerate(cases):
        got = made[f"c{i}"]
        assert (name.strip(";") in got.reasons.split(";")) if name else got.status == "valid", (name, got.reasons)
        assert got.status == ("valid" if not name else "pending" if name in quality.SOFT else "rejected")
    assert made["c0"].checks == {"event_count": "5", "seq_ok": "true", "t_ms_non_decreasing": "true", "out_of_bounds_count": "0", "normalized_out_of_range_count": "0", "duration_ms": "40", "duplicate_timestamp_count": "0", "duplicate_event_count": "0", "distinct_coordinates": "5", "server_duration_ms": "100", "event_first_t_ms": "0", "event_last_t_ms": "40", "event_timestamps_within_server_window": "true"}
    assert made["c1"].checks == {"event_count": "1"}


def test_nulls_do_not_pass_the_gate(spark):
    rows = [("k", 0, 0, 1.0, 1.0, None), ("k", 1, 5, 2.0, 2.0, None), ("t", 0, 0, 1.0, 1.0, "pointerdown"), ("t", 1, None, 2.0, 2.0, "pointerup")]
    made = {r.attempt_id: r.reasons for r in quality.gate(spark.createDataFrame(rows, "attempt_id string, seq long, t long, x double, y double, pointer_type string")).collect()}
    assert made == {"k": "missing_pointerdown;missing_pointerup_or_cancel", "t": "t_ms_decreasing;duration_not_positive"}


def test_risk_decisions(spark):
    policy = risk.Policy(human_threshold=0.4, step_up_threshold=0.6, similarity_threshold=0.9, most_per_minute=20.0)
    cases = [
        ((0.9, False, 0.0, 1.0, False), (5.0, "low", "allow", "")),
        ((0.5, False, 0.0, 1.0, False), (40.0, "medium", "step_up", "ml_step_up_band")),
        ((0.3, False, 0.0, 1.0, False), (40.0, "medium", "step_up", "ml_bot_score")),
        ((0.9, True, 0.0, 1.0, False), (80.0, "high", "step_up_and_rate_limit", "exact_trace_fingerprint")),
        ((0.9, False, 0.95, 1.0, False), (40.0, "medium", "step_up", "dtw_similar_trace")),
        ((0.9, False, 0.95, 25.0, False), (70.0, "high", "step_up_and_rate_limit", "dtw_similar_trace;session_rate_exceeded")),
        ((0.9, False, None, None, True), (40.0, "medium", "step_up", "invalid_event_telemetry")),
        ((0.1, True, 0.95, 25.0, True), (100.0, "high", "step_up_and_rate_limit", "ml_bot_score;exact_trace_fingerprint;dtw_similar_trace;session_rate_exceeded;invalid_event_telemetry")),
    ]
    rows = [(i, *given) for i, (given, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, "i int, human_score double, exact_replay_detected boolean, similarity double, attempts_per_minute double, quality_rejected boolean")
    made = {r.i: (r.risk_score, r.risk_level, r.action, r.reasons) for r in risk.fuse(table, policy).collect()}
    assert [made[i] for i in range(len(cases))] == [want for _, want in cases]
    off = risk.fuse(table, replace(policy, exact_replay_enabled=False)).where("i = 3").first()
    assert off.reasons == "" and off.action == "allow"
    for bad in (1.5, -0.1, float("nan"), None):
        with pytest.raises(Exception, match="between 0 and 1"):
            risk.fuse(spark.createDataFrame([(bad, False, 0.0, 0.0, False)], table.schema.simpleString()[7:-1].replace("i:int,", "")), policy).collect()
    with pytest.raises(ValueError):
        risk.Policy(human_threshold=0.5, step_up_threshold=0.4)


KINDS = {
    "synonyms": ("pointer_down drag_start pointer_move pointer_move pointer_move pointer_move drop", [4]),
    "three": ("pointerdown pointermove pointermove pointermove pointerup pointermove pointerdown pointermove pointermove pointermove pointermove pointerup pointerdown pointermove pointermove pointerup", [3, 4, 2]),
    "hover": ("pointermove pointermove", []),
    "lost release": ("pointerdown pointermove pointermove pointerdown pointermove pointerup", [2, 1]),
    "cancel is no release": ("pointerdown pointermove pointercancel pointermove aimmove pointerup pointermove", [2]),
    "never released": ("pointerdown pointermove", [1]),
    "press alone": ("pointerdown", []),
}


def test_drags(spark):
    rows = [(name, 0, i, k) for name, (kinds, _) in KINDS.items() for i, k in enumerate(kinds.split())]
    made = {}
    for r in segments.drags(spark.createDataFrame(rows, "user_id string, ano int, seq int, kind string")).orderBy("user_id", "drag").collect():
        made.setdefault(r.user_id, []).append(r.n_moves)
    assert {n: made.get(n, []) for n in KINDS} == {n: want for n, (_, want) in KINDS.items()}


def test_session_scores_of_drags(spark):
    rows = [("a", 1, 0.1), ("a", 5, 0.9), ("a", 4, 0.7), ("b", 1, 0.99), ("b", 0, 0.99), ("c", 2, 0.2)]
    made = {r.s: (r.drag_count, r.starved_drags, r.human_score, r.prediction, r.reason) for r in segments.session_scores(spark.createDataFrame(rows, "s string, n_moves int, score double"), "s").collect()}
    assert made == {"a": (3, 1, 0.8, "human", None), "b": (2, 2, 0.0, "bot", "every_drag_below_move_floor"), "c": (1, 0, 0.2, "bot", None)}


def test_aims_joined_to_drags(spark):
    aim = [("aim_move", float(i), 0.0) for i in range(20)]
    drag = [("pointer_down", 19.0, 0.0), *[("pointer_move", 19.0 + i, float(i)) for i in range(16)]]  # its first point is the aim's last
    events = [("pointer_move", 0.0, 0.0), *aim, *drag, ("drop", None, None), *aim[:3], ("pointer_down", 0.0, 0.0), ("pointer_down", 0.0, 0.0), ("pointer_move", 5.0, 5.0), ("aim_move", 1.0, 1.0)]
    table = spark.createDataFrame([(1, 0, i, *e) for i, e in enumerate(events)], "user_id int, ano int, seq int, kind string, x double, y double")
    made = [(r.n_aim, r.n_drag, r.n_points, r.judgeable) for r in segments.joined_paths(segments.runs(table)).orderBy("run").collect()]
    assert made == [(20, 15, 35, True), (0, 1, 1, False)]


def test_fingerprints(spark):
    base = [(0.0, 0.0), (1.5, 2.0), (3.25, 1.0)]
    paths = {"a": base, "moved": [(x + 7, y - 3) for x, y in base], "close": [(x + 1e-9, y) for x, y in base], "apart": [(x * 1.00001, y) for x, y in base], "more": [*base, base[-1]], "one": base[:1], "odd": [base[0], (float("nan"), 1.0), *base[1:]], "none": [(float("inf"), 0.0)]}
    rows = [(1, i, n, s, s * 10, s, x, y) for i, (n, p) in enumerate(paths.items()) for s, (x, y) in enumerate(p)]
    made = {r.attempt_id: r.fingerprint for r in replay.fingerprints(spark.createDataFrame(rows, "user_id int, ano int, attempt_id string, seq int, t long, at_us long, x double, y double")).collect()}
    assert made["a"] == made["moved"] == made["close"] == made["odd"]
    assert len({made["a"], made["apart"], made["more"]}) == 3 and made["one"] is None and made["none"] is None


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(replay, "BLOCK", 4)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 10))
    v[7] = v[2] * 3 + 1
    v[11] = 1.0  # no extent
    table = spark.createDataFrame([(int(i % 2), int(i), [float(x) for x in v[i]]) for i in range(30)], "label int, vec_id int, embedding array<double>")

    def one(a, b):
        p, q = ((w.reshape(-1, 2) - w.reshape(-1, 2).mean(0)) for w in (a, b))
        if np.linalg.norm(p) < 1e-12 or np.linalg.norm(q) < 1e-12:
            return 0.0
        s = np.linalg.svd(p.T @ q / np.linalg.norm(p) / np.linalg.norm(q))[1].sum()
        return 1 / (1 + 4 * math.sqrt(max(0, 2 - 2 * s)))

    for newest in (None, 3, 9):
        got = {r.vec_id: (r.best, r.n) for r in replay.procrustes_best(table, "label", "vec_id", newest).collect()}
        for i in range(30):
            past = [j for j in range(i % 2, i, 2)][-newest if newest else None :]
            assert got[i][1] == len(past) and abs(got[i][0] - max((one(v[i], v[j]) for j in past), default=0.0)) < 1e-6
    units = replay.centred(table).select("label", "vec_id", replay.F.struct("xs", "ys").alias("u"))
    pairs = {(r.vec_id, r.source): r.similarity for r in replay.similar_pairs(units.where("vec_id <> 11"), "label", ["vec_id"], "vec_id", 0.5).collect()}
    want = {(i, j): one(v[i], v[j]) for i in range(30) for j in range(i % 2, i, 2) if 11 not in (i, j) and one(v[i], v[j]) >= 0.5}
    assert set(pairs) == set(want) and all(abs(pairs[k] - want[k]) < 1e-6 for k in want)


def test_blocks_of_pairs_grow_with_their_group(spark):
    """A path is sent as often for 8,000 paths of a group as for 2,000; every pair meets once."""
    sent = {}
    for n in (300, 2_000, 8_000):
        rows = spark.range(n).select(replay.F.lit(0).alias("g"), replay.F.col("id").alias("rn"))
        cells = replay._cells(rows, "g", None, None)
        sent[n] = cells.count() / n
        sides = cells.groupBy("cur", "old").agg(replay.F.count_if(~replay.F.col("as_old")).alias("a"), replay.F.count_if("as_old").alias("b")).collect()
        assert sum(r.a * r.b if r.cur > r.old else r.a * (r.a - 1) // 2 for r in sides) == n * (n - 1) // 2
    assert sent[8_000] == sent[2_000] <= replay.BLOCKS + 1


def test_nearest_holds_few_distances_at_once():
    """Many queries against many rows: the same distances as all at once, in a small part of their memory."""
    rng = np.random.default_rng(11)
    v, ids = rng.normal(size=(6_000, 8)), np.arange(6_000)
    best = np.full((2_000, 5), np.inf)
    tracemalloc.start()
    evaluate.keep_nearest(best, ids[:2_000], v[:2_000], ids, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 < 2_000 * 2_048 * 8
    for i in (0, 700, 1_999):
        assert np.allclose(np.sort(best[i]), np.sort(((v - v[i]) ** 2).sum(1))[1:6])


def test_queries_without_sql(spark, sf_dir):
    for f in (records.recommendations, records.diagnosis_text, records.path_similarity):
        assert f(spark, sf_dir).count() > 0
