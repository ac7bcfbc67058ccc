"""Versions of several tables, snapshots, recordings as a data source, table functions, keyed hashes."""

import datetime as dt
import hashlib
import hmac
import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from strokewise.functions import hashing, tables
from strokewise.sources import snapshots
from strokewise.sources.recordings import Recordings
from strokewise.sources.store import Conflict, Store, write_bundle


def test_a_version_appears_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    assert store.version().number == 0 and store.read("a") is None
    one = store.commit({"a": rows(1, 2), "b": rows(3)})
    pinned = store.version()
    broken = rows(9).select(F.raise_error(F.lit("disk full")).cast("int").alias("v"))
    with pytest.raises(Exception, match="disk full"):
        store.commit({"a": rows(7), "b": broken})
    assert store.version() == one == pinned and sorted(r.v for r in store.read("a").collect()) == [1, 2]
    two = store.commit({"a": rows(4)})
    assert two.number == 2 and sorted(r.v for r in store.read("a").collect()) == [1, 2, 4]
    assert sorted(r.v for r in store.read("a", pinned).collect()) == [1, 2] and store.read("b").count() == 1
    with pytest.raises(Conflict):
        store.commit({"b": rows(5)}, after=pinned)
    assert store.read("b").count() == 1
    store.commit({"a": rows(6)}, append=False)
    assert [r.v for r in store.read("a").collect()] == [6] and store.versions() == [1, 2, 3]


def test_bundles_agree(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write = write_bundle(store)
    schema = "attempt_id string, at timestamp, events array<struct<seq:long,kind:string,t:long,x:double,y:double>>"
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    event = lambda n: [(i, "pointerdown" if i == 0 else "pointerup", i, 0.0, 0.0) for i in range(n)]
    first = spark.createDataFrame([("a", at(2), event(3)), ("a", at(1), event(2)), ("b", at(3), event(1))], schema)
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([("a", at(0), event(9)), ("c", at(5), [])], schema), 1)
    assert store.version().number == 2
    read = lambda n: {r.attempt_id: r for r in store.read(n).collect()}
    assert {k: r.at for k, r in read("attempts").items()} == {"a": at(1), "b": at(3), "c": at(5)}
    events = {r.attempt_id: r["count"] for r in store.read("events").groupBy("attempt_id").count().collect()}
    assert events == {"a": 2, "b": 1} == {k: r.n_events for k, r in read("summaries").items()}


def test_snapshot_and_curation(spark, tmp_path):
    line = lambda n, step=20, far=0.01: json.dumps([[i * step, 0.1 + i * far, 0.5] for i in range(n)])
    traces = {
        1: (line(6), 400.0, 200.0),
        2: (json.dumps([{"t_ms": i * 20, "x": i * 0.01, "y": 0.2} for i in range(5)]), 400.0, 200.0),
        3: (line(6), 400.0, 200.0),
        4: (line(3), 400.0, 200.0),
        5: ("no json", 400.0, 200.0),
        6: (line(6), 0.0, 200.0),
        7: (json.dumps([[5, 0.1, 0.1], [4, 0.1, 0.1], [6, 0.2, 0.2], [7, 0.2, 0.3]]), 400.0, 200.0),
        8: (line(6, far=0.9), 400.0, 200.0),
        9: (json.dumps([[0, 0.1, 0.1], ["x", 0.1, 0.1], [6, 0.2, 0.2], [7, 0.2, 0.3]]), 400.0, 200.0),
        11: (line(8), 400.0, 200.0),
    }
    student = {1: "s1", 2: "s1", 3: None, 4: "s2", 11: "s4"}
    rows = [(i, "org", student.get(i, "s3"), "mouse" if i % 2 else None, "correct" if i == 1 else "wrong", "low", "human", "excluded" if i == 11 else None, None, 0.5, None) for i in range(1, 12)]
    summaries = spark.createDataFrame(rows, "id int, organization_id string, student_id string, input_type string, interaction_result string, risk_level string, sample_label string, dataset_status string, retry_count int, drop_distance_norm double, actor_band string")
    held = spark.createDataFrame([(i, *t) for i, t in traces.items()], "behavior_id int, points string, box_w double, box_h double")
    key = b"secret"
    name = lambda kind, v: f"{kind}_" + hmac.new(key, f"{kind}:{v}".encode(), hashlib.sha256).hexdigest()[:24]
    snap, store = Store(spark, str(tmp_path / "snap")), Store(spark, str(tmp_path / "train"))
    made = snapshots.export(summaries, held, snap, key)
    decided = {r.attempt_id: (r.quality_status, r.reasons) for r in snap.read("curation").collect()}
    bad = lambda r: ("rejected", [r])
    want = {1: ("valid", []), 2: ("valid", []), 3: ("pending", ["participant_group_unknown"]), 4: bad("too_few_points"), 5: bad("missing_or_invalid_trace"), 6: bad("invalid_trace_dimensions"), 7: bad("non_monotonic_time"), 8: ("pending", ["extreme_normalized_speed_review"]), 9: bad("missing_or_invalid_trace"), 10: bad("missing_or_invalid_trace"), 11: ("valid", [])}
    assert decided == {name("human_db", i): w for i, w in want.items()}
    assert made.notes["counts"] == {"total": 11, "linked": 10, "participants": 4, "with_trace": 5, "quality_valid": 3, "quality_pending": 2, "quality_rejected": 6}
    attempts = {r.attempt_id: r for r in snap.read("attempts").collect()}
    first = attempts[name("human_db", 1)]
    assert len(attempts) == 5 and first.participant == name("participant", "s1") and first.interaction_success
    assert [(e.seq, e.kind, e.t) for e in first.events] == [(i, "pointerdown" if i == 0 else "pointerup" if i == 5 else "pointermove", i * 20.0) for i in range(6)] and math.isclose(first.events[1].x, 44.0)
    assert snap.read("features").count() == 3 and snap.read("snapshot").count() == 11
    with pytest.raises(ValueError):
        snapshots.curate(snap, store, confirmed_human=False)
    done = snapshots.curate(snap, store, confirmed_human=True)
    assert {r.attempt_id for r in store.read("features").collect()} == {name("human_db", i) for i in (1, 2, 3, 8)} == {r.attempt_id for r in store.read("labels").collect()}
    assert done.notes["counts"] == {"source_rows": 11, "included": 4, "linked": 3, "participants": 2, "excluded": 7, "excluded_by_reason": {"too_few_points": 1, "missing_or_invalid_trace": 3, "invalid_trace_dimensions": 1, "non_monotonic_time": 1, "source_dataset_status_excluded": 1}}


def test_recordings_in_ranges(spark, tmp_path):
    spark.dataSource.register(Recordings)
    folder = tmp_path / "in"
    folder.mkdir()
    want, n = [], 0
    for f in range(3):
        lines = []
        for i in range(40):
            lines.append(json.dumps({"recording": f"r{f}", "seq": i, "type": "aim_move", "t": i * 10, "x": i / 2, "y": None, "é": "x" * (i * 7 % 50)}, ensure_ascii=False))
            want.append((f"r{f}", i, "aim_move", i * 10, i / 2, None, None))
        lines += ["", "{broken", '{"seq": 1}', '{"recording": "q", "seq": "1", "x": true}']
        want += [(None,) * 6 + ("{broken",), (None,) * 6 + ('{"seq": 1}',), ("q", None, None, None, None, None, None)]
        (folder / f"{f}.json").write_text("\n".join(lines) + ("\n" if f else ""))
        n += (folder / f"{f}.json").stat().st_size
    (folder / "_SUCCESS").write_text("")
    for size in (64, 1_000, 1 << 20):
        made = spark.read.format("recordings").option("range_bytes", size).load(str(folder))
        assert made.rdd.getNumPartitions() >= n // size
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
    (tmp_path / "none").mkdir()
    assert spark.read.format("recordings").load(str(tmp_path / "none")).count() == 0


EVENTS = [("pointer_move", 1.0), ("aim_move", 0.0), ("aim_move", 1.0), ("pointer_down", 1.0), ("pointer_move", 2.0), ("drop", 3.0), ("aim_move", 4.0), ("pointer_down", 4.0), ("pointer_down", 5.0), ("pointer_move", 6.0), ("aim_move", 7.0)]


def test_runs_in_sql(spark):
    tables.register(spark)
    rows = [(f"r{r}", i, k, x, 0.0) for r in range(3) for i, (k, x) in enumerate(EVENTS[: 11 - 3 * r])]
    spark.createDataFrame(rows, "recording string, seq long, kind string, x double, y double").repartition(3).createOrReplaceTempView("recorded")
    got = spark.sql("SELECT * FROM split_runs(TABLE(SELECT * FROM recorded) PARTITION BY recording ORDER BY seq)").collect()
    lateral = spark.sql("SELECT recording, s.* FROM (SELECT recording, collect_list(struct(seq, kind, x, y)) events FROM recorded GROUP BY recording) r, LATERAL runs_of(r.events) s").collect()
    assert sorted(tuple(r)[1:] for r in lateral) == sorted(map(tuple, got))
    assert sorted((r.run, r.part, r.seq) for r in lateral if r.recording == "r0") == [(0, "aim", 1), (0, "aim", 2), (0, "drag", 4), (0, "drag", 5), (2, "drag", 9)]
    from strokewise.operators import segments

    events = spark.table("recorded").select("recording", F.lit(0).alias("ano"), "seq", "kind", "x", "y")
    of_windows = {(r.recording, r.part, r.seq) for r in segments.runs(events, "recording").collect()}
    assert of_windows == {(r.recording, r.part, r.seq) for r in lateral}


def test_keyed_hashes(spark):
    words = ["", "a", "é" * 99, None]
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    for key in (b"k", b"long" * 40):
        made = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.hmac_sha256(key, F.col("w")).alias("h"), hashing.pseudonym("kind", F.col("w"), key).alias("p"), hashing.uuid5(space, F.col("w")).alias("u"), hashing.bucket(F.col("w"), 12).alias("b"))
        for r in made.collect():
            if r.w is None:
                assert r.h is r.p is r.u is r.b is None
                continue
            assert r.h == hmac.new(key, r.w.encode(), hashlib.sha256).hexdigest() and r.u == str(uuid.uuid5(space, r.w))
            assert r.p == (f"kind_{hmac.new(key, f'kind:{r.w}'.encode(), hashlib.sha256).hexdigest()[:24]}" if r.w else None)
            assert r.b == int.from_bytes(hashlib.sha256(r.w.encode()).digest()[:8], "big") % 12
