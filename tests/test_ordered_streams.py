"""Rows that come late and shuffled are decided as if they had come in order."""

import datetime as dt
import hashlib
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from strokewise.operators import state
from strokewise.streaming import ordered

START = dt.datetime(2026, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


@pytest.fixture
def run(spark, tmp_path):
    """Feeds batches one by one; the last is followed by one far in the future, which lets the watermark pass."""

    def go(batches, schema, flow, last):
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        ordered.use_rocksdb(spark)
        try:
            source = tmp_path / "in"
            for i, rows in enumerate([*batches, last, []]):
                if rows:
                    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
                out = flow(spark.readStream.schema(schema).parquet(str(source)))
                query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
                query.awaitTermination()
        finally:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        return spark.read.parquet(str(tmp_path / "out")).where("at < '2026-02-01'").collect()

    return go


FAR = START + dt.timedelta(days=60)


def shuffled(rows, seed, parts=3):
    rng = random.Random(seed)
    rows = rows[:]
    rng.shuffle(rows)
    return [rows[i::parts] for i in range(parts)]


def test_fingerprints_seen_recently(spark, run):
    rng = random.Random(1)
    rows = [(rng.choice(["f", "g", "h", None]), i, at(rng.randint(0, 3000))) for i in range(60)] + [("late", 100, at(5000)), ("late", 101, at(2000)), ("late", 102, at(5100))]
    made = run(shuffled(rows, 2), "print string, id int, at timestamp", lambda s: ordered.seen_recently(s, "print", 300, "2 hours", ("id",)), [("end", 999, FAR)])
    table = spark.createDataFrame(rows, "print string, id int, at timestamp").withColumn("s", F.unix_seconds("at"))
    want = {r.id: r.seen for r in state.seen_recently(table, "print", "s", ["id"], 300).collect()}
    assert {r.id: r.seen for r in made} == want and [want[i] for i in (100, 101, 102)] == [False, False, True]


def test_remembers_no_more_than_its_share(run):
    rng = random.Random(3)
    rows = [(f"p{rng.randint(0, 30)}", i, at(i * 7)) for i in range(150)]
    made = run(shuffled(rows, 4), "print string, id int, at timestamp", lambda s: ordered.seen_recently(s, "print", 900, "2 hours", ("id",), most=10, shards=1), [("end", 999, FAR)])
    held, want = OrderedDict(), {}
    for p, i, when in rows:
        while held and (when - next(iter(held.values()))).total_seconds() > 900:
            held.popitem(last=False)
        want[i] = p in held
        held[p] = when
        held.move_to_end(p)
        while len(held) > 10:
            held.popitem(last=False)
    assert {r.id: r.seen for r in made} == want and 0 < sum(want.values()) < 150


def test_challenges_consumed_once(spark, run):
    rng = random.Random(5)
    known = [(f"c{i}", "x", at(400 + 50_000 * (i == 3))) for i in range(4)]
    rows = [(f"c{rng.randint(0, 4)}", rng.choice(["x", "x", "y"]), i, at(rng.randint(0, 600))) for i in range(60)] + [("c3", "x", 70, at(3000)), ("c3", "x", 71, at(49_000))]
    schema = "challenge string, binding string, id int, at timestamp"
    table = spark.createDataFrame(known, "challenge string, bound string, expires timestamp")
    made = run(shuffled(rows, 6), schema, lambda s: ordered.consumed(s, table, "20 hours", ("id",)), [("end", "x", 999, FAR)])
    batch = spark.createDataFrame(rows, schema)
    want = {r.id: r.reason for r in state.consumed(batch, table.withColumnRenamed("bound", "binding"), ["at", "id"]).collect()}
    assert {r.id: r.reason for r in made} == want and want[71] == "challenge_already_consumed"
    assert all(r.accepted == (r.reason == "consumed") for r in made)


def test_a_consumed_challenge_is_remembered_until_it_expires(spark, run):
    table = spark.createDataFrame([("c", "x", at(400_000))], "challenge string, bound string, expires timestamp")
    rows = [[("c", "x", at(0))], [("other", "x", at(200_000))], [("c", "x", at(300_000))]]
    made = run(rows, "challenge string, binding string, at timestamp", lambda s: ordered.consumed(s, table, "1 hour"), [("end", "x", FAR)])
    assert sorted((r.at, r.reason) for r in made if r.challenge == "c") == [(at(0), "consumed"), (at(300_000), "challenge_already_consumed")]


def test_trailing_counts(run):
    rng = random.Random(7)
    rows = [(rng.choice("st"), i, at(rng.randint(0, 500))) for i in range(60)] + [("u", 100, at(100)), ("u", 101, at(50))]
    made = run(shuffled(rows, 8), "session string, id int, at timestamp", lambda s: ordered.trailing(s, window_s=60, most=5, late="2 hours", order=("id",)), [("end", 999, FAR)])
    line = sorted(rows, key=lambda r: (r[2], r[1]))
    want = {r[1]: min(5, sum(q[0] == r[0] and (r[2] - q[2]).total_seconds() <= 60 for q in line[:i])) for i, r in enumerate(line)}
    assert {r.id: r.recent for r in made} == want and want[101] == 0


def test_suspicion(spark, run):
    rng = random.Random(9)
    kinds = ["speed_violation", "session_conflict", "checkpoint_exhausted", "beat", "beat", "beat", "passed", "unheard"]
    rows = [(rng.choice("ab"), rng.choice(kinds), rng.random() < 0.7, i, at(i * 11)) for i in range(120)]
    schema = "student string, kind string, advanced boolean, id int, at timestamp"
    made = run(shuffled(rows, 10), schema, lambda s: ordered.suspicion(s, "student", "enforce", late="2 hours", order=("id",)), [("end", "beat", True, 999, FAR)])
    now, want = {"a": 0, "b": 0}, {}
    for who, kind, advanced, i, _ in rows:
        if kind == "passed":
            now[who] = 0
        elif kind == "beat":
            now[who] = max(0, now[who] - 1) if advanced else now[who]
        else:
            now[who] = min(30, now[who] + {"speed_violation": 3, "session_conflict": 5, "checkpoint_exhausted": 4}.get(kind, 0))
        want[i] = (now[who], now[who] >= 10)
    assert {r.id: (r.suspicion, r.required) for r in made} == want and any(w[1] for w in want.values())


def test_suspicion_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(state, "BLOCK", 5)
    rng = random.Random(11)
    rows = [(rng.choice("abc"), i, rng.choice([3, 5, 4, -1, -1, -9, None])) for i in range(200)]
    want = {}
    for who, _, step in rows:
        now, peak = want.get(who, (0, 0))
        now = 0 if step is None else min(30, max(0, now + step))
        want[who] = (now, max(peak, now))
    made = {r.k: (r.score, r.peak) for r in state.suspicion(spark.createDataFrame(rows, "k string, i int, step int"), "k", ["i"]).collect()}
    assert made == want


def test_modes_of_suspicion():
    """Without enforcement nothing is required; switched off, nothing is counted."""
    rules = {}

    class Stream:
        columns = []

    for mode in ("off", "record", "enforce", "unknown"):
        kept = {}
        original, ordered._apply = ordered._apply, lambda stream, key, rule, *rest: rule
        try:
            rules[mode] = ordered.suspicion(Stream(), "k", mode)
        finally:
            ordered._apply = original
        got = [rules[mode]({"kind": "session_conflict"}, kept) for _ in range(3)]
        assert got == {"off": [(0, False)] * 3, "unknown": [(0, False)] * 3, "record": [(5, False), (10, False), (15, False)], "enforce": [(5, False), (10, True), (15, True)]}[mode]


def test_receipts(run):
    secret, digest = "k", lambda *p: hashlib.sha256("|".join(map(str, p)).encode()).hexdigest()

    def honest(challenge, n, start):
        out, last = [], digest(challenge, "me", "nonce")
        for i in range(n):
            out.append((challenge, "me", "me", i, last, f"load{i}", i * 150, False, at(start + i)))
            last = ordered.receipt(secret, challenge, digest("me"), i, f"load{i}", last, i * 150)
        return out, last

    good, last = honest("good", 4, 0)
    more = [("good", "me", "me", 0, "", "", 0, True, at(10)), ("good", "me", "me", 4, last, "x", 0, False, at(11)), ("good", "me", "me", 0, "", "", 0, True, at(12))]
    guess = [("guess", "me", "me", 0, "attacker", "x", 0, False, at(0))]
    gap = honest("gap", 1, 0)[0] + [("gap", "me", "me", 5, honest("gap", 1, 0)[1], "x", 0, False, at(5))]
    other = [("other", "me", "you", 0, digest("other", "me", "nonce"), "x", 0, False, at(1))]
    schema = "challenge string, owner string, session string, seq int, previous string, payload string, received long, verify boolean, at timestamp"
    rows = good + more + guess + gap + other
    made = run(shuffled(rows, 12), schema, lambda s: ordered.receipts(s, secret, "2 hours"), [("end", "me", "me", 0, "", "", 0, True, FAR)])
    got = {(r.challenge, r.at): (r.receipt is not None, r.reason) for r in made}
    want = {("good", at(i)): (True, None) for i in range(4)} | {("good", at(10)): (False, None), ("good", at(11)): (False, "challenge_consumed"), ("good", at(12)): (False, "nonce_reused"), ("guess", at(0)): (False, "receipt_chain_broken"), ("gap", at(0)): (True, None), ("gap", at(5)): (False, "batch_sequence_gap"), ("other", at(1)): (False, "session_mismatch")}
    assert got == want
