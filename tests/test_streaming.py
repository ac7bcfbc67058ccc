import datetime as dt

import pytest

from strokewise.sources import sinks
from strokewise.streaming import flows

START = dt.datetime(2026, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


@pytest.fixture
def run(spark, tmp_path):
    """Feeds files of rows one by one through a flow and collects what it appends."""

    def go(batches, schema, flow, partitions=2):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        source = tmp_path / "in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            out = flow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
            query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
            query.awaitTermination()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        return spark.read.parquet(str(tmp_path / "out")).collect()

    return go


def test_each_id_passes_once(run):
    made = run([[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(3)), ("c", at(4))]], "id string, at timestamp", lambda s: flows.fresh(s, "id"))
    assert sorted(r.id for r in made) == ["a", "b", "c"]


def test_outcomes_need_a_prediction(spark, run):
    known = spark.createDataFrame([("a",)], "attempt_id string")
    made = run([[("a", at(0)), ("b", at(1))]], "attempt_id string, at timestamp", lambda s: flows.with_prediction(s, known))
    assert [r.attempt_id for r in made] == ["a"]


def test_windows(run):
    made = run([[("a", at(0)), ("a", at(30)), ("a", at(61))], [("a", at(5000))], [("a", at(9000))]], "k string, at timestamp", lambda s: flows.counted(s, "k").select("k", "window.start", "n"))
    assert {(r.start, r.n) for r in made} >= {(at(0), 2), (at(60), 1)}


def test_bundles_upserts_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", at(0), [(0, "pointerdown", 0, 1.0, 2.0), (1, "pointerup", 5, 3.0, 4.0)]), ("b", "s", at(1), [])], "attempt_id string, session string, at timestamp, events array<struct<seq:long,kind:string,t:long,x:double,y:double>>")
    sinks.write_jsonl(rows, str(tmp_path / "lines"))
    (tmp_path / "lines" / "bad.json").write_text('{"attempt_id": 5, "events": "no"}\n{broken\n')
    back = sinks.read_jsonl(spark, str(tmp_path / "lines")).cache()
    assert back.where("_corrupt_record is not null").count() == 2 and {r.attempt_id: len(r.events) for r in back.where("_corrupt_record is null").collect()} == {"a": 2, "b": 0}
    write = sinks.write_bundle(str(tmp_path / "store"))
    for _ in range(2):  # the same batch twice
        write(rows.union(rows), 7)
    read = lambda n: spark.read.parquet(str(tmp_path / "store" / n))
    assert read("attempts").count() == 2 and read("events").count() == 2 and [(r.n_events, r.n_pointerup) for r in read("summaries").collect()] == [(2, 1)]
    flat = lambda *x: spark.createDataFrame(list(x), "k string, version long, v double")
    path = str(tmp_path / "features")
    for more in ((("a", 1, 1.0), ("b", 1, 1.0)), (("a", 2, 2.0),), (("a", 1, 9.0), ("c", 1, 1.0))):
        sinks.upsert(spark, flat(*more), path, ["k"], "version")
    assert {(r.k, r.v) for r in sinks.newest(spark, path)[0].collect()} == {("a", 2.0), ("b", 1.0), ("c", 1.0)}
    stored = str(tmp_path / "stored")
    for _ in range(2):
        sinks.append_new(spark, flat(("a", 1, 1.0), ("a", 2, 2.0)), stored, "k", ["version"])
    assert [(r.k, r.version) for r in spark.read.parquet(stored).collect()] == [("a", 1)]
    files = sinks.manifest(spark, stored)
    assert files.count() > 0 and sinks.unsealed(files, files).count() == 0
