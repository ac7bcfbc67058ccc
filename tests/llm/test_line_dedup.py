import hashlib
import random
import zlib

import numpy as np
import pytest

from strokewise.llm import _ranges
from strokewise.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, chars=40, docs=5):
    lines = [(t or "").split("\n") for _, t in rows]
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = {}
    for r, (d, _) in enumerate(rows):
        for k in {key(x) for x in lines[r]}:
            held.setdefault(k, []).append(d)
    lowest = lambda d: float("-inf") if d is None else d
    out = []
    for (d, _), ls in zip(rows, lines, strict=True):
        kept = [x for x in ls if not (len(key(x)) >= chars and len(held[key(x)]) >= docs and lowest(d) < max(map(lowest, held[key(x)])))]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1:]))


def made(seed):
    rng = random.Random(seed)
    hot = "Share this page with all of your friends Ä and others"
    common = [f"line {i} that stands in many of the documents here" for i in range(12)] + ["é" * 39, "É" * 40, "ß" * 41]
    rows = []
    for i in range(150):
        ls = [rng.choice([f"own {i} {j}", rng.choice(common), "  " + rng.choice(common).upper() + "\t\r", ""]) for j in range(rng.randint(0, 12))]
        rows.append((i if i % 11 else None, "\n".join(ls + [hot] * (i % 3))))
    return rows + [(500, None), (501, ""), (502, "\n\n"), (503, hot + "\n" + "w" * 300_000), *[(504, "x\n" + hot)] * 4, *[(7, "the very same row with a line of many characters")] * 6, (None, hot)]


@pytest.mark.parametrize("per_range", [500_000, 9])
def test_same_as_brute_force(spark, monkeypatch, per_range):
    monkeypatch.setattr(ld, "ROWS", per_range)
    rows = made(per_range)
    got = ld.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert order(map(tuple, got)) == order(brute_force(rows))


def test_stream_in_any_batches():
    """One range read in batches of any size gives the same places."""
    rng = random.Random(3)
    records = sorted({(rng.randint(0, 6), 1, rng.randint(0, 9), rng.randint(0, 2)) for _ in range(120)}, key=lambda r: (r[0], -r[2], r[3]))
    import pyarrow as pa

    def batches(step):
        for i in range(0, len(records), step):
            part = records[i : i + step]
            cols = [pa.array([r[k] for r in part], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([1] * len(part), pa.int32()), pa.array([[r[3]] for r in part], pa.list_(pa.int32()))], names=["h1", "h2", "doc", "row", "n", "at"])

    every = []
    for step in (1, 2, 3, 7, 1000):
        out = [r for b in ld._sifted(5)(batches(step)) for r in b.to_pylist()]
        every.append(sorted((r["kind"], r["h1"], r["doc"], r["row"]) for r in out))
    assert all(e == every[0] for e in every)


def test_bitmaps_and_columns(spark):
    line = "this line has far more than forty characters in it"
    rows = [(i, f"a\n{line}\nb" if i else f"{line}\nb", "x", i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string, N_LINES int")
    maps = ld.bitmaps(docs)
    bits = {r["doc"]: np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), bitorder="little").tolist() for r in maps.collect()}
    assert bits == {0: [0] + [1] * 7, 1: [1, 0] + [1] * 6, 2: [1, 0] + [1] * 6, 3: [1, 0] + [1] * 6}
    out, before, lost = ld.kept_lines(docs, maps)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped"] and (before, lost) == ("n_lines_", "n_dropped")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "b", 1: "a\nb", 2: "a\nb", 3: "a\nb", 4: f"a\n{line}\nb"}
    assert ld.digest(docs.limit(0)).count() == 0


def test_places_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "", "a", "b"]) if i % 3 else "hot", i) for i in range(400)]
    from pyspark.sql import functions as F

    from strokewise.llm._tables import written

    table = written(spark.createDataFrame(rows, "g string, v int"), "t")
    out = _ranges.positions(table, ["g"], [F.asc("v")], "sorted", rows=23)
    got = {(r["g"], r["v"]): (r["place"], r["total"]) for r in out.collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted(v for h, v in rows if h == g)
        assert [got[g, v] for v in mine] == [(i, len(mine)) for i in range(len(mine))]
