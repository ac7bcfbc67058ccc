import random

from strokewise.llm import decontaminate as dc


def made(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    return {r.doc_id: tuple(r)[1:] for r in dc.digest(d, b, **kw).collect()}


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "ß9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"b{i}", text(rng.choice([3, 9, 10, 14, 30]))) for i in range(25)] + [("b1", text(12)), ("e", ""), (None, text(11)), ("n", None)]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 60))
        if i % 2:
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 10))
            t += "; " + "-".join(w[a : a + rng.choice([9, 10, 11])]).upper() + " " + text(5)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, " ".join(["x"] * 30_000)), (102, " ".join(["x"] * 30_000))]
    docs += [(103, docs[1][1] + "\n" + docs[3][1])]
    assert made(spark, docs, items) == dc.brute_force([d for d in docs if d[0] != 102], items) | {102: made(spark, docs[-2:-1], items)[102]}
    blocks = made(spark, docs, items, block_bytes=300)
    assert blocks == made(spark, docs, items)


def test_empty_and_extra_columns(spark):
    d = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, found string")
    b = spark.createDataFrame([], "item_id string, text string")
    assert [r.contaminated for r in dc.digest(d, b).collect()] == [False]
    one = spark.createDataFrame([("i", "B c")], "item_id string, text string")
    assert dc.excise(d, one).count() == 0
    assert dc.excise(d, b).columns == d.columns
    assert dc.digest(d.limit(0), one).count() == 0
