import random

from pyspark.sql import functions as F

from strokewise.llm import quality

EDGES = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a b c a b c\n\na b c\n \nx"), (10**6 + 3, "a " * 20_000), (10**6 + 4, "é #x|y " * 30 + "\x0b\x1f\n\n")]


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "ça", "d#", "x\ny", "zz\n"]) for _ in range(rng.randint(0, 90)))) for i in range(150)] + EDGES + EDGES
    made = quality.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(made) == len(rows)
    want = quality.brute_force(rows)
    for r in made:
        assert tuple(r)[1:7] == want[r.doc_id]
        assert not (r.kept and r.base_failed)


def test_labelled_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.digest(docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.n_words >= 50]
    assert all(r.kept for r in good) and good
    bad = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_order_does_not_matter_and_columns_stay(spark):
    d = spark.createDataFrame([(1, "w " * 60 + "#" * 90, "x"), (2, "short", "y"), (3, None, "z")], "doc_id long, text string, rejected_by string")
    out, name = quality.judged(d)
    assert name == "rejected_by_" and out.columns == [*d.columns, name]
    for order in (quality.RULES, quality.RULES[::-1]):
        kept = d.where(quality.verdict(order, {"text": F.coalesce(d.text, F.lit(""))}).isNull()).count()
        assert kept == quality.keep_good(d).count() == 0
    assert quality.keep_good(d.limit(0)).count() == 0


def test_short_circuit(spark):
    """A rule that would raise is never reached by texts that an earlier one rejects."""
    loud = quality.Rule("loud", ("n_words",), lambda e: F.raise_error(F.lit("reached")).cast("boolean"))
    d = spark.createDataFrame([(1, "short")], "doc_id long, text string")
    assert d.select(quality.verdict((quality.RULES[0], loud), {"text": d.text}).alias("v")).first().v == "short"


def test_order_by_rejection_per_cost():
    """Shared measures are paid once, and rejections that an earlier rule makes anyway don't count."""
    from strokewise.llm import quality as ql

    rules = ql.RULES[:3]
    cost = dict.fromkeys(ql.MEASURES, 0.1) | {"n_repeat_words": 1.0}
    order = ql.by_rejection_per_cost(rules, [((True, False, False), 10), ((False, True, False), 30), ((True, True, False), 30), ((False, False, True), 20), ((False, False, False), 100)], cost)
    assert [r.name for r in order] == ["short", "symbols", "repetitive"]
