import random

from strokewise.llm import jaccard as jc


def made(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jc.digest(d).collect()}


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((i, " ".join(base).upper() if i % 3 else "  ".join(base)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 20, 60, 150])))))
    return rows


def test_same_as_brute_force(spark):
    rows = corpus(5, 260) + [(9000, None), (9001, ""), (9002, " \n")]
    assert made(spark, rows) == jc.brute_force(rows)


def test_frequent_shingles(spark):
    """Half of each text is one of a few common passages, so the combination signatures are used."""
    rng = random.Random(8)
    common = [" ".join(f"c{k}_{i}" for i in range(90)) for k in range(2)]
    rows = []
    for i in range(140):
        tail = " ".join(f"x{rng.randrange(6 if i % 4 else 4000)}" for _ in range(rng.choice([3, 8, 20, 90])))
        rows.append((i, common[i % 2] + " " + tail))
    assert made(spark, rows) == jc.brute_force(rows)


def test_deduplicate(spark):
    d = spark.createDataFrame([(2, "a b c d e f", 1), (1, "A b c d e f", 2), (1, "A b c d e f", 2), (3, None, 3), (4, "z", 4), (None, "q", 5)], "doc_id long, text string, n_shingles int")
    kept = jc.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1, r.n_shingles) for r in kept.collect()) == [(-1, 5), (1, 2), (3, 3), (4, 4)]
    assert jc.deduplicate(d.limit(0)).count() == 0
