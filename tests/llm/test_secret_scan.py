import random

from strokewise.llm import secret_scan as ss

EDGES = [
    (1, None),
    (2, ""),
    (3, "password=abc token=token: abcdefgh AKIA12 " + "f" * 30 + " é" * 30 + ' secret="A1b2C3d4"'),
    (4, "secret=token=abcdefg apikey : 'zzzzzz' API_KEY:=x AKIAAKIA" + "X9" * 10),
    (5, "x" * 100_000),
]


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    bits = ["token", "=", ":", " ", '"', "secret", "abcdef", "AKIA", "Z9Z9Z9Z9Z9Z9Z9Z9", "é", "0123456789abcdef", "passwd", "api_key", "\n"]
    rows = [(i + 10, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(300)] + EDGES + EDGES
    made = ss.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = ss.brute_force(rows)
    assert len(made) == len(rows)
    for r in made:
        assert tuple(r)[1:5] == want[r.doc_id]


def test_random_tokens_are_found_and_others_are_not(spark):
    rng = random.Random(4)
    letters = ss.ALPHABETS[4][1]
    rows = []
    for i in range(400):
        secret = "".join(rng.choice(letters) for _ in range(40)) + "7"
        plain = "xyzxyzxyzxyzxyzxyzxyzxyzxyz" + "w" * 12 + "12"
        rows.append((i, f"see {secret} and {plain}"))
    made = ss.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [x for r in made for x in r.spans.split(",") if x]
    right = sum(x == "random:4:45" for x in found)
    assert right > 340 and len(found) - right <= ss.RATE * len(found) + 1


def test_thresholds():
    even = {b: 10 for b in range(ss.BINS)}
    assert ss.thresholds({("hex", 20): even}) == {("hex", 20): 0.0}
    assert ss.thresholds({("hex", 20): even | {0: 400}})[("hex", 20)] > 0
    assert ss.thresholds({("hex", 20): {0: 400}}) == {} and ss.thresholds({("hex", 20): {30: 2}}) == {}


def test_empty_table_and_extra_columns(spark):
    d = spark.createDataFrame([(1, "token=abcdef", "x")], "doc_id long, text string, secrets string")
    out, name = ss.scan(d)
    assert name == "secrets_" and out.columns == [*d.columns, name]
    assert ss.scan(d.limit(0))[0].count() == 0


def spans_of(spark, tokens):
    made = ss.digest(spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string")).collect()
    return [r.spans != "" for r in sorted(made, key=lambda r: r.doc_id)]


def test_a_repeated_token_does_not_decide_its_stratum(spark):
    rng = random.Random(6)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    secrets = [draw(ss.ALPHABETS[4][1], 40) + "7" for _ in range(400)]
    p = {r.t: r.r.p for r in spark.createDataFrame([(t,) for t in secrets], "t string").select("t", ss.randomness(ss.F.col("t")).alias("r")).collect()}
    # by occurrences, no threshold would be left for the secrets
    half = min(secrets, key=lambda t: abs(p[t] - 0.485))
    assert 0.475 <= p[half] < 0.5
    assert sum(spans_of(spark, secrets + [half] * 2000)[:400]) > 340
    # by occurrences, the threshold would be 0 and each plain token accepted at it
    plain = ["".join(c * 3 for c in draw("xyzw", 13)) + "12" for _ in range(400)]
    high = max(secrets, key=p.get)
    assert sum(spans_of(spark, plain + [high] * 2000)[:400]) == 0


def test_small_bands_are_judged_with_their_neighbours():
    even = {b: 10 for b in range(ss.BINS)}
    assert ss.thresholds({("hex", 20): even, ("hex", 28): {30: 2}, ("dec", 28): {30: 2}}) == {("hex", 20): 0.0, ("hex", 28): 0.0}
    assert ("hex", 64) in ss.thresholds({("hex", 20): even, ("hex", 64): {30: 2}})


def test_very_many_matches(spark):
    """A hundred thousand matches in one text take seconds, and stand where they should."""
    import time

    text = "key: token=abcdef1 " * 60_000 + "deadbeefdeadbeefdeadbeef0 " * 40_000
    began = time.perf_counter()
    got = ss.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.perf_counter() - began < 90
    assert tuple(got)[:5] == (1, *ss.brute_force([(1, text)])[1])
