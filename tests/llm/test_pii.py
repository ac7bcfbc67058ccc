import hashlib
import random
import re

from strokewise.llm import pii

EDGES = [
    (1, None),
    (2, ""),
    (3, "a@b.c.d@e.fr x@y mail: jo.do%1@x-y.org 1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.256 é 10.0.0.25"),
    (4, "4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (555) 123-4567 +49 30 1234 ++44 20 7946 0958 +1 2"),
    (5, "9" * 50_000 + " " + "a" * 50_000),
    (6, "0" * 300 + ".1.1.1 " + "1" * 300 + ".2.3.4"),
]


def brute(t):
    t = t or ""
    out = []
    for k, (kind, pat) in enumerate(
        (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    ):
        for m in re.finditer(pat, t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                s = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1]))
                if not 13 <= len(d) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    names = ("email", "ip", "card", "phone")
    return (*[sum(x[0] == k for x in out) for k in range(4)], hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for k, s, e in out).encode()).hexdigest())


def test_base_same_as_brute_force(spark):
    rng = random.Random(6)
    bits = ["a", "@", ".", "1", "25", "+", "4111111111111111", " ", "-", "(", ")", "example.com", "10.1.2.3", "é", "555", "\n"]
    rows = [(i + 10, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)] + EDGES + EDGES[:3]
    made = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {d: brute(t) for d, t in rows}
    assert len(made) == len(rows)
    for r in made:
        assert tuple(r)[1:6] == want[r.doc_id]


def test_added_spans(spark):
    good = [f"call me, phone (0{i % 10}5) 555-{1000 + i} today or write to joe{i} (at) mail dot com" for i in range(120)]
    clean = ["plain words without any data at all, section 12 of 3"] * 100
    rows = list(enumerate(good + clean))
    made = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("phone" in made[i] and "email" in made[i] for i in range(120)) > 110
    assert not any(made[i] for i in range(120, 220))


def test_redaction_columns_and_empty(spark):
    d = spark.createDataFrame([(1, "write a@b.com or +1 (555) 123-4567!", "x"), (2, None, "y")], "doc_id long, text string, pii string")
    out = pii.redact(d)
    assert out.columns == d.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "write [EMAIL] or [PHONE]!", 2: None}
    assert pii.redact(d.limit(0)).count() == 0 and pii.digest(d.limit(0)).count() == 0


def test_long_runs_of_zeros_in_an_address():
    assert pii._checked("ip", "0" * 5000 + ".1.2.3") and pii._checked("ip", "0" * 5000 + "255.1.2.3")
    assert not pii._checked("ip", "0" * 5000 + "256.1.2.3")


def test_long_texts_in_little_time():
    import time

    for t in ("7" * 1_000_000, "a" * 1_000_000 + " @", "1." * 400_000, "a@" * 400_000, "+1" * 400_000, "+1" + " " * 1_000_000, "a.b@c.de " * 50_000 + "me (at) x dot y " * 20_000, "x (at) " * 100_000):
        began = time.perf_counter()
        pii.candidates(t)
        assert time.perf_counter() - began < 20, t[:20]
