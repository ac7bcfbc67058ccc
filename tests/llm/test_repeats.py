import random

import numpy as np
import pytest

from strokewise.llm import repeats as rp


@pytest.mark.parametrize("letters", [2, 4, 200])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in (1, 2, 3, 10, 60, 300):
        for _ in range(15):
            text = np.array([rng.randrange(letters) + 1 for _ in range(n - 1)] + [0])
            if rng.random() < 0.3:
                text[: n // 2] = 1
            want = sorted(range(n), key=lambda i: text[i:].tolist())
            assert rp.suffix_array(text, 1000).tolist() == want


def test_equal_windows():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(9, 60))) for _ in range(40)]
    got = rp.equal_windows(parts, 9)
    every = [p[i : i + 9] for p in parts for i in range(len(p) - 8)]
    for p, mask in zip(parts, got, strict=True):
        assert mask.tolist() == [every.count(p[i : i + 9]) > 1 for i in range(len(p) - 8)]


def rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [text(60) for _ in range(4)]
    out = [(i, text(rng.choice([0, 20, 60, 200])) + (rng.choice(common)[rng.randint(0, 90) :] if i % 2 else "") + text(rng.choice([0, 30]))) for i in range(80)]
    out += [(100, out[3][1]), (101, out[5][1][:230]), (102, None), (103, ""), (104, "abc" * 700), (105, "x" * 199), (106, "x" * 199 + "y"), (107, out[7][1]), (107, out[7][1]), (None, "z" * 250)]
    return out


@pytest.mark.parametrize("large", [rp.LARGE, 3])
def test_same_as_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(rp, "LARGE", large)
    data = rows(2)
    made = rp.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, made), key=key) == sorted(rp.brute_force(data), key=key)


def test_columns_and_empty(spark):
    d = spark.createDataFrame([(1, "q" * 300, "k")], "doc_id long, text string, cut string")
    out, name = rp.cut(d)
    assert name == "cut_" and out.columns == [*d.columns, name]
    assert rp.digest(d.limit(0)).count() == 0
