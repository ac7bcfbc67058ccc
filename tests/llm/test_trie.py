import hashlib
import random
import re
import zlib

import pytest

from strokewise.llm import _ranges
from strokewise.llm import trie as tr


def brute_force(rows):
    """Nodes from (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    at = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            at.setdefault(tuple(turns[:d]), []).append(c)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for node, members in at.items():
        under = [n for n in at if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in at)
        saved = sum((len(at[n]) - 1) * count(n[-1][1]) for n in under if n)
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(node))
        out.append((min(members), len(node), min(at[node[:-1]]) if node else None, len(members), sum(len(m) == len(node) + 1 for m in under), sum(map(leaf, under)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[1], r[0]))


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed):
    rng = random.Random(seed)
    texts = ["hello there", "a b  c\n", "", "\x0b", "é ü", None]
    rows = []
    for c in range(0, 130):
        if c % 20 == 0 and rng.random() < 0.3:
            continue
        n = rng.choice([0, 1, 2, 3, 5, 7])
        same = rng.random() < 0.3
        rows += [(c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]) if not same else "user", "same" if same else rng.choice(texts)) for t in range(n)]
    rows += [(500, t, "user", "long " * (t % 3)) for t in range(40)] + [(501, t, "user", "long " * (t % 3)) for t in range(40)] + [(502, t, "user", "long " * (t % 3)) for t in range(25)]
    rows += [(600, 1, "user", "b"), (600, 1, "user", "a"), (600, 1, "bot", "z"), (600, 1, "bot", "z"), (None, 1, "user", "nobody"), (700, 0, "user", "w " * 60_000)]
    return rows


@pytest.mark.parametrize(("seed", "rows", "block"), [(1, 200_000, 4_096), (2, 20, 3)])
def test_same_as_brute_force(spark, monkeypatch, seed, rows, block):
    monkeypatch.setattr(_ranges, "ROWS", rows)
    monkeypatch.setattr(tr, "BLOCK", block)
    data = made(seed)
    got = tr.digest(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    assert order(got) == order(brute_force(data))


def test_small_tables(spark):
    assert tr.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tr.digest(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    alone = [(c, 0, "user", "x") for c in (3, 10_003)]  # their families' least conversations are absent
    assert order(tr.digest(spark.createDataFrame(alone, SCHEMA)).collect()) == order(brute_force(alone))


def test_clashing_columns(spark):
    data = made(3)[:60]
    docs = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as c", "2 as place", "3 as words", "4 as k1")
    assert order(tr.digest(docs).collect()) == order(brute_force(data))
