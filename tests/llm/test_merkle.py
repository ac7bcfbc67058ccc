import hashlib
import random
import zlib

import pytest

from strokewise.llm import merkle as mk


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Top and, for each leaf, its siblings as (before, after) by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(proofs):
            low = at[i] - at[i] % 3
            p.append((level[low : at[i]], level[at[i] + 1 : low + 3]))
            at[i] //= 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute_force(rows):
    """Digest rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = lambda d: float("-inf") if d is None else d
    tops = {}
    for g in names:
        groups[g].sort(key=lambda x: (low(x[1][0]), x[0]))
        tops[g] = tree([h for h, _ in groups[g]])
    root, upper = tree([tops[g][0] for g in names])
    out = []
    for g, rest in zip(names, upper, strict=True):
        for (h, r), proof in zip(groups[g], tops[g][1], strict=True):
            proof = proof + rest
            folded = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                folded = leaf(*r[:4], r[4].replace("\n", ""))
            for before, after in proof:
                folded = sha(*before, folded, *after)
            out.append((r[0], h, tops[g][0], root, sha(*[x for b, a in proof for x in b + a]), folded, folded == root))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:])))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(seed, n):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot", "hot", "hot", None, "", "ä", "z", "Z", f"s{rng.randint(0, 9)}"])
    rows = [(i, source(), rng.choice(["en", None]), rng.choice([0, None, -5, 7]), rng.choice([f"a\nb{i}\n", "é" * rng.randint(0, 9), "", None, "x\n" * 50])) for i in range(n)]
    return rows + [(3, "hot", None, None, None), (3, "hot", "en", 1, "again"), (None, "hot", "en", 1, "no id\n"), (900, None, None, None, "y" * 200_000 + "\n")] + [(44, "hot", "en", 1, "same\nrow")] * 30


@pytest.mark.parametrize("total", [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 100])
def test_runs_make_the_tree(total):
    """Cut anywhere into runs, known and asked nodes suffice."""
    rng = random.Random(total)
    leaves = [sha(str(i)).encode() for i in range(total)]
    top, proofs = tree([h.decode() for h in leaves])
    for _ in range(8):
        cuts = sorted({0, total, *(rng.randint(0, total) for _ in range(rng.randint(0, 6)))})
        runs = [mk.Run(leaves[a:b], a, total) for a, b in zip(cuts, cuts[1:], strict=False)]
        nodes = {(level, i): h for r in runs for level, i, h in r.ragged()}
        assert len(nodes) == sum(1 for r in runs for _ in r.ragged())
        if len(runs) > 1:
            table = mk._table([(0, total, level, i, h.decode()) for (level, i), h in nodes.items()], mk.pa.schema(list(mk._NODE)[:5]))
            nodes |= {(r["level"], r["place"]): r["hash"].encode() for r in mk._block(99)(table).to_pylist()}
        for r in runs:
            asked = {a: nodes[a] for a in r.asks()}
            assert (r.top or asked[len(r.sizes) - 1, 0]).decode() == top
            got = [[(s["before"], s["after"]) for s in p] for p in r.proofs(asked, []).to_pylist()]
            assert got == proofs[r.start : r.end]


@pytest.mark.parametrize(("rows", "block"), [(50_000, 9), (20, 9), (7, 1)])
def test_same_as_brute_force(spark, monkeypatch, rows, block):
    monkeypatch.setattr(mk, "ROWS", rows)
    monkeypatch.setattr(mk, "BLOCK_LEVELS", block)
    data = made(rows, 260)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that ranges don't all meet in one task
    try:
        got = mk.digest(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert order(got) == order(brute_force(data))


def test_small_tables(spark):
    one = [(5, None, None, None, None)]
    got = mk.digest(spark.createDataFrame(one, SCHEMA)).collect()
    assert order(got) == brute_force(one) and got[0]["leaf"] == got[0]["root"]
    assert mk.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_proves_rows(spark):
    docs = spark.createDataFrame(made(1, 40), SCHEMA).selectExpr("*", "'k' as root", "1 as place")
    out = mk.manifest(docs)
    assert out.columns == ["doc_id", "source", "leaf", "place", "subroot", "root", "proof"]
    assert out.where(mk.folded(out["leaf"], out["proof"]) != out["root"]).count() == 0
