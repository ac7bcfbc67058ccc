import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from strokewise.llm import scoring as sc
from strokewise.llm._text import Texts

LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    cut = lambda t: [*re.findall(r"[^ \t-\r]+", (t or "").translate(LOW)), None]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    seen = Counter(w for d, t in rows if not out(d) for w in cut(t))
    n, v = sum(seen.values()), len(seen)
    return {d: (out(d), len(cut(t)), sum(seen[w] > 0 for w in cut(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in cut(t))) for d, t in rows}


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    return [(i, "".join(rng.choice(words[: rng.choice([9, 300])]) + rng.choice([" ", " ", ". ", "\n", "  "]) for _ in range(rng.randint(0, 120)))) for i in range(n)]


def test_base_and_better_than_it(spark):
    rows = [*corpus(300), (1000, None), (1001, ""), (1002, "x" * 300_000 + " y" * 2_000), (7, "twice"), (7, "twice"), (None, "null id")]
    made = sc.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert len(made) == len(rows)
    for r in made:
        if r.doc_id == 7:
            continue
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in made if r.held_out and r.n_tokens > 20]
    assert sum(r.bits_per_byte for r in held) / len(held) < 2.6  # random letters alone would take over 2 bits each


def model(seed=0, slot_bits=16):
    texts = [t for _, t in corpus(40)]
    code = sc.Code(np.append(np.bincount(Texts.of(pa.array(texts)).buf, minlength=256), len(texts)))
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 256, (sc.PREDICTORS, 1 << slot_bits)).astype(np.uint8)
    mixer = sc.Mixer(2 * code.nodes_total)
    mixer.finish()
    return code, table, mixer, slot_bits


def spelled(items, firsts, code, table, mixer, slot_bits):
    """Log probabilities of units (bytes, whether the text ends) after their first symbols, and of firsts."""
    bucket = sc.Bucket(np.array([len(b) * 2 + e for b, e in items], np.uint32), np.frombuffer(b"".join(b for b, _ in items), np.uint8), np.ones(len(items)), np.array(firsts, np.int64), np.ones(len(firsts)))
    out = np.zeros(len(items) + len(firsts))
    for slots, nodes, bits, item in bucket.spelled(code, slot_bits):
        out += np.bincount(item, mixer.log_probabilities(sc._looked_up(table, slots), nodes, bits), len(out))
    return out[: len(items)], out[len(items) :]


def test_probabilities_of_all_next_symbols_add_up_to_one():
    """After any beginning of a unit, and for first symbols after any place, exactly one is spread over what may follow."""
    made = model()
    for begun in (b"a", b"ab", b"abcdefghij"):
        items = [(begun, 0)] + [(begun + bytes([c]), 0) for c in range(256)] + [(begun, 1)]
        units, _ = spelled(items, [], *made)
        assert abs(np.exp(units[1:] - units[0]).sum() - 1) < 1e-3
    for place in (0, 1 << 24, (3 << 24) + 0x616263):
        _, firsts = spelled([], [(place << 9) | c for c in range(257)], *made)
        assert abs(np.exp(firsts).sum() - 1) < 1e-3


def test_mixing_within_a_document():
    """Weights come from earlier blocks alone, and a repetitive document becomes cheaper than its spelling."""
    n = 3_000
    spelt = np.full(n, -20.0)
    first, per = np.array([0, 1_000, 1_000]), np.array([1_000, 0, 2_000])
    earlier = np.concatenate([np.zeros(1_000), np.arange(2_000)])
    out = sc.adapted(spelt, np.zeros(n), earlier, first, per)
    assert out[:1_000].min() > -21 and out[2_900:].mean() > -0.2
    again = sc.adapted(np.append(spelt[:2_000], spelt[2_000:] * 2), np.zeros(n), earlier, first, per)
    assert (again[:2_000] == out[:2_000]).all()


def test_counts_of_contexts(spark):
    """Each slot of the table has the counts that came there, from all buckets and tasks."""
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, t string").withColumn("held_out", sc._held_out(sc.F.col("doc_id"))).repartition(3)
    code = model()[0]
    found = sc.merged(sc.dealt(docs, 5))
    table = sc.context_table(found, spark.sparkContext.broadcast(code), 16)
    want = np.zeros((sc.PREDICTORS, 1 << 16, 2), np.int64)
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 == 2:
            continue
        piece = sc.Piece(Texts.of(pa.array([t])), 1)
        size = piece.ends_of - piece.starts_of
        raw = t.encode()
        bucket = sc.Bucket(size * 2 + piece.last_of, np.frombuffer(b"".join(raw[a:b] for a, b in zip(piece.starts_of, piece.ends_of)), np.uint8), np.bincount(piece.unit), piece.firsts, np.bincount(piece.first))
        for slots, _, bits, item in bucket.spelled(code, 16):
            for k in range(sc.PREDICTORS):
                np.add.at(want[k], (slots[k], bits), bucket.times[item])
    assert (table == sc._level(want[:, :, 0]) * 16 + sc._level(want[:, :, 1])).all()


def test_columns_and_empty(spark):
    d = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, score string")
    out = sc.scored(d, keep=["doc_id", "score"])
    assert out.columns[:3] == ["doc_id", "score_", "held_out"] and out.count() == 1
    assert sc.scored(d.limit(0)).count() == 0


def test_scores_do_not_depend_on_how_documents_are_dealt(spark, monkeypatch):
    rows = corpus(200)
    made = []
    for size, parts in ((sc.PIECE, 1), (2_000, 3)):
        monkeypatch.setattr(sc, "PIECE", size)
        monkeypatch.setattr(sc, "BUCKET", size)
        monkeypatch.setattr(sc, "learned", lambda found, shared, bits: sc.Mixer(2 * shared.value[0].nodes_total))
        made.append({r.doc_id: r.score for r in sc.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()})
    assert made[0].keys() == made[1].keys() and all(math.isclose(made[0][d], made[1][d], rel_tol=1e-6) for d in made[0])


def test_weights_are_learned_on_all_training_documents(spark, monkeypatch):
    """Every bit of every training document is visited, and none of those held out."""
    seen = []
    learned = sc.learned
    monkeypatch.setattr(sc, "PIECE", 20_000)
    monkeypatch.setattr(sc, "learned", lambda *a: seen.append((learned(*a), a[1].value[0])) or seen[-1][0])
    rows = [(i, t * 200) for i, t in corpus(100)]
    sc.scored(spark.createDataFrame(rows, "doc_id long, text string"))
    mixer, code = seen[0]
    train = [t.encode() for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    bits = sum(int(code.sizes[list(t)].sum()) + int(code.sizes[sc.END]) for t in train)
    assert mixer.visits.sum() == bits and round((mixer.hits - 0.02).sum()) == bits
