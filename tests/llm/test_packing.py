import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strokewise.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["Don't WE'LL it's 's ''s !!'s", "ΑΣ ΟΔΟΣ Ǆ ǅ ſ K", "½²³ 12 3", "a\x85b\xa0c\x1fd\x00", "<|endoftext|> x <|startoftext|>", "é İI", "日本語 emoji 😀", "—“quoted”—", "", "   ", "µªº ÆŒ ŉ"]


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    chars = [chr(c) for c in range(1, 0x250)] + list(" '' aeist\n")
    texts = ODD + ["".join(rng.choice(chars) for _ in range(300)) for _ in range(200)] + ["".join(rng.choice("abc 'stdlm.é!1") for _ in range(200)) for _ in range(200)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert packing.token_bytes(texts, PATH, True) == want == packing.token_bytes(texts, PATH, False)


@pytest.mark.parametrize("sizes", [[5], [10] * 7, [1, 9, 5, 5, 3, 7, 2, 8, 4, 6], list(range(1, 10)) * 5])
def test_least_sum_of_squares(sizes):
    """Each placement is the best one of all, found by trying them."""
    bins, places, full = packing.sum_of_squares(np.array(sizes), 10)
    gaps, open_ = {}, np.zeros(11, int)
    for i in np.argsort(-np.array(sizes), kind="stable"):
        s, best = sizes[i], None
        for gap in [g for g in range(s, 10) if open_[g]] + [10]:
            n = open_.copy()
            n[gap] -= gap < 10
            n[gap - s] += gap > s
            best = min(best or (math.inf,), (int((n[1:] ** 2).sum()), gap))
        was = gaps.get(bins[i], 10)
        assert was == best[1]
        open_[was] -= was < 10
        open_[was - s] += was > s
        gaps[bins[i]] = was - s
    assert sorted(10 - g for g in gaps.values()) == sorted(full)


def check(rows, length):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in seqs.values():
        at = 0
        for offset, size in sorted(x):
            assert offset == at
            at += size
        assert at <= length
    return len(seqs), math.ceil(sum(r.length for r in rows) / length)


def test_pack(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "cat", "é", "zxq"]) for _ in range(rng.choice([0, 3, 40, 120])))) for i in range(600)]
    docs += [(7, None), (None, "x"), (None, "x"), (9, ""), (1000, "word " * 700)]
    frame = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, piece string")
    out = packing.pack(frame, PATH, length=128).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 128)):
            cut = ids[a : a + 128]
            want.append((d, p, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in out), key=lambda x: (x[0] is None, x[0] or 0, x[1:])) == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1:]))
    del key
    used, least = check(out, 128)
    assert used <= 1.1 * least + 1


def test_rounds(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, 0, 0, rng.randint(1, 90), 0) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.packed(rows, 100, group=200).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    used, least = check(out, 100)
    assert used <= 1.1 * least
    stuck = rows.selectExpr("doc_id", "piece", "start", "60L as length", "ids_crc32")  # no two fit together
    assert check(packing.packed(stuck, 100, group=200).collect(), 100)[0] == 3000
    assert packing.packed(rows.limit(0), 100).count() == 0
