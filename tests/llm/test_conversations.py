from strokewise.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def made(spark, rows):
    return {(r.conv_id, r.turn): r for r in cv.linked(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_quotes_lead_to_their_sources(spark):
    rows = [
        (1, 0, "user", "First   question here.\nSecond line"),
        (1, 1, "assistant", "An answer.\n\nWith two parts."),
        (1, 2, "user", "X wrote:\n> first question HERE.\nNo, I meant this."),
        (1, 3, "user", "> With two parts.\n>> First question here.\nI see"),
        (1, 4, "user", "> never said\nok"),
        (2, 0, "user", "> With two parts.\nalone"),
    ]
    out = made(spark, rows)
    assert [out[1, t].reply_to for t in range(5)] == [None, 0, 0, 1, 3]
    assert [out[1, t].n_linked for t in range(5)] == [0, 0, 1, 2, 0]
    assert [out[1, t].n_quotes for t in range(5)] == [0, 0, 1, 2, 1]
    assert out[1, 2].text == "No, I meant this." and out[1, 3].text == "I see" and out[1, 1].text == "An answer.\n\nWith two parts."
    assert [out[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3] and {out[1, t].root for t in range(5)} == {0}
    assert out[2, 0].reply_to is None and out[2, 0].text == "alone" and out[2, 0].n_linked == 0


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 4)
    rows = [(7, 3 * t, "user", f"message {t}" + (f"\n> message {t // 2}" if t % 5 == 4 else "")) for t in range(40)]
    out = made(spark, rows)
    depth = {}
    for t in range(40):
        up = None if t == 0 else t // 2 if t % 5 == 4 else t - 1
        depth[t] = 0 if up is None else depth[up] + 1
        assert out[7, 3 * t].reply_to == (None if up is None else 3 * up)
        assert out[7, 3 * t].depth == depth[t] and out[7, 3 * t].root == 0


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, None, None), (1, 0, "user", ""), (None, 1, "user", "x"), (1, None, "user", "> x"), (1, 1, "user", ">")]
    out = cv.linked(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 5
    assert cv.linked(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_one_row_per_message(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = cv.linked(m)
    assert out.count() == m.count()


def test_quotes_of_several_lines_lead_to_their_sources(spark):
    rows = [
        (1, 0, "user", "one a\none b\none c\n\ntwo a\ntwo b\n\nthree"),
        (1, 1, "assistant", "one a\nsomething else"),
        (1, 2, "user", "one b\nand more"),
        (1, 3, "user", "> one a\n> one b\nlines 1 and 2 of 3, each also said later"),
        (1, 4, "user", "> two a two\n> b\na paragraph, broken elsewhere"),
        (1, 5, "user", "> one c\n> ...\nnot all of it was said"),
        (1, 6, "user", "> one b\n>\n> three\nseparate lines"),
        (1, 7, "user", "> one a one\n> b one c\n>\n> three\nparagraphs, broken elsewhere"),
        (1, 8, "user", "> and more\n> something else\nof two messages"),
        (1, 9, "user", "one a\none b"),
        (1, 10, "user", "> one a\n> one b\nthe latest counts"),
    ]
    out = made(spark, rows)
    assert [out[1, t].reply_to for t in range(11)] == [None, 0, 1, 0, 0, 4, 0, 0, 7, 8, 9]
    assert [out[1, t].n_linked for t in range(11)] == [0, 0, 0, 1, 1, 0, 1, 1, 0, 0, 1]
    assert all(out[1, t].n_quotes == (t > 2 and t != 9) for t in range(11))


def test_many_marks_and_long_lines(spark):
    rows = [
        (1, 0, "user", "root line"),
        (1, 1, "user", ">" * 2_000 + " deep\n> root line\nmine"),
        (1, 2, "user", "> " * 100_000 + "\n" + ">" * 1_000_000 + "\n" + " " * 1_000_000 + "\nend"),
        (1, 3, "user", "    > code, not a quote\n>     > one level\n" + "x" * 200 + " wrote:\n> root line\nend"),
        (1, 4, "user", "> line of its own\n" * 3_000),
    ]
    out = made(spark, rows)
    assert out[1, 1].n_linked == 1 and out[1, 1].reply_to == 0 and out[1, 1].text == "mine"
    assert out[1, 2].text.strip() == "end" and out[1, 2].n_quotes == 0
    assert out[1, 3].text == "> code, not a quote\nend" and out[1, 3].n_quotes == 2 and out[1, 3].reply_to == 0
    assert out[1, 4].n_quotes == 1


def brute_force(rows):
    """{(conv, turn): (n_quotes, n_linked, reply_to)} by comparing every quote with every earlier message, line by line."""
    import re

    norm = lambda s: re.sub(r"[ \t-\r]+", " ", s.lower()).strip(" ")

    def runs(text):
        out = []
        for line in (text or "").split("\n"):
            m = re.match(r"((?:[ \t]{0,3}>)+)[ \t]?(.*)$", line)
            level, rest = (m[1].count(">"), m[2]) if m else (0, line)
            if not norm(rest):
                if out:
                    out[-1][2] = True
                continue
            if not out or out[-1][0] != level:
                out.append([level, [[norm(rest)]], False])
            else:
                if out[-1][2]:
                    out[-1][1].append([])
                out[-1][1][-1].append(norm(rest))
            out[-1][2] = False
        return [(level, paragraphs) for level, paragraphs, _ in out]

    join = lambda parts: norm(" ".join(parts))
    got, by_conv = {}, {}
    for c, t, _, text in sorted(rows):
        made_of = runs(text)
        own = set()
        for level, ps in made_of:
            if level == 0:
                own |= {join(sum(ps, []))} | {join(p) for p in ps} | {x for p in ps for x in p}
        seen, linked = set(), []
        for level, ps in made_of:
            if level and (level, join(sum(ps, []))) not in seen:
                seen.add((level, join(sum(ps, []))))
                ways = ([join(sum(ps, []))], [join(p) for p in ps], [x for p in ps for x in p])
                at = max((u for u, keys in by_conv.get(c, []) if any(all(k in keys for k in way) for way in ways)), default=None)
                if at is not None:
                    linked.append((level, at))
        n = sum(1 for level, _ in made_of if level)
        before = max((u for u, _ in by_conv.get(c, [])), default=None)
        reply = max((a for level, a in linked if level == 1), default=before)
        got[c, t] = (n, len(linked), reply)
        by_conv.setdefault(c, []).append((t, own))
    return got


def test_same_as_brute_force(spark):
    import random

    rng = random.Random(4)
    lines = [f"line {i} of it" for i in range(30)]
    rows, said = [], {}
    for c in range(12):
        for t in range(25):
            body = []
            for _ in range(rng.randint(0, 3)):
                body += [rng.choice(lines) for _ in range(rng.randint(1, 3))] + ([""] if rng.random() < 0.5 else [])
            quote = []
            if said.get(c) and rng.random() < 0.7:
                source = rng.choice(said[c])
                a = rng.randrange(len(source) + 1)
                quote = ["> " * rng.choice([1, 1, 2]) + x for x in source[a : a + rng.randint(1, 4)]]
                if rng.random() < 0.3:
                    quote = [" ".join(["> " + " ".join(x.lstrip("> ") for x in quote)])]
            rows.append((c, t, "user", "\n".join(quote + body)))
            said.setdefault(c, []).append(body)
    want = brute_force(rows)
    out = made(spark, rows)
    assert {k: (r.n_quotes, r.n_linked, r.reply_to) for k, r in out.items()} == want
    assert sum(n for _, n, _ in want.values()) > 60
