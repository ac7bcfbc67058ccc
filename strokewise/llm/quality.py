"""Quality rules as a short-circuit cascade.

Every rule needs some measures of the text.  On a bounded sample each measure
is timed beyond a job that measures nothing, and which rules fail together is
counted.  Rules are then ordered step by step: the next one is that which
rejects most of what is left for the cost of the measures that it adds.  A text
that fails one rule is not shown to the later ones.  Measures are bound where a rule first needs them, so a
text that is rejected early never pays for the dear ones.  The order changes
the cost and which rule is named, never which documents are kept.

Native: column expressions only.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import SPACE, let, occurrences, words
from ._tables import written
from ._text import free_name

#: Documents in the sample on which costs are estimated.
SAMPLE = 2_000
#: Symbols that count.
SYMBOLS = "#*$%&|<>"

Env = dict[str, Column]


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(SPACE.replace("[", "[^")))


def _windows(w: Column) -> Column:
    """A hash of each run of three words."""
    n = F.size(w)
    return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def _covered(hashes: Column) -> Column:
    """How many words stand in a window that occurs twice or more: windows are sorted by hash, those with an equal neighbour back by place."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == b["h"], F.lit(False))
        flagged = F.transform(s, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["i"]))
        return F.sort_array(F.array_compact(flagged))

    def summed(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, lambda s: let(repeated(s), summed)))


#: name -> (measures it is made of, how)
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[Env], Column]]] = {
    "words": (("text",), lambda e: words(e["text"])),
    "n_words": (("words",), lambda e: F.size(e["words"]).cast("long")),
    "word_chars": (("text",), lambda e: F.char_length(F.translate(e["text"], " \t\n\x0b\x0c\r", "")).cast("long")),
    "n_symbols": (("text",), lambda e: occurrences(e["text"], SYMBOLS).cast("long")),
    "n_shouts": (("text",), lambda e: occurrences(e["text"], "!").cast("long")),
    "n_upper": (("text",), lambda e: F.char_length(F.regexp_replace(e["text"], r"\P{Lu}+", "")).cast("long")),
    "lines": (("text",), lambda e: _lines(e["text"])),
    "n_lines": (("lines",), lambda e: F.size(e["lines"]).cast("long")),
    "n_dup_lines": (("lines",), lambda e: (F.size(e["lines"]) - F.size(F.array_distinct(e["lines"]))).cast("long")),
    "windows": (("words",), lambda e: _windows(e["words"])),
    "n_repeat_words": (("windows",), lambda e: _covered(e["windows"]).cast("long")),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    fails: Callable[[Env], Column]


#: The first two are the base; the others are set so wide that running text in any script passes.
RULES = (
    Rule("short", ("n_words",), lambda e: e["n_words"] < 50),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda e: 100 * e["n_repeat_words"] > 50 * e["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda e: 100 * e["n_symbols"] > 40 * e["n_words"]),
    Rule("shouting", ("n_words", "n_shouts"), lambda e: 100 * e["n_shouts"] > 40 * e["n_words"]),
    Rule("capitals", ("word_chars", "n_upper"), lambda e: 100 * e["n_upper"] > 60 * e["word_chars"]),
    Rule("word length", ("n_words", "word_chars"), lambda e: (e["word_chars"] < 2 * e["n_words"]) | (e["word_chars"] > 20 * e["n_words"])),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda e: (e["n_lines"] >= 5) & (100 * e["n_dup_lines"] > 50 * e["n_lines"])),
)


def bind(names: tuple[str, ...], env: Env, body: Callable[[Env], Column]) -> Column:
    """body with these measures; those that aren't there yet are computed once."""
    missing = next((n for n in names if n not in env), None)
    if missing is None:
        return body(env)
    needs, make = MEASURES[missing]
    return bind(needs, env, lambda e: let(make(e), lambda v: bind(names, e | {missing: v}, body)))


def verdict(rules: tuple[Rule, ...], env: Env) -> Column:
    """The name of the first rule that fails, or null; later rules aren't evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    first, *rest = rules
    return bind(first.needs, env, lambda e: F.when(first.fails(e), F.lit(first.name)).otherwise(verdict(tuple(rest), e)))


def _seconds(few: DataFrame, columns: list[Column], runs: int = 2) -> float:
    """Of a job that computes these columns of the sample; the least of some runs."""
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        few.agg(F.count("*"), *[F.bit_xor(F.xxhash64(c)) for c in columns]).first()
        took.append(time.perf_counter() - began)
    return min(took)


def costs(few: DataFrame, env: Env) -> dict[str, float]:
    """What each measure takes beyond those that it is made of."""
    nothing = _seconds(few, [env["text"]])
    own, whole = {}, {"text": 0.0}
    for name, (needs, _) in MEASURES.items():
        whole[name] = max(0.0, _seconds(few, [bind((name,), env, lambda e, n=name: e[n])]) - nothing)
        own[name] = max(whole[name] - max(whole[x] for x in needs), 1e-4)
    return own


def _all_needs(names: tuple[str, ...]) -> set[str]:
    out: set[str] = set()
    for n in names:
        if n in MEASURES:
            out |= {n} | _all_needs(MEASURES[n][0])
    return out


def by_rejection_per_cost(rules: tuple[Rule, ...], failing: list[tuple[tuple[bool, ...], int]], cost: dict[str, float]) -> tuple[Rule, ...]:
    """failing: which rules a text fails, and how many such texts there are."""
    left, bound, out = list(range(len(rules))), set(), []
    while left:
        rejected = {i: sum(n for f, n in failing if f[i]) for i in left}
        price = {i: sum(cost[m] for m in _all_needs(rules[i].needs) - bound) + 1e-4 for i in left}
        best = max(left, key=lambda i: (rejected[i] / price[i], -price[i], -i))
        left.remove(best)
        out.append(rules[best])
        bound |= _all_needs(rules[best].needs)
        failing = [(f, n) for f, n in failing if not f[best]]
    return tuple(out)


def ordered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, seed: int = 7) -> tuple[Rule, ...]:
    """The rules by rejection per cost, as estimated on at most about `sample` documents."""
    total = docs.count()
    if not total:
        return rules
    few = written(docs.sample(min(1.0, sample / total), seed).select(F.coalesce(F.col(text), F.lit("")).alias("t")), "quality-sample")
    env = {"text": F.col("t")}
    flags = [bind(r.needs, env, r.fails).alias(f"f{i}") for i, r in enumerate(rules)]
    failing = [(tuple(bool(x) for x in r[:-1]), r[-1]) for r in few.select(*flags).groupBy(*[f"f{i}" for i in range(len(rules))]).count().collect()]  # 2**rules rows at most
    return by_rejection_per_cost(rules, failing, costs(few, env))


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "rejected_by") -> tuple[DataFrame, str]:
    """The documents with one more column: the rule that rejects each, null for those to keep.

    Null and empty texts have no words and fail the length rule.  Rows are
    judged one by one, so repeated ones agree; an empty table stays empty.  The
    column's name gets underscores where it clashes; it is returned.
    """
    name = free_name(name, docs.columns)
    order = ordered(docs, text, rules)
    return docs.withColumn(name, verdict(order, {"text": F.coalesce(F.col(text), F.lit(""))})), name


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects; all columns as they were.  Null and empty texts are rejected; repeated rows stay or go together."""
    out, name = judged(docs, text)
    return out.where(F.col(name).isNull()).drop(name)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def digest(docs: DataFrame) -> DataFrame:
    order = ordered(docs)
    env = {"text": F.coalesce(F.col("text"), F.lit(""))}
    found = bind(STATS, env, lambda e: F.struct(*[e[s].alias(s) for s in STATS], verdict(order, e).alias("rule")))
    rows = docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *STATS, failed.alias("base_failed"), (~failed & F.col("rule").isNull()).alias("kept"))


def brute_force(rows: list[tuple]) -> dict:
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)}, for tests."""
    import re
    from collections import Counter

    out = {}
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^ \t-\r]+", t)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        out[d] = (len(w), sum(map(len, w)), sum(c in SYMBOLS for c in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
    return out
