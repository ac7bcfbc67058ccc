"""Secret scan: known forms, and a battery of randomness tests under false-discovery control.

Long tokens that hold a digit are candidates.  Each one's encoding is inferred
from its characters, which become numbers; three tests ask whether they look
drawn at random: chi-squared uniformity over the encoding's alphabet, the
number of runs above and below its middle, and the correlation of neighbours.
Together they give one p-value under randomness.  Words, paths and counters
pile up near 0; secrets are spread evenly.  For each encoding and band of
lengths the even part is estimated from the upper half of the p-values; the
least threshold is taken at which the expected share of others among the
accepted stays within ``RATE``.  Short tokens, where the tests tell little,
so get a threshold of their own, or none.  Each different token counts once,
however often it is repeated; bands with few tokens take in their neighbours.

Native: column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import blocks, let, matches
from ._tables import written
from ._text import free_name

#: The known forms.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
LONG_ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Alphabets, the first that holds all characters counts.
ALPHABETS = (("dec", "0123456789"), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
#: Lengths from which a new band begins.
BANDS = (20, 28, 40, 64)
BINS = 40
#: The share of false discoveries to stay within, and how many tokens a band needs.
RATE = 0.05
LEAST = 20
#: No token with a lower p-value counts as random, whatever its band's threshold: the rate is one
#: of different tokens, and one that is plainly not random may be repeated without end.
FLOOR = 0.001


def _tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, by a logistic approximation."""
    x = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * x + 0.07056 * x * x * x))


def _chi_z(value: Column, df: Column) -> Column:
    """A chi-squared value as a normal one (cube root)."""
    return (F.cbrt(value / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def randomness(token: Column) -> Column:
    """struct<encoding, p>: the inferred encoding and the battery's p-value under randomness."""
    body = F.regexp_replace(token, "=+$", "")

    def tested(t: Column, name: Column, alphabet: Column) -> Column:
        def battery(v: Column) -> Column:
            sums = F.struct(F.size(v).cast("double").alias("n"), F.char_length(alphabet).cast("double").alias("k"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).alias("mean"))
            return let(sums, lambda m: judged(v, m["n"], m["k"], m["mean"]))

        def judged(v: Column, n: Column, k: Column, mean: Column) -> Column:
            # of each value and its neighbour before: above the middle or not, and how far from the mean
            steps = F.transform(v, lambda x, i: F.struct((x > k / 2).alias("high"), (F.get(v, i - 1) > k / 2).alias("was"), (x - mean).alias("d"), (F.get(v, i - 1) - mean).alias("e")))
            start = F.struct(F.lit(0.0).alias("high"), F.lit(1.0).alias("turns"), F.lit(0.0).alias("total"), F.lit(0.0).alias("lag"))
            added = lambda a, x: F.struct((a["high"] + x["high"].cast("double")).alias("high"), (a["turns"] + F.coalesce((x["high"] != x["was"]).cast("double"), F.lit(0.0))).alias("turns"), (a["total"] + x["d"] * x["d"]).alias("total"), (a["lag"] + F.coalesce(x["d"] * x["e"], F.lit(0.0))).alias("lag"))
            return let(F.aggregate(steps, start, added), lambda a: tail(v, n, k, a["high"], a["turns"], a["total"], a["lag"]))

        def tail(v: Column, n: Column, k: Column, high: Column, turns: Column, total: Column, lag: Column) -> Column:
            # runs of equal values of the sorted array are the counts of the alphabet's characters
            runs = F.aggregate(F.array_sort(v), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("n"), F.lit(0.0).alias("squares")), lambda a, x: F.when(a["last"] == x, F.struct(x.alias("last"), (a["n"] + 1).alias("n"), a["squares"].alias("squares"))).otherwise(F.struct(x.alias("last"), F.lit(1.0).alias("n"), (a["squares"] + a["n"] * a["n"]).alias("squares"))), lambda a: a["squares"] + a["n"] * a["n"])
            chi = F.greatest(_chi_z(k / n * runs - n, k - 1), F.lit(0.0))
            mid = 2 * high * (n - high) / n + 1
            spread = (mid - 1) * (mid - 2) / (n - 1)
            turned = F.when(spread > 0, (turns - mid) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(8.0)
            serial = F.when(total > 0, lag / F.greatest(total, F.lit(1e-9)) * F.sqrt(n)).otherwise(8.0)
            return let(F.struct(chi.alias("chi"), turned.alias("turned"), serial.alias("serial")), lambda z: F.struct(name.alias("encoding"), _tail(_chi_z(z["chi"] * z["chi"] + z["turned"] * z["turned"] + z["serial"] * z["serial"], F.lit(3.0))).alias("p")))

        return let(F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.position(c, alphabet).cast("double")), battery)

    def inferred(t: Column) -> Column:
        out = None
        for name, alphabet in reversed(ALPHABETS):
            made = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))
            out = made if out is None else F.when(F.translate(t, alphabet, "") == "", made).otherwise(out)
        return let(out, lambda a: tested(t, a["name"], a["alphabet"]))

    return let(body, inferred)


def _band(length: Column) -> Column:
    out = F.lit(BANDS[0])
    for b in BANDS[1:]:
        out = F.when(length >= b, b).otherwise(out)
    return out


def thresholds(counts: dict[tuple, dict[int, int]], rate: float = RATE, least: int = LEAST) -> dict[tuple, float]:
    """(encoding, band) -> the p-value from which on tokens count as random; strata that never meet the rate have none.

    counts: (encoding, band) -> bin -> number of different tokens, over all
    documents.  A band with fewer than ``least`` is judged together with as many
    neighbouring bands of its encoding, on both sides, as it takes.
    """
    out = {}
    for encoding, band in counts:
        stratum, at, bins = (encoding, band), BANDS.index(band), {}
        for width in range(len(BANDS)):
            near = [counts.get((encoding, b), {}) for b in BANDS[max(at - width, 0) : at + width + 1]]
            bins = {b: sum(x.get(b, 0) for x in near) for b in range(BINS)}
            if sum(bins.values()) >= least:
                break
        total = sum(bins.values())
        even = min(1.0, 2 * sum(n for b, n in bins.items() if b >= BINS // 2) / total)
        if total < least or even == 0:
            continue
        for b in range(BINS // 2):
            accepted = sum(n for x, n in bins.items() if x >= b)
            if accepted and accepted - even * total * (1 - b / BINS) <= rate * accepted:
                out[stratum] = b / BINS
                break
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rate: float = RATE) -> tuple[DataFrame, str]:
    """The kept columns of each document and an array of structs start, end (code points), kind, base.

    Ordered by start, then kind.  The known forms are all there (base is true);
    random tokens are added where they don't overlap those.  Null and empty
    texts have no spans.  Each row is scanned by itself, so repeated rows agree;
    thresholds come from the p-values of all documents.
    """
    keep = list(keep if keep is not None else docs.columns)
    name = free_name("secrets", keep)
    t = F.coalesce(F.col(text), F.lit(""))
    span = lambda x, k: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))

    def assigned(whole: Column) -> Column:
        values = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
        return F.when(F.size(whole) == 0, F.array().cast("array<struct<start:int,kind:int,end:int>>")).otherwise(
            F.transform(F.filter(F.zip_with(whole, values, lambda w, v: F.struct(w["start"].alias("start"), w["end"].alias("end"), v.alias("v"))), lambda x: F.char_length(x["v"]) >= 6), lambda x: span(x, 0))
        )

    base = F.concat(let(matches(t, ASSIGN), assigned), F.transform(F.filter(matches(t, ACCESS), lambda x: x["end"] - x["start"] >= 20), lambda x: span(x, 1)), F.transform(matches(t, HEX), lambda x: span(x, 2)))
    tokens = F.transform(matches(t, CANDIDATE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["match"]).alias("token"), (x["match"].rlike(HEX) | x["match"].rlike(LONG_ACCESS)).alias("known"), randomness(x["match"]).alias("r")))
    apart = lambda x, b: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))

    def cleared(b: Column) -> Column:
        # access keys and hexadecimal runs that touch a token lie within it
        free = F.filter(tokens, lambda x: ~x["known"])
        assigned_spans = F.filter(b, lambda y: y["kind"] == 0)

        def near(run: Column, spans: Column) -> Column:
            ends = F.struct(F.get(run, 0)["start"].alias("start"), F.element_at(run, -1)["end"].alias("end"))
            return let(let(ends, lambda e: F.filter(spans, lambda y: (y["start"] < e["end"]) & (e["start"] < y["end"]))), lambda some: F.filter(run, lambda x: apart(x, some)))

        return let(free, lambda f: let(assigned_spans, lambda spans: F.when((F.size(f) == 0) | (F.size(spans) == 0), f).otherwise(F.flatten(F.transform(blocks(f), lambda run: near(run, spans))))))

    found = let(F.sort_array(base), lambda b: F.struct(b.alias("base"), cleared(b).alias("tokens")))
    rows = written(docs.select(*keep, found.alias(name)), "secrets")
    each = rows.select(F.explode(F.col(name)["tokens"]).alias("x"))
    once = each.select(F.col("x.r.encoding").alias("e"), _band(F.col("x.end") - F.col("x.start")).alias("b"), F.least(F.floor(F.col("x.r.p") * BINS), F.lit(BINS - 1)).alias("bin"), "x.token").distinct()
    bins = once.groupBy("e", "b", "bin").count()
    counts: dict[tuple, dict[int, int]] = {}
    for r in bins.collect():  # encodings x bands x bins at most
        counts.setdefault((r.e, r.b), {})[r.bin] = r["count"]
    limits = thresholds(counts, rate)

    def accepted(x: Column) -> Column:
        out = F.lit(False)
        for (encoding, band), p in limits.items():
            out = F.when((x["r"]["encoding"] == encoding) & (_band(x["end"] - x["start"]) == band), x["r"]["p"] >= max(p, FLOOR)).otherwise(out)
        return out

    flat = lambda x, base: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(base).alias("base"))
    both = F.concat(F.transform(F.col(name)["base"], lambda x: flat(x, True)), F.transform(F.filter(F.col(name)["tokens"], accepted), lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"), F.lit(False).alias("base"))))
    named = F.transform(F.sort_array(both), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("kind"), x["base"].alias("base")))
    return rows.select(*keep, named.alias(name)), name


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    rows, name = scan(docs, keep=["doc_id"])
    spans = F.col(name)
    count = lambda kind: F.size(F.filter(spans, lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(F.filter(spans, lambda x: x["base"])), 256).alias("base_sha256"), joined(spans).alias("spans"))


def brute_force(rows: list[tuple]) -> dict:
    """{doc_id: (n_assign, n_access, n_hex, base_sha256)}, for tests."""
    import hashlib
    import re

    out = {}
    for d, t in rows:
        t, found = t or "", []
        for m in re.finditer(ASSIGN, t):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end()))
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
        out[d] = (*[sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(text.encode()).hexdigest())
    return out
