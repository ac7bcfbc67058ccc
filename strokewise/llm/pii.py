"""Personal data by weak supervision.

Candidates are spans of a wide pattern for each kind.  Labelers vote on each:
its strict form (regex), a check of its content, gazetteers of known parts, the
words around it, and what it touches.  Votes are for, against or none.  How
often each combination of votes occurs is counted over all documents; from
these counts expectation-maximisation estimates each labeler's reliability and
each combination's probability.  Those probabilities label a bounded sample of
candidates, on which a logistic classifier of votes, shape and context words is
trained.  It decides on every candidate; spans of the base definition stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import written
from ._text import free_name

#: Candidates on which the classifier is trained, at most about.
TRAIN = 20_000
ACCEPT = 0.5
CONTEXT_BUCKETS = 64
AROUND = 40

#: The kinds and their base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches in time that grows with the text alone: an address starts where its run of digits does, and no run is given up bit by bit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
#: What can stand before an @ (and it), and what must stand after it.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++(@?)")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
KINDS = (*BASE, "iban", "ssn")
#: Candidates that the base doesn't hold: spelled-out addresses (from their @ on), phones without a plus, account and insurance numbers.
WIDE = {
    "email": re.compile(r"(?i)\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[a-z0-9-]{2,}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[a-z]{2,}+)++(?!\w)"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-][0-9]{3,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
}
#: Gazetteers of ends of domains, calling codes and country codes.
DOMAINS = frozenset("com net org edu gov info biz io de fr es it uk us eu ch at nl be pl pt se no dk fi ie jp cn in br mx ca au ru".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
#: Words that speak for a kind, and words that speak against any.
FOR = {
    "email": {"mail", "email", "e-mail", "contact", "write", "correo", "courriel", "an", "from", "to"},
    "ip": {"ip", "host", "server", "address", "client", "login", "adresse"},
    "card": {"card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono", "whatsapp", "sms"},
    "iban": {"iban", "account", "konto", "bank", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "insurance"},
}
AGAINST = {"version", "isbn", "issn", "doi", "order", "invoice", "serial", "part", "no", "number", "page", "pages", "pp", "vol", "section", "score", "release", "build"}
N_LABELERS = 5


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _checked(kind: str, found: str) -> bool:
    """The base definition's (or the kind's own) check of a whole match."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in found.split("."))
    if kind == "card":
        d = digits(found)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits(found)) <= 15
    if kind == "iban":
        s = found.replace(" ", "")
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "ssn":
        return found[:3] not in ("000", "666") and found[0] != "9" and found[4:6] != "00" and found[7:] != "0000"
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The base pattern's matches: each run of what can stand before an @ is looked at once, its domain once."""
    at = 0
    while m := _LOCAL.search(text, at):
        at = m.end()
        if m[1] and (domain := _DOMAIN.match(text, at)):
            at = domain.end()
            yield m.start(), at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the base definition's matches, in this order."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for k, (kind, pattern) in enumerate((("ip", _IP), ("card", _CARD), ("phone", BASE["phone"])), 1):
        if kind == "phone" and "+" not in text:
            continue
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _checked(kind, m[0])]
    return out


_BEFORE_AT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _wide_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind's place, start, end) of the wide patterns' matches."""
    for kind, pattern in WIDE.items():
        k, done = KINDS.index(kind), 0
        for m in pattern.finditer(text):
            start = m.start()
            if kind == "email":
                while start > done and text[start - 1] in _BEFORE_AT:
                    start -= 1
                if m.start() - start < 2 or start and (text[start - 1].isalnum() or text[start - 1] in "._"):
                    continue
                done = m.end()
            yield k, start, m.end()


def _votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """1 for, 0 against, 2 none, of each labeler."""
    found = text[start:end]
    strict = 1 if kind not in BASE or BASE[kind].fullmatch(found) else 2
    check = int(_checked(kind, found))
    known = 2
    if kind == "email":
        known = int(re.split(r"[^A-Za-z]+", found.lower())[-1] in DOMAINS)
    elif kind == "phone" and found[0] == "+":
        known = int(digits(found).startswith(CALLING))
    elif kind == "iban":
        known = int(found[:2] in COUNTRIES)
    elif kind == "card":
        known = int(found[0] in "3456")
    elif kind == "ip":
        known = int(found.split(".")[0] not in ("0",))
    near = set(re.findall(r"[\w-]+", text[max(0, start - AROUND) : start].lower())[-4:])
    context = 1 if near & FOR[kind] else 0 if near & AGAINST else 2
    touched = text[start - 1 : start] + text[end : end + 1]
    edge = 0 if re.search(r"[\w@/#=-]", touched) else 2
    return [strict, check, known, context, edge]


def _context(text: str, start: int) -> int:
    w = re.findall(r"\w+", text[max(0, start - AROUND) : start].lower())
    return sum(ord(c) * 31**i for i, c in enumerate(w[-1][-8:])) % CONTEXT_BUCKETS if w else 0


CANDIDATE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end", "votes", "base", "shape", "context")])
FOUND = T.ArrayType(CANDIDATE)


def candidates(text: str) -> list[tuple]:
    base = base_spans(text)
    out = [(k, s, e, 1) for k, s, e in base]
    starts, ends = [], []  # of the text that base spans cover
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for k, s, e in _wide_spans(text):
        i = bisect_left(starts, e)  # covered runs from here on begin too late
        if not i or ends[i - 1] <= s:
            out.append((k, s, e, 0))
    rows = []
    for k, s, e, b in out:
        code = 0
        for v in _votes(KINDS[k], text, s, e):
            code = code * 3 + v
        share = len(digits(text[s:e])) * 4 // (e - s)
        rows.append((k, s, e, code, b, min(7, (e - s) // 6) * 8 + share, _context(text, s)))
    return rows


def _decode(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3 ** (N_LABELERS - 1 - i) % 3 for i in range(N_LABELERS)], axis=1)


def reliabilities(kinds: np.ndarray, codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each combination of votes, P(vote | class) of each labeler), by expectation-maximisation over counts."""
    votes, n = _decode(codes), counts.astype(float)
    table = np.empty((2, N_LABELERS, 3))
    table[1], table[0] = (0.1, 0.6, 0.3), (0.5, 0.2, 0.3)  # [class, labeler, vote]: labelers start out better than chance
    prior = np.full(len(KINDS), 0.7)
    p = np.zeros(len(n))
    for _ in range(rounds):
        logs = np.log(table[:, np.arange(N_LABELERS), votes]).sum(axis=2)
        odds = logs[1] - logs[0] + np.log(prior / (1 - prior))[kinds]
        p = 1 / (1 + np.exp(-odds))
        for c, w in ((1, n * p), (0, n * (1 - p))):
            for i in range(N_LABELERS):
                own = np.bincount(votes[:, i], w, 3) + np.array([1.0, 1.0, 1.0]) * (2 if c else 4) * np.array([(0.5, 0.2, 0.3), (0.1, 0.6, 0.3)][c])
                table[c, i] = own / own.sum()
        for k in range(len(KINDS)):
            at = kinds == k
            prior[k] = (n[at] @ p[at] + 7) / (n[at].sum() + 10)
    return p, table


def _features(kind: np.ndarray, code: np.ndarray, shape: np.ndarray, context: np.ndarray) -> np.ndarray:
    n = len(kind)
    x = np.zeros((n, 1 + len(KINDS) + 3 * N_LABELERS + 64 + CONTEXT_BUCKETS))
    x[:, 0] = 1
    rows, at = np.arange(n), 1
    x[rows, at + kind] = 1
    at += len(KINDS)
    votes = _decode(code)
    for i in range(N_LABELERS):
        x[rows, at + 3 * i + votes[:, i]] = 1
    at += 3 * N_LABELERS
    x[rows, at + shape] = 1
    x[rows, at + 64 + context] = 1
    return x


def fitted(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic classifier with soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - q) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, train: int = TRAIN, seed: int = 11) -> tuple[DataFrame, str]:
    """The kept columns of each document and an array of structs kind, start, end (code points), base, p.

    Ordered by kind (as in KINDS), then start.  Null and empty texts have none.
    Rows are searched one by one and none is merged, so repeated rows agree;
    ties of overlapping candidates are all kept.  The column's name gets
    underscores where it clashes.
    """
    keep = list(keep if keep is not None else docs.columns)
    name = free_name("pii", [*keep, text])
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(FOUND)
        names = CANDIDATE.names
        for batch in batches:
            where = batch.schema.names
            found = [[dict(zip(names, c, strict=True)) for c in candidates(t or "")] for t in batch.column(where.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(where.index(c)) for c in keep], pa.array(found, kind)], names=[*keep, name])

    carried = [c for c in keep if c != text]
    rows = written(docs.select(*carried, text).mapInArrow(run, T.StructType([*fields, T.StructField(name, FOUND)])), "pii")
    each = rows.select(F.explode(name).alias("c")).select("c.*")
    seen = each.groupBy("kind", "votes").count().collect()  # kinds x 3**labelers rows at most
    weights = np.zeros(1 + len(KINDS) + 3 * N_LABELERS + 64 + CONTEXT_BUCKETS)
    if seen:
        kinds, codes, counts = (np.array([r[i] for r in seen]) for i in range(3))
        p, _ = reliabilities(kinds, codes, counts)
        label = {(k, c): v for k, c, v in zip(kinds.tolist(), codes.tolist(), p.tolist(), strict=True)}
        some = each.select("kind", "votes", "shape", "context").sample(min(1.0, train / counts.sum()), seed).collect()  # about `train` rows
        if some:
            m = np.array(sorted(map(tuple, some)))
            weights = fitted(_features(*m.T), np.array([label[k, c] for k, c in m[:, :2].tolist()]))

    out_type = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("p", T.DoubleType())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(out_type)
        for batch in batches:
            where = batch.schema.names
            column = batch.column(where.index(name))
            flat = column.flatten()
            parts = {f: flat.field(f).to_numpy(zero_copy_only=False) for f in ("kind", "votes", "shape", "context")} if len(flat) else None
            p = iter((1 / (1 + np.exp(-np.clip(_features(*parts.values()) @ weights, -30, 30)))).tolist() if parts else [])
            made = []
            for found in column.to_pylist():
                own = [(c["kind"], c["start"], c["end"], bool(c["base"]), q) for c, q in zip(found, [next(p) for _ in found], strict=True)]
                made.append([{"kind": KINDS[k], "start": s, "end": e, "base": b, "p": q} for k, s, e, b, q in sorted(own) if b or q >= ACCEPT])
            yield pa.RecordBatch.from_arrays([*[batch.column(where.index(c)) for c in keep], pa.array(made, kind)], names=[*keep, name])

    return rows.mapInArrow(judge, T.StructType([*fields, T.StructField(name, out_type)])), name


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; all other columns as they were.

    length: a column that is set to the new text's number of code points where something was replaced.
    """
    out, name = find(docs, text)
    pieces = F.aggregate(
        F.array_sort(F.col(name), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"])),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(F.col(text)))),
    )
    out = out.withColumn(text, F.when(F.size(name) > 0, pieces).otherwise(F.col(text)))
    if length:
        out = out.withColumn(length, F.when(F.size(name) > 0, F.char_length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.drop(name)


def digest(docs: DataFrame) -> DataFrame:
    rows, name = find(docs, keep=["doc_id"])
    spans = F.col(name)
    count = lambda kind: F.size(F.filter(spans, lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.filter(spans, lambda x: x["base"])), 256).alias("base_sha256"), joined(spans).alias("spans"))

