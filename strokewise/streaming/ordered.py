"""Rules that depend on what came before, on streams whose rows may arrive late.

A key's rows wait in state until the watermark has passed them; then they are
decided in order of time, so the result is that of the batch operators however
rows were shuffled within the allowed lateness.  State is a list of waiting
rows and a map of what the rule remembers, in RocksDB, both with a timer: a
key is forgotten once its rule no longer needs it.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A rule takes one row (as a dict) and what the key remembers (a dict, changed in place) and returns the new columns.
Rule = Callable[[dict, dict], tuple]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with lists, maps and timers needs this store; to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: A key made for dealing out rows; it isn't among the columns of the result.
SHARD = "_shard"


def _ms(at: Any) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class Ordered(StatefulProcessor):
    """Holds rows back until their time has passed, then applies a rule in order."""

    def __init__(self, rule: Rule, columns: list[str], order: list[str], added: list[str], keep_ms: Callable[[dict], int]):
        self.rule, self.columns, self.order, self.added, self.keep_ms = rule, columns, order, added, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("at", T.LongType()), T.StructField("row", T.BinaryType())]))
        self.memory = handle.getValueState("memory", T.StructType([T.StructField("text", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pickle

        first = None
        for batch in rows:
            held = batch.to_dict("records")
            self.waiting.appendList([(_ms(r["at"]), pickle.dumps(r)) for r in held])
            low = min(_ms(r["at"]) for r in held)
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import pickle

        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = [pickle.loads(r) for at, r in held if at < passed]
        rest = [(at, r) for at, r in held if at >= passed]
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        if due:
            due.sort(key=lambda r: (r["at"], *[(r[c] is not None, r[c]) for c in self.order]))
            made = [self.rule(r, memory) for r in due]
            memory["_until"] = max(memory.get("_until", 0), _ms(due[-1]["at"]) + self.keep_ms(memory))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            out = pd.DataFrame({c: [r[c] for r in due] for c in self.columns} | {a: [m[i] for m in made] for i, a in enumerate(self.added)})
        if rest:
            self.handle.registerTimer(min(at for at, _ in rest) + 1)
        elif memory.get("_until", 0) < passed:
            self.memory.clear()
            memory = None
        elif memory:
            self.handle.registerTimer(memory["_until"] + 1)
        if memory:
            self.memory.update((json.dumps(memory),))
        if due:
            yield out

    def close(self) -> None:
        pass


def _apply(stream: DataFrame, key: list[str], rule: Rule, added: list[tuple[str, T.DataType]], keep_ms: Callable[[dict], int], late: str, order: list[str]) -> DataFrame:
    columns = [c for c in stream.columns if c != SHARD]
    schema = T.StructType([*[stream.schema[c] for c in columns], *[T.StructField(n, t) for n, t in added]])
    keys = [F.col(k) for k in key]
    return stream.withWatermark("at", late).groupBy(*keys).transformWithStateInPandas(Ordered(rule, columns, order, [n for n, _ in added], keep_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def seen_recently(prints: DataFrame, value: str, ttl_s: float = 900.0, late: str = "1 hour", order: tuple[str, ...] = (), most: int | None = None, shards: int = 16) -> DataFrame:
    """The rows with whether their value came at most ttl before, in any session; each sight counts anew.  Null values pass as never seen.

    With ``most``, no more values than that are remembered: the value whose
    last sight is longest ago is dropped first, in each of ``shards`` parts of
    the values by itself, so that no task remembers them all.
    """
    ttl = int(ttl_s * 1000)
    share = -(-most // shards) if most else None

    def rule(row: dict, memory: dict) -> tuple:
        now = _ms(row["at"])
        held = OrderedDict(memory.get("held", []))
        while held and now - next(iter(held.values())) > ttl:
            held.popitem(last=False)
        hit = row[value] in held
        held[row[value]] = now
        held.move_to_end(row[value])
        while share and len(held) > share:
            held.popitem(last=False)
        memory["held"] = list(held.items())
        return (hit,)

    known = prints.where(F.col(value).isNotNull())
    unknown = prints.where(F.col(value).isNull()).withColumn("seen", F.lit(False))  # no key for all of them
    if most is None:
        out = _apply(known, [value], rule, [("seen", T.BooleanType())], lambda m: ttl, late, list(order))
        return out.unionByName(unknown)
    dealt = known.withColumn(SHARD, F.pmod(F.xxhash64(value), F.lit(shards)).cast("int"))
    return _apply(dealt, [SHARD], rule, [("seen", T.BooleanType())], lambda m: ttl, late, list(order)).unionByName(unknown)


def consumed(tries: DataFrame, challenges: DataFrame, late: str = "1 hour", order: tuple[str, ...] = ()) -> DataFrame:
    """The tries with reason and accepted: the first valid one consumes its challenge.  tries: challenge, binding, at; challenges (static): challenge, bound, expires.

    A consumed challenge is remembered until it has expired.
    """

    def rule(row: dict, memory: dict) -> tuple:
        if pd.isna(row["expires"]):
            reason = "challenge_not_found"
        elif memory.get("done"):
            reason = "challenge_already_consumed"
        elif row["expires"] <= row["at"]:
            reason = "challenge_expired"
        elif row["binding"] is None or row["binding"] != row["bound"]:
            reason = "challenge_binding_invalid"
        else:
            reason, memory["done"] = "consumed", True
        memory["left"] = 0 if pd.isna(row["expires"]) else max(_ms(row["expires"]) - _ms(row["at"]), 0)
        return reason, reason == "consumed"

    joined = tries.join(challenges, "challenge", "left")
    return _apply(joined, ["challenge"], rule, [("reason", T.StringType()), ("accepted", T.BooleanType())], lambda m: m.get("left", 0), late, list(order))


def trailing(attempts: DataFrame, key: str = "session", window_s: float = 60.0, most: int = 50, late: str = "1 hour", order: tuple[str, ...] = ()) -> DataFrame:
    """The attempts with how many of their session came in the window up to them (its newest ``most`` at most)."""
    width = int(window_s * 1000)

    def rule(row: dict, memory: dict) -> tuple:
        now = _ms(row["at"])
        past = [p for p in memory.get("past", []) if 0 <= now - p <= width][-most:]
        memory["past"] = [*past, now]
        return (len(past),)

    return _apply(attempts, [key], rule, [("recent", T.LongType())], lambda m: width, late, list(order))


#: Reasons for which a batch of a recording is refused.
RECEIPTS = ("session_mismatch", "challenge_consumed", "batch_sequence_gap", "receipt_chain_broken")


def receipt(secret: str, challenge: str, session_hash: str, seq: int, payload: str, previous: str, received: Any) -> str:
    message = "|".join(str(p) for p in (challenge, session_hash, seq, payload, previous, received))
    return hmac.new(secret.encode(), message.encode(), hashlib.sha256).hexdigest()


@dataclass(frozen=True)
class Chain:
    """The rule of a recording's receipts: batches of one session, in sequence, each naming the receipt before, until the recording is verified once."""

    secret: str

    def __call__(self, row: dict, memory: dict) -> tuple:
        digest = lambda *p: hashlib.sha256("|".join(map(str, p)).encode()).hexdigest()
        if "last" not in memory:
            memory.update(session=digest(row["owner"]), last=digest(row["challenge"], row["owner"], "nonce"), n=0, live=True)
        if row["verify"]:
            reason = None if memory["live"] else "nonce_reused"
            memory["live"] = False
            return None, reason
        if digest(row["session"]) != memory["session"]:
            return None, "session_mismatch"
        if not memory["live"]:
            return None, "challenge_consumed"
        if row["seq"] != memory["n"]:
            return None, "batch_sequence_gap"
        if row["previous"] != memory["last"]:
            return None, "receipt_chain_broken"
        memory["last"] = receipt(self.secret, row["challenge"], memory["session"], int(row["seq"]), row["payload"], row["previous"], row["received"])
        memory["n"] += 1
        return memory["last"], None


def receipts(batches: DataFrame, secret: str, late: str = "1 hour", ttl_s: float = 3_600.0, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The batches with their receipt, or the reason why they are refused.

    batches: challenge, owner (the session it was issued to), session, seq,
    previous, payload (a digest), received, verify, at.
    """
    return _apply(batches, ["challenge"], Chain(secret), [("receipt", T.StringType()), ("reason", T.StringType())], lambda m: int(ttl_s * 1000), late, list(order))


#: What each mark adds, what a clean beat that gets on takes away, the highest value and the one from which on a test is due.
STEPS = {"speed_violation": 3, "session_conflict": 5, "checkpoint_exhausted": 4}
CLEAN, TOP, DUE = -1, 30, 10


def suspicion(marks: DataFrame, key: str, mode: str = "record", threshold: int = DUE, late: str = "1 hour", ttl_s: float = 86_400.0, order: tuple[str, ...] = ()) -> DataFrame:
    """The marks with the counter after them, and whether a test is required.

    marks: kind (one of STEPS, ``beat``, ``passed``), advanced (whether a beat
    got on), at.  mode: off counts nothing, record counts, enforce also
    requires the test.  A passed test sets the counter to 0.
    """
    if mode not in ("off", "record", "enforce"):
        mode = "off"

    def rule(row: dict, memory: dict) -> tuple:
        now = memory.get("now", 0)
        if mode != "off":
            if row["kind"] == "passed":
                now = 0
            elif row["kind"] == "beat":
                now = max(0, now + CLEAN) if row["advanced"] else now
            else:
                now = min(TOP, now + STEPS.get(row["kind"], 0))
            memory["now"] = now
        return now, mode == "enforce" and now >= threshold

    return _apply(marks, [key], rule, [("suspicion", T.LongType()), ("required", T.BooleanType())], lambda m: int(ttl_s * 1000), late, list(order))
