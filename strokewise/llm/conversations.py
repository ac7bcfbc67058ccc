"""Chat formatting: quotation linking.

A line's quote level is the number of ``>`` before its text.  Neighbouring
lines of one level are a passage.  Quoted passages are normalised (lower case,
single spaces) and hashed, as a whole, by paragraph and by line; hashes of the
same conversation's earlier messages' own passages, paragraphs and lines are
joined to them, so each quote leads to the latest message that holds all of it.  A message answers the latest message that it quotes
on the first level, else the one before it.  Conversations come out as rows in
reply order, without quotes; no conversation is ever gathered in one task.

Native: column expressions, joins and aggregates only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._columns import let
from ._tables import written

#: Quote marks with white space before them, as much of it as ends them (four or more), and a line that only announces a quote.
MARKS = r"^[\x20\t>]*>"
FAR = r"(?s)[\x20\t]{4,}.*$"
ANNOUNCED = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió):\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def levels(text: Column) -> Column:
    """array<struct<level,line>> of the text's lines, marks taken off."""
    def parsed(line: Column) -> Column:
        marks = F.regexp_replace(F.regexp_extract(line, MARKS, 0), FAR, "")
        n = lambda m: F.char_length(m) - F.char_length(F.translate(m, ">", ""))
        rest = lambda m: F.regexp_replace(F.substring(line, F.char_length(m) + 1, F.char_length(line)), r"^[\x20\t]", "")
        return let(marks, lambda m: F.struct(n(m).alias("level"), rest(m).alias("line")))

    plain = lambda line: F.struct(F.lit(0).alias("level"), line.alias("line"))
    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), lambda line: let(parsed(line), lambda p: F.when(p["level"] > 0, p).otherwise(plain(line))))


def own_text(lines: Column) -> Column:
    """The message without quoted lines and without lines that only announce a quote."""

    def kept(x: Column) -> Column:
        return F.filter(x, lambda y, i: (y["level"] == 0) & ~(y["line"].rlike(ANNOUNCED) & (F.coalesce(F.get(x, i + 1)["level"], F.lit(0)) > 0)))

    return let(lines, lambda x: F.trim(F.regexp_replace(F.array_join(F.transform(kept(x), lambda y: y["line"]), "\n"), "\n{3,}", "\n\n")))


def _hash(run: Column) -> Column:
    """Of some lines' words: the same however the lines are broken.  The salt goes first, else one hash follows from the other."""
    return let(normalised(F.array_join(F.transform(run, lambda y: y["line"]), " ")), lambda s: F.struct(F.xxhash64(F.lit(0), s).alias("a"), F.xxhash64(F.lit(1), s).alias("b")))


def _runs(x: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """The array cut before its first element and each that begins a run."""
    first = F.filter(F.transform(x, lambda y, i: F.when((i == 0) | begins(y, i), i)), lambda i: i.isNotNull())
    return let(first, lambda at: F.transform(at, lambda a, k: F.slice(x, a + 1, F.coalesce(F.get(at, k + 1), F.size(x)) - a)))


_HASH = "struct<a:bigint,b:bigint>"


def passages(lines: Column) -> Column:
    """array<struct<level,hash,paragraphs,lines>> of the runs of lines of one level, empty lines aside: hashes of the whole and of its parts.

    Paragraphs begin after empty lines.
    """

    def full(x: Column) -> Column:
        marked = F.transform(x, lambda y, i: F.struct(y["level"].alias("level"), y["line"].alias("line"), F.coalesce(normalised(F.get(x, i - 1)["line"]) == "", F.lit(False)).alias("new")))
        return F.filter(marked, lambda y: normalised(y["line"]) != "")

    def made(x: Column) -> Column:
        return F.transform(
            _runs(x, lambda y, i: (F.get(x, i - 1)["level"] == y["level"]) == F.lit(False)),
            lambda run: F.struct(
                F.get(run, 0)["level"].alias("level"),
                _hash(run).alias("hash"),
                F.transform(_runs(run, lambda y, i: y["new"]), _hash).alias("paragraphs"),
                F.transform(run, lambda y: _hash(F.array(y))).alias("lines"),
            ),
        )

    return let(let(lines, full), lambda x: F.when(F.size(x) == 0, F.array().cast(f"array<struct<level:int,hash:{_HASH},paragraphs:array<{_HASH}>,lines:array<{_HASH}>>>")).otherwise(made(x)))


def _line_hashes(own: Column) -> Column:
    """Hashes by which a message's own passages can be quoted: each line, each paragraph and each run of lines."""
    return F.array_distinct(F.concat(F.flatten(F.transform(own, lambda p: p["lines"])), F.flatten(F.transform(own, lambda p: p["paragraphs"])), F.transform(own, lambda p: p["hash"])))


def _ways(quote: Column) -> Column:
    """array<struct<way,key>>: a message is a quote's source if it holds all keys of one way (the whole, all paragraphs or all lines)."""
    def way(w: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(w).alias("way"), k.alias("key")))

    none = F.array().cast(f"array<struct<way:int,key:{_HASH}>>")
    parts = [F.when(F.size(quote[c]) > 1, way(w, quote[c])).otherwise(none) for w, c in ((1, "paragraphs"), (2, "lines"))]
    return F.concat(way(0, F.array(quote["hash"])), *parts)


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: its columns, its text without quotes, and where it stands.

    Columns: conv_id, turn, role, text (own words only), n_quotes (quoted
    passages), n_linked (those whose source was found), reply_to (a turn, null
    for roots), root (the thread's first turn), depth.  A message always comes
    after what it answers, so (conv_id, root, turn) is reply order.  Only
    earlier turns of the same conversation are sources; of several the latest
    counts.  Null and empty texts stay as empty messages.  Repeated
    (conversation, turn) rows are all kept and share a place; a row whose
    conversation or turn is null is a root of its own.  Other columns are left out.
    """
    parsed = written(
        messages.select(
            F.col(conv).alias("conv_id"),
            F.col(turn).alias("turn"),
            F.col(role).alias("role"),
            let(levels(F.coalesce(F.col(text), F.lit(""))), lambda x: let(passages(x), lambda all_: F.struct(own_text(x).alias("text"), F.filter(all_, lambda p: p["level"] > 0).alias("quotes"), _line_hashes(F.filter(all_, lambda p: p["level"] == 0)).alias("own")))).alias("m"),
        ).select("conv_id", "turn", "role", "m.*"),
        "messages",
    )
    keyed = parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = keyed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", F.explode(_ways(F.col("q"))).alias("w")).select("conv_id", "turn", "level", "hash", "w.way", "w.key").distinct()
    asked = quotes.select("conv_id", "key").distinct()
    sources = keyed.select("conv_id", "turn", F.explode("own").alias("key")).distinct().join(asked, ["conv_id", "key"], "left_semi")
    found = _holding_all(quotes, sources).groupBy("conv_id", "turn", "level", "hash").agg(F.max("at").alias("at"))
    links = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("at"))).alias("quoted"))
    previous = _latest_before(keyed.select("conv_id", "turn", F.lit(True).alias("source")), ["conv_id"])
    parents = written(previous.join(links, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("quoted", "before").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "parents")
    named = parents.join(_places(parents), ["conv_id", "turn"])
    return parsed.join(named, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("root", "turn").alias("root"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


#: Turns in one block.
BLOCK = 1_024


def _holding_all(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, way, at): the latest earlier turn that holds all of a way's keys, where there is one.

    The keys' latest turns are looked up; where they differ, none later than the
    least of them can hold all, so the next step looks up to that.  A quote is
    never paired with all messages that hold one of its lines.
    """
    one = ["conv_id", "turn", "level", "hash", "way"]
    left, done = quotes.withColumn("below", F.col("turn")), []
    sources = written(sources, "sources")
    while True:
        left = written(left, "quotes")
        marks = sources.select("conv_id", "key", "turn", F.lit(True).alias("source")).union(left.select("conv_id", "key", "below", F.lit(False)))
        latest = _latest_before(marks, ["conv_id", "key"]).withColumnRenamed("turn", "below")
        at = left.join(latest, ["conv_id", "key", "below"])
        ways = written(at.groupBy(*one).agg(F.min("before").alias("at"), F.max("before").alias("top"), F.count("before").alias("n"), F.count("*").alias("keys")).where("n = keys").drop("n", "keys"), "ways")
        done.append(ways.where("at = top").select(*one, "at"))
        more = ways.where("at < top")
        if more.isEmpty():
            return reduce(DataFrame.union, done)
        left = left.drop("below").join(more.select(*one, (F.col("at") + 1).alias("below")), one)


def _latest_before(marks: DataFrame, key: list[str]) -> DataFrame:
    """(key, turn, before) for each turn of a key: the greatest lower turn that is a source.

    Windows run over blocks of turns, never over a whole key: within a block
    over at most BLOCK turns, and over one row per block.
    """
    turns = marks.groupBy(*key, "turn").agg(F.max("source").alias("source")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    at = F.when(F.col("source"), F.col("turn"))
    lower = Window.partitionBy(*key, "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    inside = turns.withColumn("near", F.max(at).over(lower))
    blocks = turns.groupBy(*key, "block").agg(F.max(at).alias("top"))
    earlier = blocks.withColumn("far", F.max("top").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    return inside.join(earlier, [*key, "block"]).select(*key, "turn", F.coalesce("near", "far").alias("before"))


def _places(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) by doubling: in each step a message takes over its ancestor's ancestor, so a chain of n needs log n steps."""
    start = F.col("reply_to").isNull()
    state = written(parents.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("root"), F.when(start, 0).otherwise(1).alias("depth"), start.alias("done")), "places")
    while not state.where(~F.col("done")).isEmpty():
        above = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("over"))
        stepped = state.where(~F.col("done")).join(above, ["conv_id", "root"]).select("conv_id", "turn", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("over").alias("done"))
        state = written(stepped.union(state.where("done")), "places")
    return state.select("conv_id", "turn", "root", "depth")


def digest(messages: DataFrame) -> DataFrame:
    return linked(messages)
