"""Splits of whole groups into parts, with the proof that none straddles two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import PARTS, running

#: Parts and their shares.
SHARES = (("train", 0.70), ("val", 0.15), ("test", 0.15))


class LeakageError(RuntimeError):
    """A group stands in more than one part."""


def hash_order(group: str, salt: str) -> tuple[Column, Column]:
    """(order, part): a salted 60-bit hash of the group, and in which of the even ranges it lies; both need no look at the data.

    Groups of one hash would tie; that is expected first among a billion groups, and then the earlier name counts.
    """
    order = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col(group).cast("string")), 256), 1, 15), 16, 10).cast("long")
    return order, F.floor(F.col("_order") / ((1 << 60) // PARTS))


def leakage_key(label: str = "label", participant: str = "participant", family: str = "family", generator: str = "generator", ident: str = "attempt_id") -> Column:
    """The group of a row: its person, for bots made from a person's traces that person, else the generator and family, else the row alone."""
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    named = lambda c, other: F.when(said(c), F.col(c)).otherwise(F.lit(other))
    person = F.concat_ws("::", F.lit("human"), F.col(participant))
    bot = F.concat_ws("::", F.lit("bot"), named(generator, "unknown_gen"), named(family, "unknown_family"))
    of_person = said(participant) & (F.coalesce(F.col(label) == "human", F.lit(False)) | (F.coalesce(F.col(label) == "bot", F.lit(False)) & F.coalesce(F.col(family) == "gan", F.lit(False))))
    return F.when(of_person, person).when(F.col(label) == "bot", bot).otherwise(F.concat_ws("::", F.lit("attempt"), F.col(ident)))


def batch_of(ident: Column, n: int) -> Column:
    """The batch, 0 to n-1, of a row by its id's hash: the same on every day."""
    digest = F.sha2(ident.cast("string"), 256)
    high, low = (F.conv(F.substring(digest, i, 8), 16, 10).cast("decimal(20,0)") for i in (1, 9))
    return ((high * F.lit(1 << 32).cast("decimal(20,0)") + low) % n).cast("int")


def proportional(rows: DataFrame, group: str, stratum: str | None = None, shares: tuple[tuple[str, float], ...] = SHARES, salt: str = "split") -> DataFrame:
    """The rows with ``part``: groups whole, the parts' shares of rows kept to within one group in each stratum.

    Groups stand in the order of a salted hash; where the rows before a group
    have filled a part's share, the next part begins.  Rows without a group
    are a group of their own together.
    """
    rows = rows.withColumns({"_g": F.coalesce(F.col(group).cast("string"), F.lit("")), "_s": F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")})
    sizes = rows.groupBy("_s", "_g").agg(F.count("*").alias("_n"))
    order, part = hash_order("_g", salt)
    placed = running(sizes.withColumn("_order", order), "_order", {"_before": "_n"}, by=("_s",), part=part)
    totals = sizes.groupBy("_s").agg(F.sum("_n").alias("_all"))
    done = (F.col("_before") / F.col("_all")).cast("double")
    edge, choice = 0.0, None
    for name, size in shares[:-1]:
        edge += size
        test = done < round(edge, 12)
        choice = F.when(test, name) if choice is None else choice.when(test, name)
    chosen = placed.join(totals, "_s").select("_s", "_g", choice.otherwise(shares[-1][0]).alias("part"))
    return rows.join(chosen, ["_s", "_g"]).drop("_s", "_g")


def allocated(rows: DataFrame, group: str, stratum: str, always: Column | None = None, shares: tuple[tuple[str, float], ...] = SHARES, salt: str = "local") -> DataFrame:
    """The rows with ``part`` by numbers of groups: in each stratum the last parts get their share of groups, at least one each, the first the rest.

    ``always`` marks rows of the first part whatever their group; they take no
    place in it.  Strata of fewer groups than parts are an error when read.
    """
    kept = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    rows = rows.withColumn("_kept", kept)
    groups = rows.where("not _kept").groupBy(F.col(stratum).alias("_s"), F.col(group).alias("_g")).agg(F.lit(1).cast("long").alias("_n"))
    order, part = hash_order("_g", salt)
    placed = running(groups.withColumn("_order", order), "_order", {"_before": "_n"}, by=("_s",), part=part)
    totals = groups.groupBy(F.col("_s").alias("_t")).agg(F.count("*").alias("_all"))
    placed = placed.join(totals, F.col("_s").eqNullSafe(F.col("_t")))
    taken, choice = F.lit(0), F.when(F.col("_all") < len(shares), F.raise_error(F.lit(f"each stratum needs {len(shares)} groups")).cast("string"))
    for name, size in reversed(shares[1:]):
        own = F.greatest(F.lit(1), F.bround(F.col("_all") * size).cast("int"))
        taken = taken + own
        choice = choice.when(F.col("_before") >= F.col("_all") - taken, name)
    chosen = placed.select("_s", "_g", choice.otherwise(shares[0][0]).alias("_part"))
    out = rows.join(chosen, ~F.col("_kept") & F.col(stratum).eqNullSafe(F.col("_s")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return out.withColumn("part", F.when(F.col("_kept"), shares[0][0]).otherwise(F.col("_part"))).drop("_s", "_g", "_part", "_kept")


def straddling(rows: DataFrame, group: str, part: str = "part") -> DataFrame:
    """(group, parts) of groups in more than one part."""
    each = rows.where(F.col(group).isNotNull()).groupBy(group, part).count().groupBy(group).agg(F.count("*").alias("parts"))
    return each.where("parts > 1")


def assert_whole(rows: DataFrame, group: str, part: str = "part") -> DataFrame:
    """The rows, once no group is found in two parts."""
    bad = straddling(rows, group, part).limit(5).collect()
    if bad:
        raise LeakageError(f"groups in more than one part: {[r[group] for r in bad]}")
    return rows


def manifest(rows: DataFrame, group: str, human: str, part: str = "part") -> DataFrame:
    """(part, rows, groups, humans, bots, share) of each part."""
    each = rows.groupBy(part, group).agg(F.count("*").alias("n"), F.count_if(F.col(human)).alias("h"))
    out = each.groupBy(part).agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.sum("h").alias("humans"), (F.sum("n") - F.sum("h")).alias("bots"))
    whole = rows.agg(F.count("*").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).select(part, "rows", "groups", "humans", "bots", (F.col("rows") / F.col("_all")).alias("share"))  # one row of a whole
