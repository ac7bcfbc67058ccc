"""Evaluation of decisions: metrics, separations, thresholds, splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strokewise.functions.rounding import rounded

from .running import running


def share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def confusion(rows: DataFrame, human: str = "human", predicted: str = "predicted") -> DataFrame:
    """One row: counts, accuracy, precision, recall and F1 of humans, share of humans rejected and of bots caught."""
    h, p = F.col(human), F.col(predicted)
    c = rows.agg(F.count_if(h & p).alias("tp"), F.count_if(~h & p).alias("fp"), F.count_if(h & ~p).alias("fn"), F.count_if(~h & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(fn, tp + fn).alias("human_rejected"), share(tn, fp + tn).alias("bot_recall"))


def score_counts(rows: DataFrame, human: str, score: str) -> DataFrame:
    """(score, humans, bots) for each distinct score: what the curves need, however many rows there are."""
    return rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(human)).alias("humans"), F.count_if(~F.col(human)).alias("bots"))


def rank_auc(rows: DataFrame, human: str, score: str) -> DataFrame:
    """(auc, folded_auc): ties count half; null without humans or bots.  Ranks come from counts per score, by a running sum over distinct scores.

    Rows without a score have no say.
    """
    c = running(score_counts(rows, human, score), "score", {"below": "bots"})
    wins = c.select((F.col("humans") * (F.col("below") + F.col("bots") / 2.0)).alias("w"), "humans", "bots").agg(F.sum("w").alias("w"), F.sum("humans").alias("h"), F.sum("bots").alias("b"))
    auc = F.try_divide(F.col("w"), F.col("h") * F.col("b"))
    return wins.select(auc.alias("auc"), F.greatest(auc, 1 - auc).alias("folded_auc"))


def average_precision(rows: DataFrame, human: str, score: str) -> DataFrame:
    """(average_precision): precision at each distinct score, weighted by the humans that it adds."""
    c = running(score_counts(rows, human, score), "score", {"h": "humans", "b": "bots"}, descending=True)
    h, b = F.col("h") + F.col("humans"), F.col("b") + F.col("bots")
    return c.agg(F.sum(F.col("humans") * h / (h + b)).alias("s"), F.sum("humans").alias("n")).select(share(F.col("s"), F.col("n")).alias("average_precision"))


def quantile_rows(rows: DataFrame, value: str, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, quantile): exact quantiles, linear between ranks, of each group's values; i numbers ``at``, and nulls have no rank.

    From counts per value and their running sums over ranges, so that no task
    holds a group's values; a value passes on only the ranks that it takes.
    """
    held = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    totals = held.groupBy(*by).agg(F.sum("_c").alias("_n")).withColumnsRenamed({b: f"_of_{b}" for b in by})
    ranked = running(held, "_v", {"_below": "_c"}, by=by)
    if by:
        same = F.lit(True)
        for b in by:
            same = same & F.col(b).eqNullSafe(F.col(f"_of_{b}"))
        ranked = ranked.join(totals, same)
    else:
        ranked = ranked.crossJoin(F.broadcast(totals))  # one row
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)])
    mine = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_c"))
    place = lambda p: (F.col("_n") - 1) * p["q"]
    taken = F.filter(asked, lambda p: mine(F.floor(place(p))) | mine(F.ceil(place(p))))
    each = ranked.select(*by, "_v", "_n", "_below", "_c", F.explode(taken).alias("p"))
    on = lambda f: F.max(F.when(mine(f(place(F.col("p")))), F.col("_v")))
    out = each.groupBy(*by, F.col("p.i").alias("i")).agg(on(F.floor).alias("_l"), on(F.ceil).alias("_h"), F.max(place(F.col("p"))).alias("_p"))
    return out.select(*by, "i", (F.col("_l") + (F.col("_h") - F.col("_l")) * (F.col("_p") - F.floor("_p"))).alias("quantile"))


def quantiles(rows: DataFrame, value: str, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, q0, q1, ...): the same, with a column for each of ``at``; one row even for no values without ``by``."""
    each = quantile_rows(rows, value, at, by).groupBy(*by)
    return each.agg(*[F.max(F.when(F.col("i") == i, F.col("quantile"))).alias(f"q{i}") for i in range(len(at))])


def separation(rows: DataFrame, human: str, features: list[str]) -> DataFrame:
    """(feature, difference): standardised difference of means of humans and bots."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    each = rows.select(human, named.alias("f")).select(human, "f.*").groupBy("feature").agg(*[f(F.when(F.col(human) == F.lit(side), F.col("v"))).alias(f"{n}{int(side)}") for side in (True, False) for n, f in (("mean", F.avg), ("var", F.var_pop))])
    spread = F.sqrt((F.col("var1") + F.col("var0")) / 2)
    return each.select("feature", F.when(spread > 0, (F.col("mean1") - F.col("mean0")) / spread).otherwise(0.0).alias("difference"))


def summary(rows: DataFrame, key: str, score: str, passes: float) -> DataFrame:
    p = quantiles(rows, score, [0.25, 0.5, 0.75], (key,)).withColumnsRenamed({key: "_k", "q0": "p25", "q1": "p50", "q2": "p75"})
    out = rows.groupBy(key).agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg((F.col(score) >= passes).cast("double")).alias("pass_rate"), F.count("*").alias("n"))
    return out.join(p, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "n", "low", "p25", "p50", "p75", "high", "pass_rate")


def wilson(rows: DataFrame, hits: str, n: str, z: float = 1.959963984540054) -> DataFrame:
    """The rows with the bounds of the score interval of hits / n."""
    p, m = F.col(hits) / F.col(n), F.col(n).cast("double")
    centre, spread = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return rows.withColumns({"wilson_low": F.greatest(centre - spread, F.lit(0.0)), "wilson_high": F.least(centre + spread, F.lit(1.0))})


def anomaly_percentile(rows: DataFrame, reference: DataFrame, score: str) -> DataFrame:
    """Each row's share of reference scores that are not greater, by a running sum over distinct scores of both."""
    ref = reference.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    both = ref.unionByName(rows.select(F.col(score).alias("s"), F.lit(0).cast("long").alias("n")).distinct()).groupBy("s").agg(F.sum("n").alias("n"))
    ranked = running(both, "s", {"below": "n"}).crossJoin(F.broadcast(ref.agg(F.sum("n").alias("all"))))  # one row
    return rows.join(ranked, rows[score] == ranked["s"]).select(*rows.columns, ((F.col("below") + F.col("n")) / F.col("all")).alias("percentile"))


def salted_split(rows: DataFrame, group: str, salt: str, parts: tuple[tuple[str, float], ...]) -> DataFrame:
    """The rows with the part that their whole group belongs to, by a salted hash; groups never straddle parts."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("long") / float(1 << 32)
    edge, choice = 0.0, None
    for name, size in parts:
        edge += size
        choice = F.when(bucket < edge, name) if choice is None else choice.when(bucket < edge, name)
    return rows.withColumn("part", choice.otherwise(parts[-1][0]))


#: Queries that tasks hold at a time, and queries and rows whose distances they do.
QUERY_BLOCK = 4_096
NEAR_QUERIES, NEAR_ROWS = 256, 1_024


def matrix(vectors: pa.Array) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def keep_nearest(best: np.ndarray, ids: np.ndarray, q: np.ndarray, others: np.ndarray, v: np.ndarray) -> None:
    """Lowers each query's smallest squared distances, in place, by those to other rows; some of them at a time, however many there are."""
    k = best.shape[1]
    for i in range(0, len(q), NEAR_QUERIES):
        own = slice(i, i + NEAR_QUERIES)
        for j in range(0, len(v), NEAR_ROWS):
            part = v[j : j + NEAR_ROWS]
            d = np.maximum((q[own] * q[own]).sum(1)[:, None] + (part * part).sum(1)[None] - 2 * q[own] @ part.T, 0)
            d[ids[own, None] == others[None, j : j + NEAR_ROWS]] = np.inf
            best[own] = np.partition(np.concatenate([best[own], d], axis=1), k - 1, axis=1)[:, :k]


def nearest(queries: DataFrame, rows: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(ident, mean_distance) of each query to its k nearest others among all rows, exactly.

    Queries go to the tasks in blocks of bounded size; a task compares a block
    with its rows by matrix products, some of each at a time, and keeps each
    query's k best, so k distances a query and task are shuffled.
    """
    spark = rows.sparkSession
    numbered = queries.select(F.col(ident).alias("i"), F.col(vector).alias("u"))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    made = None
    for b in range(blocks):
        own = numbered.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toArrow()  # about QUERY_BLOCK rows
        if not len(own):
            continue
        shared = spark.sparkContext.broadcast((own["i"].to_numpy(), matrix(own["u"].combine_chunks())))

        def compare(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = np.full((len(ids), k), np.inf)
            for batch in batches:
                keep_nearest(best, ids, q, batch.column(0).to_numpy(), matrix(batch.column(1)))
            row, col = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(np.sqrt(best[row, col]))], names=["i", "d"])

        found = rows.select(ident, vector).mapInArrow(compare, T.StructType([T.StructField("i", rows.schema[ident].dataType), T.StructField("d", T.DoubleType())]))
        made = found if made is None else made.union(found)
    if made is None:
        return queries.select(ident, F.lit(None).cast("double").alias("mean_distance"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d"))  # k rows of each task
    return made.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(F.col("i").alias(ident)).agg(F.avg("d").alias("mean_distance"))


def distribution(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, feature, mean, p05, p10, p50, p90, p95)."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    at = (5, 10, 50, 90, 95)
    flat = rows.select(key, named.alias("f")).select(key, "f.*")
    p = quantiles(flat, "v", [x / 100 for x in at], (key, "feature")).withColumnsRenamed({key: "_k", "feature": "_f", **{f"q{i}": f"p{x:02d}" for i, x in enumerate(at)}})
    out = flat.groupBy(key, "feature").agg(F.avg("v").alias("mean"))
    return out.join(p, F.col(key).eqNullSafe(F.col("_k")) & (F.col("feature") == F.col("_f")), "left").select(key, "feature", "mean", *[f"p{x:02d}" for x in at])


def policy_summary(rows: DataFrame, score: str, hard: float, step_up: float) -> DataFrame:
    """What fixed thresholds let pass, step up and reject."""
    s = F.col(score)
    count = {"model_bot_risk_count": s < hard, "step_up_band_count": (s >= hard) & (s < step_up), "direct_auto_allow_count": s >= step_up}
    rate = {"hard_model_asr": s >= hard, "direct_auto_allow_asr": s >= step_up, "step_up_rate": s < step_up}
    return rows.agg(F.count("*").alias("rows"), *[F.avg(c.cast("double")).alias(n) for n, c in rate.items()], *[F.count_if(c).alias(n) for n, c in count.items()])


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n) over explicit edges: bin i holds edges[i-1] <= value < edges[i]; 0 and len(edges) are what lies outside."""
    return rows.groupBy(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def recurrence(runs: DataFrame, run: str, human: str, features: list[str]) -> DataFrame:
    """(feature, runs, higher, lower, mean_difference): in how many runs a feature separates, and which way."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    each = runs.select(run, human, named.alias("f")).select(run, human, "f.*").groupBy(run, "feature").agg((F.avg(F.when(F.col(human), F.col("v"))) - F.avg(F.when(~F.col(human), F.col("v")))).alias("d"))
    return each.where("d is not null").groupBy("feature").agg(F.count("*").alias("runs"), F.count_if(F.col("d") > 0).alias("higher"), F.count_if(F.col("d") < 0).alias("lower"), F.avg("d").alias("mean_difference"))


def worst_group(rows: DataFrame, group: str, failed: Column) -> DataFrame:
    """(groups, worst, mean) of each group's share of failures."""
    each = rows.groupBy(group).agg(F.avg(failed.cast("double")).alias("rate"))
    return each.agg(F.count("*").alias("groups"), F.max("rate").alias("worst"), F.avg("rate").alias("mean"))


def session_scores(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(key, n, lowest, median, trimmed, p25, mean) of a session's drag scores; trimmed is the median without the worst, p25 excludes the ends."""
    out = rows.groupBy(key).agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(score)).alias("s"), F.avg(score).alias("mean"))  # a session has few drags
    middle = lambda a, n: (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
    j, delta = F.floor((F.col("n") + 1) / 4).cast("int"), (F.col("n") + 1) % 4
    p25 = F.when(F.col("n") >= 4, (F.get("s", j - 1) * (4 - delta) + F.get("s", j) * delta) / 4).otherwise(F.get("s", F.lit(0)))
    trimmed = F.when(F.col("n") <= 2, middle(F.col("s"), F.col("n"))).otherwise(middle(F.slice("s", 2, 1 << 30), F.col("n") - 1))
    return out.select(key, F.col("n").cast("long").alias("n"), F.get("s", F.lit(0)).alias("lowest"), middle(F.col("s"), F.col("n")).alias("median"), trimmed.alias("trimmed"), p25.alias("p25"), "mean")


def band(rows: DataFrame, value: str, low: float = 0.015, high: float = 0.985) -> DataFrame:
    """(low, high, outside): a two-sided band of the values and the share beyond it."""
    edges = quantiles(rows, value, [low, high]).withColumnsRenamed({"q0": "low", "q1": "high"})
    return rows.crossJoin(F.broadcast(edges)).groupBy("low", "high").agg(F.avg(((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).cast("double")).alias("outside"))  # one row of edges


def common_point(rows: DataFrame, score: str, rejected: float) -> DataFrame:
    """(threshold, n): the score at place floor(n * rejected) of the sorted ones, from counts per score."""
    counts = rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    at = F.floor(F.col("n") * F.lit(rejected))
    placed = running(counts, "score", {"below": "c"}).crossJoin(F.broadcast(total))  # one row
    return placed.where((F.col("below") <= at) & (at < F.col("below") + F.col("c"))).select(F.col("score").alias("threshold"), "n")


def density_cut(distances: DataFrame, person: str, distance: str, pooled: float = 0.03, each: float = 0.05, fallback: float = 0.97) -> DataFrame:
    """(cut, quantile): the strictest of 120 quantiles of the distances, from 0.8 to 0.999, beyond which lie few enough of all and of each person; else the fallback quantile and null."""
    steps = [0.80 + i * (0.999 - 0.80) / 119 for i in range(120)]
    known = distances.where(F.col(distance).isNotNull())
    cuts = quantile_rows(known, distance, [*steps, fallback])  # 121 rows
    held = known.groupBy(F.col(person).alias("_p")).agg(F.count("*").alias("n"))
    # the cuts that a distance lies beyond are the first ones: a row for each person and number of cuts
    one = cuts.where(F.col("i") < len(steps)).agg(F.array_sort(F.collect_list("quantile")).alias("_cuts"))
    beyond = known.crossJoin(F.broadcast(one)).select(F.col(person).alias("_q"), F.size(F.filter("_cuts", lambda c: F.col(distance) > c)).alias("k"))  # one row of cuts
    beyond = beyond.groupBy("_q", "k").agg(F.count("*").alias("c"))
    over = beyond.where("k > 0").select("_q", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).groupBy("_q", "i").agg(F.sum("c").alias("c"))
    found = over.join(held, F.col("_q").eqNullSafe(F.col("_p"))).groupBy("i").agg(F.sum("c").alias("c"), F.max(F.col("c") / F.col("n")).alias("worst"))
    total = held.agg(F.sum("n").alias("all"))
    grid = cuts.join(F.broadcast(found), "i", "left").crossJoin(F.broadcast(total))  # 120 rows, and one
    ok = (F.col("i") < len(steps)) & (F.coalesce("c", F.lit(0)) <= pooled * F.col("all")) & (F.coalesce("worst", F.lit(0.0)) <= each)
    best = grid.agg(F.min(F.when(ok, F.col("i"))).alias("i"), F.min_by("quantile", F.when(ok, F.col("i"))).alias("cut"), F.max(F.when(F.col("i") == len(steps), F.col("quantile"))).alias("rest"))
    return best.select(F.when(F.col("i").isNotNull(), F.col("cut")).otherwise(F.col("rest")).alias("cut"), F.get(F.array(*[F.lit(x) for x in steps]), F.col("i")).alias("quantile"))


def shadow_totals(outcomes: DataFrame, action: str, passed: Column) -> DataFrame:
    """One row: outcomes, those that would not have been allowed, and their share; the parts by action as an array in order."""
    each = outcomes.groupBy(F.col(action).alias("action")).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"))
    one = F.struct("action", "n", "passed", (F.col("n") - F.col("passed")).alias("failed"), rounded(F.col("passed") / F.col("n")).alias("pass_rate"))
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.coalesce(F.col("action") != "allow", F.lit(True)), F.col("n"))), F.lit(0)).alias("would_step_up"), F.array_sort(F.collect_list(one)).alias("actions"))  # a few actions
    return out.withColumn("would_step_up_rate", rounded(share(F.col("would_step_up"), F.col("total"))))


#: Rows and groups that training needs.
NEEDED = {"human_samples": 500, "bot_samples": 500, "human_participants": 10, "bot_families": 3}


def readiness(rows: DataFrame, features: tuple[str, ...], version: str, needed: dict[str, int] | None = None) -> DataFrame:
    """One row: whether labelled rows are enough to train on, what there is, and what is missing.

    rows: label, participant, family, label_source, feature_schema_version and
    features.  A feature cell is bad if it is null, no number or not finite.
    """
    needed = needed or NEEDED
    human, bot = F.col("label") == "human", F.col("label") == "bot"
    said = lambda c: F.when(F.col(c) != "", F.col(c))
    bad = lambda c: (F.col(c).cast("double").isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("long")
    cells = sum((bad(f) for f in features if f in rows.columns), F.lit(0).cast("long"))
    found = rows.agg(
        F.count_if(human).alias("human_samples"),
        F.count_if(bot).alias("bot_samples"),
        F.count_distinct(F.when(human, said("participant"))).alias("human_participants"),
        F.count_distinct(F.when(bot, said("family"))).alias("bot_families"),
        F.count_if(said("label_source").isNull()).alias("label_source_missing"),
        F.count_if(F.coalesce(F.col("feature_schema_version") != version, F.lit(False))).alias("schema_mismatch"),
        F.coalesce(F.sum(cells), F.lit(0)).alias("bad_cells"),
    )
    h, b = F.col("human_samples"), F.col("bot_samples")
    lacking = [F.when(F.col(k) < n, F.concat(F.lit(f"{k}:"), (F.lit(n) - F.col(k)).cast("string"))) for k, n in needed.items()]
    lacking += [F.when(F.col(k) > 0, F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in ("schema_mismatch", "bad_cells")]
    out = found.withColumn("imbalance", F.when((h > 0) & (b > 0), rounded(F.greatest(h, b) / F.least(h, b), 4))).withColumn("missing", F.array_compact(F.array(*lacking)))
    return out.withColumns({"ready": F.size("missing") == 0, "participant_split_possible": F.col("human_participants") >= 2, "generator_split_possible": F.col("bot_families") >= 2})
