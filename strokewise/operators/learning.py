"""Mastery, weak concepts and difficulty bands from answers."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strokewise.functions.rounding import rounded

from .running import running

#: Fixed values of the rules: smoothing, weights, windows and bands.
SMOOTH_CORRECT, SMOOTH_TOTAL, CONFIDENT = 2, 4, 3
WEIGHTS = {"mastery": 0.45, "recent": 0.30, "review": 0.15, "hard": 0.10}
RECENT, SATURATION_DAYS, HARD = 5, 30.0, 0.7
EASY, MEDIUM, MASTERED = 0.4, 0.7, 0.85


def band(x: Column) -> Column:
    return F.when(x < EASY, "easy").when(x < MEDIUM, "medium").otherwise("hard")


def counted(answers: DataFrame, order: list[str], tries: int = 3) -> DataFrame:
    """The first answer of each student and concept within the first tries of a presentation."""
    w = Window.partitionBy("student", "presentation").orderBy(*order)
    within = answers.withColumn("try", F.row_number().over(w)).where(F.col("try") <= tries)
    first = F.row_number().over(Window.partitionBy("student", "presentation", "concept").orderBy("try"))
    return within.withColumn("rank", first).where("rank = 1").drop("rank")


def mastery(answers: DataFrame) -> DataFrame:
    """(student, concept, attempts, correct, mastery, guess, diagnostic_needed), corrected for few answers and for guessing.

    Chances of a lucky guess are added up as decimals, so the last bit of their mean doesn't hang on the order of rows.
    """
    guess = F.coalesce(F.when(F.col("options") >= 2, F.lit(1).cast("decimal(30,25)") / F.col("options").cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,22)")
    out = answers.groupBy("student", "concept").agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"), (F.sum(guess).cast("double") / F.count("*")).alias("guess"))
    observed = (F.col("correct") + SMOOTH_CORRECT) / (F.col("attempts") + SMOOTH_TOTAL)
    value = F.when(F.col("guess") >= 1, observed).otherwise((observed - F.col("guess")) / (1 - F.col("guess")))
    return out.select("student", "concept", "attempts", "correct", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("mastery"), "guess", (F.col("attempts") < CONFIDENT).alias("diagnostic_needed"))


def weak_concepts(answers: DataFrame, now: Column, order: list[str], k: int = 3) -> DataFrame:
    """Each student's k weakest concepts: mastery, recent errors, time since the last answer, hard questions failed."""
    latest = Window.partitionBy("student", "concept").orderBy(*[F.desc(c) for c in order])
    ranked = answers.withColumn("age", F.row_number().over(latest))
    wrong = (~F.col("correct")).cast("double")
    signals = ranked.groupBy("student", "concept").agg(F.avg(F.when(F.col("age") <= RECENT, wrong)).alias("recent"), F.max("answered_at").alias("last"), F.coalesce(F.avg(F.when(F.col("difficulty") >= HARD, wrong)), F.lit(0.0)).alias("hard"))
    review = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(now, F.col("last")) / SATURATION_DAYS))
    rows = mastery(answers).where("not diagnostic_needed").join(signals, ["student", "concept"])
    parts = {"mastery": WEIGHTS["mastery"] * (1 - F.col("mastery")), "recent": WEIGHTS["recent"] * F.col("recent"), "review": WEIGHTS["review"] * review, "hard": WEIGHTS["hard"] * F.col("hard")}
    rows = rows.select("student", "concept", "mastery", *[v.alias(f"w_{n}") for n, v in parts.items()])
    names = [f"w_{n}" for n in parts]
    top = F.greatest(*names)
    reason = F.coalesce(*[F.when(F.col(c) == top, c[2:]) for c in names])
    rows = rows.select("student", "concept", rounded(F.col("mastery"), 4).alias("mastery"), rounded(sum(F.col(c) for c in names), 4).alias("weakness"), reason.alias("reason"), band(F.col("mastery")).alias("target_band"))
    rank = F.row_number().over(Window.partitionBy("student").orderBy(F.desc("weakness"), "concept"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def slip_probability(cancels: Column, failed: Column, regrabs: Column, error_px: Column) -> Column:
    """Mean of the capped signals of a slip; the drop's distance counts only where it is known."""
    capped = lambda c, top: F.least(F.greatest(c, F.lit(0)), F.lit(top)) / float(top)
    three = capped(cancels, 3) + capped(failed, 3) + capped(regrabs, 3)
    return F.bround(F.when(error_px.isNull(), three / 3).otherwise((three + capped(error_px, 60)) / 4), 4)


def outcome(system_error: Column, cancels: Column, grabbed: Column, released: Column, slot: Column, right: Column) -> Column:
    """What an answer's drop means: rules in order, the first that holds counts."""
    return F.when(system_error, "system_error").when((cancels > 0) | grabbed.isNull() | released.isNull(), "operation_error").when(released == slot, F.when(right, "correct").otherwise("concept_error")).otherwise("ambiguous")


#: Which band of difficulty is tried first, second and third for each target.
PREFERENCE = {"easy": ("easy", "medium", "hard"), "medium": ("medium", "easy", "hard"), "hard": ("hard", "medium", "easy")}


def recommended(weak: DataFrame, questions: DataFrame, solved: DataFrame, n: int = 4) -> DataFrame:
    """(student, place, question, concept, target_band): up to n unsolved questions of the weakest concepts.

    weak: student, concept, rank, target_band; questions: question (a number),
    concept, difficulty; solved: student, question.  Within a concept the
    preferred bands come first, and no two hard questions follow one another: of
    a run of hard ones only the first stays, and it is passed over where a hard
    one came last.  So n of each band of a concept suffice, whatever the bank holds.

    Questions are numbered from 1 within their concept and band.  What a student
    has not solved are the gaps between the numbers that are solved: a student
    meets its solved questions and n numbers of each band, never the bank.
    """
    rank = F.lit(3)
    for target, bands in PREFERENCE.items():
        for i, b in enumerate(bands):
            rank = F.when((F.col("target_band") == target) & (F.col("band") == b), i).otherwise(rank)
    held = questions.select("question", "concept", band(F.col("difficulty")).alias("band"), F.lit(1).cast("long").alias("one")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    bank = running(held, "question", {"before": "one"}, by=("concept", "band")).select("question", "concept", "band", (F.col("before") + 1).alias("number"))
    own = weak.select("student", "concept", "rank", "target_band")
    starts = own.join(held.groupBy("concept", "band").agg(F.count("*").alias("size")), "concept").withColumn("number", F.lit(0).cast("long"))
    done = solved.select("student", "question").join(bank, "question").join(own.select("student", "concept"), ["student", "concept"]).drop("question")
    w = Window.partitionBy("student", "concept", "band").orderBy("number")
    rows = starts.unionByName(done, allowMissingColumns=True)
    # a number that occurs twice leaves no gap after the first; the start, number 0, comes first
    rows = rows.withColumns({"solved": F.dense_rank().over(w) - 1, "next": F.lead("number").over(w), **{c: F.first(c).over(w) for c in ("size", "rank", "target_band")}})
    upto = F.least(F.coalesce(F.col("next") - 1, F.col("size")), F.col("solved") + n)
    gaps = rows.where(F.col("number") < upto).select("student", "concept", "rank", "target_band", "band", F.explode(F.sequence(F.col("number") + 1, upto)).alias("number")).withColumn("liking", rank)
    taken = gaps.groupBy("student").agg(F.array_sort(F.collect_list(F.struct("rank", "liking", "number", "concept", "target_band", "band"))).alias("all"))  # 3 n questions of each weak concept
    start = F.struct(F.lit(False).alias("hard"), F.filter("all", lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hard = x["band"] == "hard"
        skip = (F.size(acc["out"]) >= n) | (hard & acc["hard"])
        return F.when(skip, acc).otherwise(F.struct(hard.alias("hard"), F.concat(acc["out"], F.array(x)).alias("out")))

    out = taken.select("student", F.posexplode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("place", "q")).select("student", "place", "q.concept", "q.target_band", "q.band", "q.number")
    return out.join(bank, ["concept", "band", "number"]).select("student", F.col("place").cast("long").alias("place"), "question", "concept", "target_band")


def ready_for_next(rows: DataFrame) -> DataFrame:
    """The mastery rows with whether the student can move on."""
    return rows.withColumn("ready", ~F.col("diagnostic_needed") & (F.col("mastery") >= MASTERED))


def diagnosis_text(weak: DataFrame) -> DataFrame:
    """(student, text): the weak concepts of each student as one line, weakest first."""
    part = F.concat(F.col("concept"), F.lit(" ("), F.col("reason"), F.lit(", "), F.format_string("%.0f", F.col("mastery") * 100), F.lit("%)"))
    return weak.groupBy("student").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "; ").alias("text"))  # three concepts
