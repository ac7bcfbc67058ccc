"""Registered queries of groups, splits, folds, thresholds and trained scores."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokewise.functions.rounding import rounded
from strokewise.operators import calibrate, clusters, density, evaluate, features, scorers, splits, study
from strokewise.plans.catalog import EV, SCORED, query, scored, trace
from strokewise.plans.records import six
from strokewise.sources.adapters import table

#: Documents as labelled rows: some of unknown persons, some made from a person's.
LABELLED = """lb AS (SELECT doc_id, CASE WHEN toxic=1 THEN 'bot' WHEN toxic=0 THEN 'human' END label, CASE WHEN doc_id%4=0 THEN NULL WHEN doc_id%9=0 THEN '' ELSE source END participant, CASE WHEN doc_id%3=0 THEN 'gan' WHEN doc_id%3=1 THEN lang END family, CASE WHEN doc_id%5<>0 THEN 'v'||(doc_id%5) END generator FROM documents LEFT JOIN labels USING (doc_id))"""
_60 = lambda salt, c: f"CAST('0x'||substr(sha256('{salt}:'||{c}),1,15) AS BIGINT)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "bot").when(F.col("toxic") == 0, "human").alias("label"),
        F.when(d % 4 == 0, None).when(d % 9 == 0, "").otherwise(F.col("source")).alias("participant"),
        F.when(d % 3 == 0, "gan").when(d % 3 == 1, F.col("lang")).alias("family"),
        F.when(d % 5 != 0, F.concat(F.lit("v"), (d % 5).cast("string"))).alias("generator"),
    )


@query(f"""WITH {LABELLED} SELECT doc_id, CASE WHEN participant<>'' AND (label='human' OR (label='bot' AND family='gan')) THEN 'human::'||participant WHEN label='bot' THEN 'bot::'||coalesce(nullif(generator,''),'unknown_gen')||'::'||coalesce(nullif(family,''),'unknown_family') ELSE 'attempt::'||doc_id END key,
CASE WHEN label='human' THEN CASE WHEN trim(participant)<>'' THEN 'human::'||participant END ELSE 'bot::'||coalesce(nullif(family,''),'unknown_family')||'::'||coalesce(nullif(generator,''),'unknown_generator') END calibration_key FROM lb""")
def leakage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", splits.leakage_key(ident="doc_id").alias("key"), calibrate.group_key().alias("calibration_key"))


@query("""SELECT source, batch, count(*) n FROM (SELECT source, CAST(('0x'||substr(sha256(CAST(doc_id AS VARCHAR)),1,16))::UBIGINT%12 AS INT) batch FROM documents) GROUP BY 1,2""")
def bot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each family dealt into twelve batches by their id's hash."""
    return table(spark, sf_dir, "documents").select("source", splits.batch_of(F.col("doc_id"), 12).alias("batch")).groupBy("source", "batch").agg(F.count("*").alias("n"))


GROUPED = f"""{SCORED}, sz AS (SELECT human, user_id, count(*) n FROM a GROUP BY 1,2), sb AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY human ORDER BY {_60('split', 'user_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)/sum(n) OVER (PARTITION BY human) d FROM sz),
sp AS (SELECT *, CASE WHEN d<0.7 THEN 'train' WHEN d<0.85 THEN 'val' ELSE 'test' END part FROM sb)"""


@query(f"WITH {GROUPED} SELECT attempt_id, part FROM a JOIN sp USING (user_id)")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons whole in one part, 70, 15 and 15 of a hundred rows within each label."""
    return splits.proportional(scored(spark, sf_dir), "user_id", "human").select("attempt_id", "part")


@query(f"""WITH {GROUPED}, e AS (SELECT part, count(DISTINCT user_id) "groups", count(*) "rows", count(*) FILTER (a.human) humans, count(*) FILTER (NOT a.human) bots FROM a JOIN sp USING (user_id) GROUP BY 1) SELECT part, "rows", "groups", humans, bots, round("rows"/sum("rows") OVER (),6) share FROM e""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parts hold, once no person is found in two."""
    rows = splits.assert_whole(splits.proportional(scored(spark, sf_dir), "user_id", "human"), "user_id")
    return six(splits.manifest(rows, "user_id", "human"), "part", "rows", "groups", "humans", "bots")


@query(f"""WITH {SCORED}, r AS (SELECT attempt_id, CASE WHEN human THEN 'human' ELSE 'f'||(user_id%2) END s, CASE WHEN human THEN user_id ELSE user_id*100+ano%12 END g, human AND user_id%5=0 anon FROM a), gs AS (SELECT DISTINCT s, g FROM r WHERE NOT anon), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_60('local', 'g')})-1 i, count(*) OVER (PARTITION BY s) n FROM gs),
p AS (SELECT *, greatest(1,CAST(round_even(n*0.15,0) AS INT)) q FROM o) SELECT attempt_id, CASE WHEN anon THEN 'train' WHEN i>=n-q THEN 'test' WHEN i>=n-2*q THEN 'val' ELSE 'train' END part FROM r LEFT JOIN p ON NOT anon AND p.s=r.s AND p.g=r.g""")
def local_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known persons by person, unknown ones only for training, bots by batch within their family."""
    h, u = F.col("human"), F.col("user_id")
    rows = scored(spark, sf_dir).withColumns({"s": F.when(h, "human").otherwise(F.concat(F.lit("f"), (u % 2).cast("string"))), "g": F.when(h, u).otherwise(u * 100 + F.col("ano") % 12)})
    return splits.allocated(rows, "g", "s", always=h & (u % 5 == 0)).select("attempt_id", "part")


FOLDS = f"""{SCORED}, fz AS (SELECT human, user_id, count(*) n FROM a GROUP BY 1,2), fo AS (SELECT human h2, user_id, CAST(least(4,floor((coalesce(sum(n) OVER w,0)+n/2)*5/sum(n) OVER (PARTITION BY human))) AS INT) fold FROM fz WINDOW w AS (PARTITION BY human ORDER BY {_60('fold', 'user_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fs AS (SELECT a.*, fold FROM a JOIN fo USING (user_id)), cd AS (SELECT DISTINCT score c FROM fs UNION SELECT 0.5),
fr AS (SELECT c, k, count(*) FILTER (score<c)/count(*) r FROM cd, (SELECT score, unnest(['all','f'||fold,'u'||user_id]) k FROM fs WHERE human) GROUP BY 1,2), ok AS (SELECT c, max(r) FILTER (k='all') pooled, max(r) FILTER (k[1]='f') per_fold, max(r) FILTER (k[1]='u') per_person FROM fr GROUP BY 1)"""
_PICK = lambda test: f"(SELECT coalesce(max(c) FILTER ({test}), min(c)) FROM ok)"


@query(f"""WITH {FOLDS}, t AS (SELECT 'pooled' rule, {_PICK("pooled<=0.05")} t UNION ALL SELECT 'every_fold', {_PICK("pooled<=0.05 AND per_fold<=0.05")} UNION ALL SELECT 'every_person', {_PICK("per_person<=0.05")})
SELECT rule, round(t,6) threshold, round((SELECT avg((score<t)::INT) FROM a WHERE human),6) human_rejected, round((SELECT avg((score<t)::INT) FROM a WHERE NOT human),6) bot_recall FROM t""")
def bounded_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholds that keep all humans, those of each fold, and each person within a budget; all from one table of counts."""
    rows = calibrate.folds(scored(spark, sf_dir), "user_id", "human", 5)
    held = calibrate.counts(rows, "human", "score", "fold", "user_id")
    rule = lambda name, **how: calibrate.threshold(held, 0.05, **how).withColumn("rule", F.lit(name))
    out = rule("pooled").union(rule("every_fold", per=(("fold",),))).union(rule("every_person", pooled=False, per=(("user_id",),)))
    return six(out, "rule")


@query(f"""WITH {FOLDS}, al AS (SELECT fold, c, count(*) FILTER (human AND score<c)/count(*) FILTER (human) r FROM fs, cd GROUP BY 1,2), mine AS (SELECT DISTINCT fold, score c FROM fs UNION SELECT DISTINCT fold, 0.5 FROM fs), st AS (SELECT fold, max(c) FILTER (r<=0.05) t FROM al JOIN mine USING (fold, c) GROUP BY 1)
SELECT fold, count(*) FILTER (human) humans, count(*) FILTER (NOT human) bots, count(DISTINCT user_id) FILTER (human) human_groups, count(DISTINCT user_id) FILTER (NOT human) bot_groups, round(any_value(t),6) standalone_threshold, round(count(*) FILTER (human AND score<0.1)/count(*) FILTER (human),6) human_rejected, round(count(*) FILTER (NOT human AND score<0.1)/count(*) FILTER (NOT human),6) bot_recall FROM fs JOIN st USING (fold) GROUP BY 1""")
def fold_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold at a shared threshold, and the threshold that it would have chosen alone."""
    rows = calibrate.folds(scored(spark, sf_dir), "user_id", "human", 5)
    held = calibrate.counts(rows, "human", "score", "fold", "user_id")
    return six(calibrate.fold_report(rows, held, 0.05, 0.1, group="user_id"), "fold", "humans", "bots", "human_groups", "bot_groups")


_STEPS = "[" + ",".join(repr(0.80 + i * (0.999 - 0.80) / 119) for i in range(120)) + "]"


@query(f"""WITH {SCORED}, gl AS (SELECT quantile_cont(score, {_STEPS}) cuts FROM a WHERE human), g AS (SELECT i, cuts[i+1] cut FROM gl, range(120) t(i)), p AS (SELECT i, cut, user_id, avg((score>cut)::INT) r, count(*) FILTER (score>cut) k, count(*) n FROM g, a WHERE human GROUP BY 1,2,3),
o AS (SELECT i, cut FROM p GROUP BY 1,2 HAVING sum(k)<=0.03*sum(n) AND max(r)<=0.2) SELECT round(coalesce((SELECT min_by(cut,i) FROM o),(SELECT quantile_cont(score,0.97) FROM a WHERE human)),6) cut, round((SELECT 0.80+min(i)*(0.999-0.80)/119 FROM o),6) quantile""")
def density_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest cut beyond which lie few enough of all humans, and of each."""
    return six(evaluate.density_cut(scored(spark, sf_dir).where("human"), "user_id", "score", each=0.2))


@query(f"""WITH {EV}, d AS (SELECT *, sum((kind='pointerdown')::INT) OVER (PARTITION BY user_id ORDER BY ano, seq) drag, kind='pointerup' up FROM ev), r AS (SELECT *, coalesce(sum(up::INT) OVER (PARTITION BY user_id, drag ORDER BY ano, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) rel FROM d WHERE drag>0),
g AS (SELECT user_id, drag, count(*) n, count(*) FILTER (kind='pointermove') m, bool_or(up) c FROM r WHERE rel=0 GROUP BY 1,2 HAVING bool_or(up) OR count(*)>1), s AS (SELECT user_id, count(*) k, count(*) FILTER (m<2) st, quantile_cont(CASE WHEN m>=2 THEN (n*37+m*11)%100/100.0 END,0.5) md FROM g GROUP BY 1)
SELECT user_id, k drag_count, st starved_drags, round(CASE WHEN k=st THEN 0 ELSE md END,6) human_score, CASE WHEN k<>st AND md>=0.5 THEN 'human' ELSE 'bot' END prediction, CASE WHEN k=st THEN 'every_drag_below_move_floor' END reason FROM s""")
def drag_session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by the median of their drags' (stand-in) scores; drags of too few moves have no say."""
    from strokewise.operators import segments

    drags = segments.drags(trace(spark, sf_dir)).withColumn("score", (F.col("n_events") * 37 + F.col("n_moves") * 11) % 100 / 100.0)
    return segments.session_scores(drags, "user_id").withColumn("human_score", rounded(F.col("human_score")))


VIEWS = {"movement": ("avg_speed", "max_speed", "speed_std", "linearity", "direction_changes", "pause_ratio"), "rhythm": ("interval_cv", "duplicate_interval_ratio", "pause_count", "y_deviation")}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of attempts, with the label of their person."""
    rows = trace(spark, sf_dir)
    people = rows.groupBy("attempt_id").agg(F.first("user_id").alias("user_id")).withColumn("human", F.col("user_id") % 3 != 0)
    return features.basic(rows).join(features.intervals(rows), "attempt_id", "left").join(people, "attempt_id")


def bundle(spark: SparkSession, sf_dir: str, folds: int = 3, kind: str = "random_forest", trees: int = 20, depth: int = 5) -> tuple[scorers.Bundle, DataFrame]:
    """A fitted bundle whose threshold comes from out-of-fold scores, and the rows it was fitted on.

    Features are kept while the fits read them again and again; so are counts of
    out-of-fold scores and the humans' density, which thresholds and quantiles read several times.
    """
    rows = calibrate.folds(_features(spark, sf_dir), "user_id", "human", folds).persist(StorageLevel.MEMORY_AND_DISK)
    size = {"trees": trees, "depth": depth}

    def fit(train: DataFrame, fold: int):
        made = {v: scorers.fit(train, f, kind, seed=42 + fold, **size) for v, f in VIEWS.items()}

        def score(held: DataFrame) -> DataFrame:
            for v, f in VIEWS.items():
                held = scorers.probability(held, made[v], f, f"_{v}")
            return held.withColumn("score", rounded(F.least(*[f"_{v}" for v in VIEWS]))).drop(*[f"_{v}" for v in VIEWS])

        return score

    scores = calibrate.out_of_fold(rows, folds, fit).select("attempt_id", "user_id", "human", "fold", "score")
    held = calibrate.counts(scores, "human", "score", "fold").persist(StorageLevel.MEMORY_AND_DISK)
    chosen = calibrate.threshold(held, 0.05, per=(("fold",),)).first()["threshold"]
    models = {v: scorers.fit(rows, f, kind, **size) for v, f in VIEWS.items()}
    veto = density.fit(rows.where("human"), tuple(n for f in VIEWS.values() for n in f), sample=5_000, trees=100)
    near = veto.scored(rows.where("human").select("attempt_id", *veto.names), "d").select("d").persist(StorageLevel.MEMORY_AND_DISK)
    floor = evaluate.quantiles(near, "d", [0.02]).first()["q0"]
    near.unpersist()
    held.unpersist()
    return scorers.Bundle(models, VIEWS, float(chosen), kind, "v1", veto=veto, veto_below=float(floor)), rows


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts scored by a trained bundle: the least of two views, vetoed where no humans are; checked in the tests."""
    made, rows = bundle(spark, sf_dir)
    return scorers.scored(rows, made).select("attempt_id", "human_score", "bot_risk_score", "prediction", "bot_decision")


def density_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How dense the human region is around each vector; compared with plain numpy in the tests."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(8)])
    made = density.fit(rows.where("label < 5"), tuple(f"e{i}" for i in range(8)), ident="vec_id", sample=2_000, trees=100)
    return six(made.scored(rows.select("vec_id", *made.names), "density").select("vec_id", "density"), "vec_id")


@query("""WITH a AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'allow' WHEN 'O' THEN 'step_up' ELSE 'step_up_and_rate_limit' END act, o_totalprice>200000 ok FROM orders), g AS (SELECT act, count(*) n, count(*) FILTER (ok) p FROM a GROUP BY 1)
SELECT sum(n)::BIGINT total, sum(n) FILTER (act<>'allow')::BIGINT would_step_up, round(sum(n) FILTER (act<>'allow')/sum(n),6) would_step_up_rate, string_agg(act||':'||n||':'||p||':'||(n-p), ';' ORDER BY act) actions FROM g""")
def shadow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy would have done with all outcomes, and how they ended."""
    rows = table(spark, sf_dir, "orders").withColumn("act", F.when(F.col("o_orderstatus") == "F", "allow").when(F.col("o_orderstatus") == "O", "step_up").otherwise("step_up_and_rate_limit"))
    out = evaluate.shadow_totals(rows, "act", F.col("o_totalprice") > 200000)
    text = F.array_join(F.transform("actions", lambda a: F.concat_ws(":", a["action"], a["n"].cast("string"), a["passed"].cast("string"), a["failed"].cast("string"))), ";")
    return out.select("total", "would_step_up", "would_step_up_rate", text.alias("actions"))


@query(f"""WITH {LABELLED}, r AS (SELECT lb.*, CASE WHEN doc_id%13=0 THEN NULL ELSE 'owner' END ls, CASE WHEN doc_id%50=0 THEN '0.9' WHEN doc_id%7=0 THEN NULL ELSE '1.0' END v, CASE WHEN doc_id%100=1 THEN NULL ELSE n_chars END f1, CASE WHEN doc_id%90=2 THEN 'NaN'::DOUBLE ELSE n_chars/7.0 END f2 FROM lb JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (label='human') hs, count(*) FILTER (label='bot') bs, count(DISTINCT CASE WHEN label='human' AND participant<>'' THEN participant END) hp, count(DISTINCT CASE WHEN label='bot' AND family<>'' THEN family END) bf, count(*) FILTER (ls IS NULL) lm, count(*) FILTER (v<>'1.0') sm, count(*) FILTER (f1 IS NULL)+count(*) FILTER (f2 IS NULL OR isnan(f2)) bc FROM r)
SELECT hs human_samples, bs bot_samples, hp human_participants, bf bot_families, lm label_source_missing, sm schema_mismatch, bc bad_cells, round(greatest(hs,bs)/nullif(least(hs,bs),0),4) imbalance, concat_ws(';', CASE WHEN hs<500 THEN 'human_samples:'||(500-hs) END, CASE WHEN bs<500 THEN 'bot_samples:'||(500-bs) END, CASE WHEN hp<10 THEN 'human_participants:'||(10-hp) END, CASE WHEN bf<3 THEN 'bot_families:'||(3-bf) END, CASE WHEN sm>0 THEN 'schema_mismatch:'||sm END, CASE WHEN bc>0 THEN 'bad_cells:'||bc END) missing FROM c""")
def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether labelled documents would be enough to train on, and what they lack."""
    d = F.col("doc_id")
    rows = labelled(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "label", "participant", "family", F.when(d % 13 != 0, "owner").alias("label_source"), F.when(d % 50 == 0, "0.9").when(d % 7 != 0, "1.0").alias("feature_schema_version"), F.when(d % 100 != 1, F.col("n_chars")).alias("f1"), F.when(d % 90 == 2, float("nan")).otherwise(F.col("n_chars") / 7.0).alias("f2")
    )
    out = evaluate.readiness(rows, ("f1", "f2"), "1.0")
    return out.select("human_samples", "bot_samples", "human_participants", "bot_families", "label_source_missing", "schema_mismatch", "bad_cells", "imbalance", F.concat_ws(";", "missing").alias("missing"))


def weak_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of vectors among the weak half; checked for the same labels under any partitioning in the tests."""
    rows = table(spark, sf_dir, "embeddings").where("label >= 5").select("vec_id", (F.col("label") / 10.0).alias("score"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(6)])
    made = clusters.clusters(rows, tuple(f"e{i}" for i in range(6)), 4, "vec_id")
    return six(clusters.summary(made, "score", 0.7, ("e0", "e1")), "cluster", "count", "passed")


@query(f"""WITH {SCORED}, n AS (SELECT *, user_id%3 fold FROM (SELECT *, user_id%7>3 rep FROM a)), c AS (SELECT DISTINCT score c FROM n UNION SELECT 0.5 UNION SELECT 1.0), v AS (SELECT c, count(*) FILTER (NOT rep AND score>=c)/count(*) FILTER (NOT rep) f, count(*) FILTER (rep AND score>=c)/count(*) FILTER (rep) r FROM c, n GROUP BY 1),
w AS (SELECT c, max(f) worst FROM (SELECT c, fold, count(*) FILTER (NOT rep AND score>=c)/count(*) FILTER (NOT rep) f FROM c, n GROUP BY 1,2) GROUP BY 1), k AS (SELECT 'pooled' rule, c, f, r FROM v WHERE f<=0.1 UNION ALL SELECT 'every_fold', c, f, r FROM v JOIN w USING (c) WHERE f<=0.1 AND worst<=0.1)
SELECT rule, round(c,6) threshold, round(r,6) replay_recall, round(f,6) human_flagged FROM k QUALIFY row_number() OVER (PARTITION BY rule ORDER BY k.r DESC, k.c DESC)=1""")
def replay_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which similarity on attempts are called replays, within a budget of humans, of all or of each fold."""
    rows = scored(spark, sf_dir).withColumns({"rep": F.col("user_id") % 7 > 3, "fold": F.col("user_id") % 3})
    rule = lambda name, fold: study.replay_threshold(rows, "rep", "score", 0.1, fold).withColumn("rule", F.lit(name))
    return six(rule("pooled", None).union(rule("every_fold", "fold")), "rule")


@query(f"""WITH {SCORED}, c AS (SELECT limit_, (SELECT avg((ano>=limit_)::INT) FROM a) f FROM range(1,200) t(limit_)) SELECT min(limit_) "limit", round(min_by(f,limit_),6) human_flagged FROM c WHERE f<=0.05""")
def attempt_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest number of earlier attempts that few enough humans reach."""
    return six(study.rate_limit(scored(spark, sf_dir), "ano", 0.05), "limit")


@query(f"""WITH {SCORED}, b AS (SELECT *, 'm'||(user_id%5) model, CASE WHEN user_id%2=0 THEN 'replay_warp' ELSE 'f'||(ano%3) END family FROM a), t AS (SELECT model, avg((score<0.001+user_id%5*0.004)::INT) FILTER (human) hr, avg((score<0.97)::INT) FILTER (NOT human) br, avg(other) f1, avg(ano) ms FROM b GROUP BY 1),
f AS (SELECT model, family, avg((score<0.98)::INT) FILTER (NOT human) br, avg((score<0.001)::INT) FILTER (human) hr FROM b GROUP BY 1,2), e AS (SELECT model, ano%2=0 fresh, avg((score>=0.95)::INT) FILTER (NOT human) asr FROM b GROUP BY 1,2),
g AS (SELECT t.model, greatest(t.hr,(SELECT max(hr) FROM f WHERE f.model=t.model)) whr, t.hr, 1-t.br ka, coalesce(greatest((SELECT max(1-br) FROM f WHERE f.model=t.model),(SELECT max(asr) FROM e WHERE e.model=t.model)),1) wu, coalesce((SELECT max(1-br) FROM f WHERE f.model=t.model AND family='replay_warp'),1) ra, coalesce((SELECT min(br) FROM f WHERE f.model=t.model),0) lr, coalesce((SELECT avg(br) FROM f WHERE f.model=t.model),0) mr, (SELECT max(asr) FROM e WHERE e.model=t.model AND fresh) fa, f1, ms FROM t),
h AS (SELECT *, ka<=0.05 AND wu<=0.1 AND ra<=0.05 ex FROM g WHERE whr<=0.03)
SELECT row_number() OVER (ORDER BY ex DESC, wu, ka, mr DESC, f1 DESC, ms NULLS LAST, model) place, model, ex experiment, ex AND hr<=0.03 AND coalesce(fa<=0.05,false) shadow, ex AND hr<=0.01 AND coalesce(fa<=0.05,false) deployment, round(whr,6) worst_human_rejected, round(ka,6) known_asr, round(wu,6) worst_unseen_asr, round(ra,6) replay_asr, round(lr,6) least_recall, round(mr,6) mean_recall FROM h""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stand-in models by gates, worst unseen bots and recall."""
    rows = scored(spark, sf_dir).withColumns({"model": F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")), "family": F.when(F.col("user_id") % 2 == 0, "replay_warp").otherwise(F.concat(F.lit("f"), (F.col("ano") % 3).cast("string")))})
    of = lambda side, test: F.avg(F.when(F.col("human") == F.lit(side), test.cast("double")))
    tests = rows.groupBy("model").agg(of(True, F.col("score") < 0.001 + F.col("user_id") % 5 * 0.004).alias("human_rejected"), of(False, F.col("score") < 0.97).alias("bot_recall"), F.avg("other").alias("f1"), F.avg("ano").alias("ms"))
    families = rows.groupBy("model", "family").agg(of(True, F.col("score") < 0.001).alias("human_rejected"), of(False, F.col("score") < 0.98).alias("bot_recall"))
    external = rows.groupBy("model", (F.col("ano") % 2 == 0).alias("fresh")).agg(of(False, F.col("score") >= 0.95).alias("asr"))
    return six(study.ranked_models(tests, families, external).withColumn("place", F.col("place").cast("long")), "place", "model", "experiment", "shadow", "deployment")


@query(f"""WITH {SCORED}, al AS (SELECT DISTINCT user_id code, user_id%10 person FROM a WHERE user_id%4=1) SELECT coalesce(person,user_id) person, count(*) n, count(DISTINCT user_id) codes FROM a LEFT JOIN al ON code=user_id GROUP BY 1""")
def people_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by the person behind their code."""
    rows = scored(spark, sf_dir)
    aliases = rows.where("user_id % 4 = 1").select(F.col("user_id").alias("code"), (F.col("user_id") % 10).alias("person"))
    return study.people(rows, aliases, "user_id").groupBy("person").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("codes"))


for _f in (model_scores, density_scores, weak_clusters):
    query()(_f)
