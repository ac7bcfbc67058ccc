"""Registered queries of filters, joins, evaluation aggregates, state and learning, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strokewise.functions.rounding import rounded
from strokewise.operators import evaluate, filters, learning, replay, state
from strokewise.plans.catalog import _ORDER, EV, LEARN, LIKE, PRINTS, SCORED, SHAPES, _answers, query, scored, trace
from strokewise.sources.adapters import HEIGHT, WIDTH, table

KINDS = ("pointerdown", "pointermove", "pointerup", "pointercancel", "aimmove")


def six(out: DataFrame, *plain: str) -> DataFrame:
    return out.select(*[F.col(c) if c in plain else rounded(F.col(c)).alias(c) for c in out.columns])


@query("""SELECT doc_id, CASE quality WHEN 1 THEN 'valid' WHEN 0 THEN 'invalid' ELSE 'review' END status, CASE toxic WHEN 1 THEN 'bot' WHEN 0 THEN 'human' END label, CASE WHEN n_chars<1000 THEN 'human' WHEN n_chars>=3000 THEN 'bot' ELSE 'uncertain' END risk_label, CASE WHEN n_chars IS NULL THEN NULL ELSE least(greatest(n_chars/2000.0-0.5,0),1) END share FROM documents LEFT JOIN labels USING (doc_id)""")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "valid").when(F.col("quality") == 0, "rejected").otherwise("unheard of")
    label = F.when(F.col("toxic") == 1, "bot").when(F.col("toxic") == 0, "human").otherwise("unknown")
    risk = F.when(F.col("n_chars") < 1000, "low").when(F.col("n_chars") >= 3000, "high").otherwise("medium")
    return rows.select("doc_id", filters.stored_status(status).alias("status"), filters.known_label(label).alias("label"), filters.risk_label(risk).alias("risk_label"), filters.clamped(F.col("n_chars") / 2000.0 - 0.5).alias("share"))


@query("""SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality=1 AND toxic IN (0,1) AND source IS NOT NULL AND trim(source)<>''""")
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    named = rows.withColumns({"status": F.when(F.col("quality") == 1, "valid").otherwise("rejected"), "label": F.when(F.col("toxic") == 1, "bot").when(F.col("toxic") == 0, "human")})
    return filters.valid_labelled(named, "status", "label", "source").select("doc_id", "source")


@query(f"WITH {EV} SELECT attempt_id, row_number() OVER (PARTITION BY attempt_id ORDER BY seq)-1 seq, kind FROM ev WHERE kind<>'aimmove'")
def aim_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_aim(trace(spark, sf_dir)).select("attempt_id", "seq", "kind")


@query(f"""WITH {EV}, d AS (SELECT attempt_id, t-lag(t) OVER w dt, sqrt(((x-lag(x) OVER w)/500.0)**2+((y-lag(y) OVER w)/200.0)**2) dist FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
g AS (SELECT attempt_id, count(*) n, coalesce(bool_or(dt<0),false) back, coalesce(max(dist/dt) FILTER (dt>0),0) fastest FROM d GROUP BY 1) SELECT attempt_id, CASE WHEN n<4 THEN 'too_few_points' WHEN back THEN 'not_monotonic' WHEN fastest>0.02 THEN 'extreme_speed' END review, round(fastest,6) fastest FROM g""")
def speed_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(filters.speed_review(trace(spark, sf_dir), WIDTH, HEIGHT), "attempt_id", "review")


@query(f"WITH {EV} SELECT attempt_id FROM ev GROUP BY 1 HAVING bool_or(kind='pointerdown') AND bool_or(kind='pointerup') AND count(*)>=2")
def complete_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.complete(trace(spark, sf_dir))


@query(f"WITH {EV} SELECT attempt_id, " + ", ".join(f"count(*) FILTER (kind='{k}') n_{k}" for k in KINDS[:4]) + ", count(*) FILTER (kind='aimmove') n_other FROM ev GROUP BY 1")
def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.event_counts(trace(spark, sf_dir), KINDS[:4])


@query(f"WITH {SCORED} SELECT user_id, max(ano)+1 next_attempt FROM a GROUP BY 1")
def next_attempt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("user_id").agg((F.max("ano") + 1).alias("next_attempt"))


@query(f"""WITH {SCORED}, s AS (SELECT score, count(*) FILTER (human) h, count(*) n FROM a GROUP BY 1), r AS (SELECT h, sum(h) OVER (ORDER BY score DESC) hh, sum(n) OVER (ORDER BY score DESC) nn FROM s) SELECT round(sum(h*hh/nn)/sum(h),6) average_precision FROM r""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.average_precision(scored(spark, sf_dir), "human", "score"))


@query(f"""WITH {SCORED} SELECT count(*) "rows", round(avg((score>=0.3)::INT),6) hard_model_asr, round(avg((score>=0.7)::INT),6) direct_auto_allow_asr, round(avg((score<0.7)::INT),6) step_up_rate, count(*) FILTER (score<0.3) model_bot_risk_count, count(*) FILTER (score>=0.3 AND score<0.7) step_up_band_count, count(*) FILTER (score>=0.7) direct_auto_allow_count FROM a WHERE NOT human""")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.policy_summary(scored(spark, sf_dir).where("not human"), "score", 0.3, 0.7), "rows", "model_bot_risk_count", "step_up_band_count", "direct_auto_allow_count")


@query(f"""WITH {SCORED}, u AS (SELECT human, 'score' feature, score v FROM a UNION ALL SELECT human, 'other', other FROM a) SELECT human, feature, round(avg(v),6) mean, {", ".join(f"round(quantile_cont(v,{p / 100}),6) p{p:02d}" for p in (5, 10, 50, 90, 95))} FROM u GROUP BY 1,2""")
def feature_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.distribution(scored(spark, sf_dir), "human", ["score", "other"]), "human", "feature")


@query(f"WITH {SCORED} SELECT CAST((score>=0.1)::INT+(score>=0.25)::INT+(score>=0.5)::INT+(score>=0.9)::INT AS BIGINT) bin, count(*) n FROM a GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(scored(spark, sf_dir), "score", [0.1, 0.25, 0.5, 0.9])


@query(f"""WITH {SCORED}, u AS (SELECT user_id%5 run, human, 'score' feature, score v FROM a UNION ALL SELECT user_id%5, human, 'other', other FROM a), d AS (SELECT run, feature, avg(v) FILTER (human)-avg(v) FILTER (NOT human) d FROM u GROUP BY 1,2) SELECT feature, count(*) runs, count(*) FILTER (d>0) higher, count(*) FILTER (d<0) lower, round(avg(d),6) mean_difference FROM d WHERE d IS NOT NULL GROUP BY 1""")
def separation_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.recurrence(scored(spark, sf_dir).withColumn("run", F.col("user_id") % 5), "run", "human", ["score", "other"]), "feature", "runs", "higher", "lower")


@query(f"WITH {SCORED}, g AS (SELECT user_id, avg((score<0.5)::INT) rate FROM a WHERE human GROUP BY 1) SELECT count(*) groups, round(max(rate),6) worst, round(avg(rate),6) mean FROM g")
def worst_group_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.worst_group(scored(spark, sf_dir).where("human"), "user_id", F.col("score") < 0.5), "groups")


@query(f"""WITH {SCORED}, g AS (SELECT user_id, count(*) n, list_sort(list(score)) s, avg(score) mean, median(score) md FROM a GROUP BY 1) SELECT user_id, n, round(s[1],6) lowest, round(md,6) median, round(CASE WHEN n<=2 THEN md ELSE list_median(s[2:]) END,6) trimmed, round(CASE WHEN n>=4 THEN (s[(n+1)//4]*(4-(n+1)%4)+s[(n+1)//4+1]*((n+1)%4))/4 ELSE s[1] END,6) p25, round(mean,6) mean FROM g""".replace("list_median(s[2:])", "list_aggregate(s[2:], 'median')"))
def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.session_scores(scored(spark, sf_dir), "user_id", "score"), "user_id", "n")


@query(f"""WITH {SCORED}, p AS (SELECT quantile_cont(score,0.015) lo, quantile_cont(score,0.985) hi FROM a) SELECT round(lo,6) low, round(hi,6) high, round(avg((score<lo OR score>hi)::INT),6) outside FROM a, p GROUP BY 1,2""")
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.band(scored(spark, sf_dir), "score"))


@query(f"WITH {SCORED}, r AS (SELECT score, row_number() OVER (ORDER BY score)-1 k, count(*) OVER () n FROM a WHERE human) SELECT round(score,6) threshold, n FROM r WHERE k=floor(n*0.05)")
def common_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(evaluate.common_point(scored(spark, sf_dir).where("human"), "score", 0.05), "n")


@query(f"WITH {PRINTS}, c AS (SELECT fingerprint, count(*) n FROM fp GROUP BY 1) SELECT sum(n)::BIGINT paths, coalesce(sum(n) FILTER (n>1),0)::BIGINT colliding, round(coalesce(sum(n) FILTER (n>1),0)/sum(n),6) rate FROM c")
def fingerprint_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = replay.fingerprints(trace(spark, sf_dir)).groupBy("fingerprint").agg(F.count("*").alias("n"))
    out = each.agg(F.sum("n").alias("paths"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("colliding"))
    return six(out.withColumn("rate", F.col("colliding") / F.col("paths")), "paths", "colliding")


@query("""SELECT CAST(ts AS DATE) "day", count(*) n, round(avg(CAST(json_extract_string(props,'$.k') AS DOUBLE)),6) mean_k, round(count(*) FILTER (event_type='purchase')/nullif(count(*) FILTER (event_type='click'),0),6) ratio FROM events GROUP BY 1""")
def bucket_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"))
    of = lambda k: F.count_if(F.col("event_type") == k)
    out = rows.agg(F.count("*").alias("n"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("mean_k"), F.try_divide(of("purchase"), of("click")).alias("ratio"))
    return six(out, "day", "n")


@query(f"WITH {EV}, d AS (SELECT attempt_id, coalesce(sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2),0) s FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)), l AS (SELECT attempt_id, sum(s) len, count(*) n FROM d GROUP BY 1) SELECT count(*) n, round(quantile_cont(len,0.5),6) median, round(quantile_cont(len,0.9),6) p90, round(avg((n>=16)::INT),6) judgeable FROM l")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("attempt_id").orderBy("seq")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    each = trace(spark, sf_dir).withColumn("s", step).groupBy("attempt_id").agg(F.sum("s").alias("len"), F.count("*").alias("k"))
    p = F.percentile("len", F.array(F.lit(0.5), F.lit(0.9)))
    return six(each.agg(F.count("*").alias("n"), p[0].alias("median"), p[1].alias("p90"), F.avg(replay.warp_resistant(F.col("k"), 16).cast("double")).alias("judgeable")), "n")


@query("""WITH m AS (SELECT o_custkey, max(o_totalprice) top FROM orders GROUP BY 1) SELECT c_custkey, top, count(o_orderkey) orders FROM customer LEFT JOIN orders ON c_custkey=o_custkey LEFT JOIN m ON m.o_custkey=c_custkey GROUP BY 1,2""")
def challenge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with their children's count and an aggregated subquery, both optional."""
    orders = table(spark, sf_dir, "orders")
    each = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"), F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(each, "c_custkey", "left").select("c_custkey", "top", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""SELECT o_orderstatus status, count(*) n, count(*) FILTER (l_returnflag='R') returned, round(avg(l_quantity) FILTER (l_discount>0.05),6) mean_quantity FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1""")
def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return six(rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).alias("mean_quantity")), "status", "n", "returned")


@query("""SELECT o_orderkey, count(l_linenumber) n_lines, sha256(coalesce(string_agg(CAST(l_linenumber AS VARCHAR)||':'||l_partkey||':'||l_suppkey, ';' ORDER BY l_linenumber, l_partkey, l_suppkey),'')) lines FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1""")
def with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parent with its children in order, as one digest."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("a"))  # an order has few lines
    text = F.array_join(F.transform("a", lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")])), ";")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(each, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("n_lines"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("lines"))


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ano) rn FROM a) SELECT b.attempt_id, count(h.attempt_id) pairs, round(coalesce(max(1-abs(b.score-h.score)),0),6) closest FROM r b LEFT JOIN r h ON h.user_id=b.user_id AND h.rn BETWEEN b.rn-3 AND b.rn-1 GROUP BY 1")
def recent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt with its person's previous three: the past is a frame, not a join."""
    past = F.collect_list("score").over(Window.partitionBy("user_id").orderBy("ano").rowsBetween(-3, -1))
    rows = scored(spark, sf_dir).withColumn("past", past)
    best = F.array_max(F.transform("past", lambda h: 1 - F.abs(F.col("score") - h)))
    return six(rows.select("attempt_id", F.size("past").cast("long").alias("pairs"), F.coalesce(best, F.lit(0.0)).alias("closest")), "attempt_id", "pairs")


@query(f"WITH {PRINTS} SELECT count(*) replays, count(*) FILTER (EXISTS (SELECT 1 FROM fp s WHERE s.ano=0 AND s.fingerprint=r.fingerprint)) found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM fp s WHERE s.ano=0 AND s.fingerprint=r.fingerprint)) missing FROM fp r WHERE r.ano>0")
def replay_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = replay.fingerprints(trace(spark, sf_dir))
    sources = prints.where("ano = 0").select("fingerprint", F.lit(True).alias("source")).distinct()
    return prints.where("ano > 0").join(sources, "fingerprint", "left").agg(F.count("*").alias("replays"), F.count_if(F.col("source").isNotNull()).alias("found"), F.count_if(F.col("source").isNull()).alias("missing"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F') AND c_custkey IN (SELECT o_custkey FROM orders)""")
def fresh_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders.where("o_orderstatus = 'F'"), "c_custkey", "left_anti").join(orders, "c_custkey", "left_semi")


@query("""SELECT vec_id FROM embeddings ORDER BY sha256('salt:'||vec_id), vec_id LIMIT 20""")
def reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sampled(table(spark, sf_dir, "embeddings"), "vec_id", 20, "salt").select("vec_id")


@query("""SELECT user_id, event_id, turn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) turn FROM events) ORDER BY turn, user_id, event_id LIMIT 50""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.round_robin(table(spark, sf_dir, "events"), "user_id", "event_id", 50).select("user_id", "event_id", F.col("turn").cast("long").alias("turn"))


@query(f"WITH {SCORED} SELECT attempt_id, round(score,6) score FROM a WHERE NOT human ORDER BY a.score DESC, attempt_id LIMIT 25")
def weakest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(scored(spark, sf_dir).where("not human").orderBy(F.desc("score"), "attempt_id").limit(25).select("attempt_id", "score"), "attempt_id")


@query("""WITH u AS (SELECT n_name nm, 'nation' kind FROM nation UNION ALL SELECT r_name, 'region' FROM region) SELECT kind, count(*) n, count(DISTINCT nm) = count(*) is_unique FROM u GROUP BY 1""")
def combined_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "nation").select(F.col("n_name").alias("nm"), F.lit("nation").alias("kind"))
    both = one.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("nm"), F.lit("region").alias("kind")))
    return both.groupBy("kind", "nm").agg(F.count("*").alias("c")).groupBy("kind").agg(F.sum("c").alias("n"), (F.max("c") == 1).alias("is_unique"))


@query("""SELECT DISTINCT source FROM documents WHERE lang='en' EXCEPT SELECT source FROM documents WHERE lang='de'""")
def unknown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("lang = 'en'").select("source").subtract(docs.where("lang = 'de'").select("source"))


@query("""WITH e AS (SELECT event_id, user_id, sha256(event_type||json_extract_string(props,'$.k')) h, epoch_us(ts) us FROM events), l AS (SELECT *, lag(us) OVER (PARTITION BY h ORDER BY us, event_id) b FROM e) SELECT event_id, coalesce(us-b<=90000000000,false) seen FROM l""")
def global_fingerprint_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat("event_type", F.get_json_object("props", "$.k")), 256).alias("h"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return state.seen_recently(rows, "h", "us", ["event_id"], 90_000_000_000).select("event_id", "seen")


@query("""WITH c AS (SELECT o_orderkey challenge, o_custkey%7 binding, CAST(o_orderdate AS DATE)+60 expires FROM orders WHERE o_orderkey%5<>0), t AS (SELECT l_orderkey challenge, CASE WHEN l_linenumber=1 THEN -1 ELSE o_custkey%7 END binding, CAST(l_shipdate AS DATE) "at", l_linenumber n, l_partkey p, l_suppkey s FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
j AS (SELECT t.*, c.binding cb, c.expires, coalesce(t.binding=c.binding AND c.expires>t."at",false) v FROM t LEFT JOIN c USING (challenge)), d AS (SELECT *, coalesce(max(v::INT) OVER (PARTITION BY challenge ORDER BY n,p,s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=1 done FROM j),
r AS (SELECT *, CASE WHEN cb IS NULL THEN 'challenge_not_found' WHEN done THEN 'challenge_already_consumed' WHEN expires<="at" THEN 'challenge_expired' WHEN NOT v THEN 'challenge_binding_invalid' ELSE 'consumed' END reason FROM d) SELECT challenge, n, p, s, reason, reason='consumed' accepted FROM r""")
def challenge_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    challenges = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("challenge"), (F.col("o_custkey") % 7).alias("binding"), F.date_add(F.col("o_orderdate").cast("date"), 60).alias("expires"))
    tries = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("challenge"), F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("o_custkey") % 7).alias("binding"), F.col("l_shipdate").cast("date").alias("at"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return state.consumed(tries, challenges, ["n", "p", "s"]).select("challenge", "n", "p", "s", "reason", "accepted")


@query("""WITH b AS (SELECT user_id, epoch_us(ts)//86400000000 "day", max(epoch_us(ts)//1000) received, min(value*1000) "first", max(value*1000) "last", avg(value*1000) mean FROM events GROUP BY 1,2),
g AS (SELECT user_id, count(*) n_batches, CAST(max("last")-min("first") AS DOUBLE) client, CAST(max(received)-min(received) AS DOUBLE) server, coalesce(CASE WHEN stddev_pop(mean)*stddev_pop(received)>0 THEN covar_pop(mean,received)/(stddev_pop(mean)*stddev_pop(received)) END,0) corr FROM b GROUP BY 1),
r AS (SELECT *, CASE WHEN client<100000 THEN NULL WHEN n_batches<20 THEN 'too_few_batches_for_timeline' WHEN CASE WHEN client>0 THEN server/client ELSE 0 END<5000 THEN 'events_delivered_in_burst' WHEN corr<0.1 THEN 'delivery_timeline_uncorrelated' END reason FROM g) SELECT user_id, reason IS NULL ok, reason, n_batches FROM r""")
def delivery_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("user_id", us.alias("us"), (F.col("value") * 1000).alias("v"))
    batches = rows.groupBy("user_id", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(F.max(F.floor(F.col("us") / 1000)).alias("received"), F.min("v").alias("first"), F.max("v").alias("last"), F.avg("v").alias("mean"))
    return state.delivery(batches, "user_id", least_ratio=5_000, least_corr=0.1, least_batches=20, short_ms=100_000)


@query(f"""WITH RECURSIVE {EV}, m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ano, seq) k, CASE kind WHEN 'pointerup' THEN NULL WHEN 'pointercancel' THEN 5 WHEN 'aimmove' THEN 3 WHEN 'pointerdown' THEN 4 ELSE -1 END step FROM ev),
f AS (SELECT user_id, CAST(0 AS BIGINT) k, CAST(0 AS BIGINT) score, CAST(0 AS BIGINT) peak FROM m WHERE k=1 UNION ALL SELECT m.user_id, m.k, CASE WHEN step IS NULL THEN 0 ELSE least(30,greatest(0,score+step)) END, greatest(peak, CASE WHEN step IS NULL THEN 0 ELSE least(30,greatest(0,score+step)) END) FROM f JOIN m ON m.user_id=f.user_id AND m.k=f.k+1)
SELECT user_id, CAST(max_by(score,k) AS BIGINT) score, CAST(max(peak) AS BIGINT) peak, max(peak)>=10 flagged FROM f GROUP BY 1""")
def suspicion_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("kind") == "pointerup", None).when(F.col("kind") == "pointercancel", 5).when(F.col("kind") == "aimmove", 3).when(F.col("kind") == "pointerdown", 4).otherwise(-1)
    return state.suspicion(trace(spark, sf_dir).withColumn("step", step), "user_id", ["ano", "seq"])


@query("""WITH r AS (SELECT l_orderkey session, l_linenumber-1 seq, sha256(l_partkey||':'||l_suppkey) digest, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey)=1), p AS (SELECT *, CASE WHEN l_suppkey%9=0 THEN 'x' ELSE lag(digest) OVER (PARTITION BY session ORDER BY seq) END previous FROM r WHERE NOT (seq=1 AND l_suppkey%11=0)),
q AS (SELECT *, seq<>row_number() OVER (PARTITION BY session ORDER BY seq)-1 gap, coalesce(lag(digest) OVER (PARTITION BY session ORDER BY seq),'')<>coalesce(previous,'') broken FROM p), g AS (SELECT session, bool_or(gap) gap, bool_or(broken) broken, count(*) n FROM q GROUP BY 1)
SELECT session, NOT gap AND NOT broken ok, CASE WHEN gap THEN 'sequence_gap' WHEN broken THEN 'chain_broken' END reason, n FROM g""")
def receipt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("n", first).where("n = 1").select(F.col("l_orderkey").alias("session"), (F.col("l_linenumber") - 1).alias("seq"), F.sha2(F.concat_ws(":", "l_partkey", "l_suppkey"), 256).alias("digest"), "l_suppkey")
    rows = rows.where("not (seq = 1 and l_suppkey % 11 = 0)")
    before = F.lag("digest").over(Window.partitionBy("session").orderBy("seq"))
    return state.chained(rows.withColumn("previous", F.when(F.col("l_suppkey") % 9 == 0, "x").otherwise(before)))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_name)=1""")
def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return state.fresh(rows.union(rows), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", ["c_name"])


@query("""WITH v AS (SELECT o_custkey k, o_orderkey version, o_totalprice price FROM orders) SELECT k, max(version) version, max_by(price, version) price FROM v GROUP BY 1""")
def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
    return state.upserted(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["k"], "version")


@query(f"""WITH {EV}, g AS (SELECT user_id, ano, attempt_id, min(at_us)//1000 f, max(at_us)//1000 l FROM ev GROUP BY 1,2,3), p AS (SELECT *, CASE WHEN user_id%13=0 THEN NULL ELSE f-CASE WHEN user_id%5=0 THEN -60000 ELSE 100 END END pr, l+CASE WHEN user_id%7=0 THEN -(l-f)-900000 ELSE 50 END su FROM g)
SELECT attempt_id, CASE WHEN pr IS NULL THEN 'missing_server_timing' WHEN su<pr THEN 'submitted_before_presented' WHEN NOT (f>=pr-5000 AND l<=su+5000 AND l-f<=su-pr+5000) THEN 'event_timestamps_outside_server_window' END reason FROM p""")
def server_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda f: F.floor(f("at_us") / 1000)
    rows = trace(spark, sf_dir).groupBy("user_id", "ano", "attempt_id").agg(ms(F.min).alias("f"), ms(F.max).alias("l"))
    rows = rows.withColumns({"pr": F.when(F.col("user_id") % 13 != 0, F.col("f") - F.when(F.col("user_id") % 5 == 0, -60_000).otherwise(100)), "su": F.col("l") + F.when(F.col("user_id") % 7 == 0, F.col("f") - F.col("l") - 900_000).otherwise(50)})
    return rows.select("attempt_id", filters.outside_timing(rows, "pr", "su", "f", "l", True).alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even((least(greatest(l_linenumber%5,0),3)/3.0+least(greatest(l_suppkey%4,0),3)/3.0+least(greatest(l_partkey%6,0),3)/3.0+CASE WHEN l_returnflag='N' THEN 0 ELSE least(greatest(l_quantity*2,0),60)/60.0 END)/CASE WHEN l_returnflag='N' THEN 3 ELSE 4 END,4) slip,
CASE WHEN l_linestatus='F' AND l_suppkey%10=0 THEN 'system_error' WHEN l_linenumber%5=4 OR l_partkey%17=0 OR l_suppkey%13=0 THEN 'operation_error' WHEN l_partkey%3=l_suppkey%3 THEN CASE WHEN l_returnflag<>'R' THEN 'correct' ELSE 'concept_error' END ELSE 'ambiguous' END outcome FROM lineitem""")
def answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    error = F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 2)
    made = learning.outcome((F.col("l_linestatus") == "F") & (s % 10 == 0), F.when(n % 5 == 4, 1).otherwise(0), F.when(p % 17 != 0, p), F.when(s % 13 != 0, p % 3), s % 3, F.col("l_returnflag") != "R")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", learning.slip_probability(n % 5, s % 4, p % 6, error.cast("double")).alias("slip"), made.alias("outcome"))


@query("WITH " + LEARN + " SELECT student, concept, round(mastery,6) mastery, NOT attempts<3 AND mastery>=0.85 ready FROM mt")
def ready_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(learning.ready_for_next(learning.mastery(_answers(spark, sf_dir))).select("student", "concept", "mastery", "ready"), "student", "concept", "ready")


@query(f"WITH {SCORED} SELECT attempt_id, CASE WHEN user_id%17=0 THEN 0.0 ELSE round(least(score,other),6) END final_score FROM a")
def two_view_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser of two views' scores, set to 0 where a veto holds."""
    return scored(spark, sf_dir).select("attempt_id", F.when(F.col("user_id") % 17 == 0, 0.0).otherwise(rounded(F.least("score", "other"))).alias("final_score"))


@query(f"""WITH {SCORED}, b AS (SELECT CASE WHEN least(score,other)>=0.5 THEN 'evader' WHEN least(score,other)>=0.35 THEN 'near_miss' ELSE 'blocked' END band, CASE WHEN score<=other THEN 'score' ELSE 'other' END binding, least(score,other) s FROM a WHERE NOT human) SELECT band, binding, count(*) n, round(quantile_cont(s,0.5),6) median FROM b GROUP BY 1,2""")
def score_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.least("score", "other")
    rows = scored(spark, sf_dir).where("not human").select(F.when(s >= 0.5, "evader").when(s >= 0.35, "near_miss").otherwise("blocked").alias("band"), F.when(F.col("score") <= F.col("other"), "score").otherwise("other").alias("binding"), s.alias("s"))
    return six(rows.groupBy("band", "binding").agg(F.count("*").alias("n"), F.percentile("s", 0.5).alias("median")), "band", "binding", "n")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions a student; checked against a row-by-row version in the tests."""
    answers = _answers(spark, sf_dir)
    weak = learning.weak_concepts(answers, F.lit("1998-12-01").cast("date"), _ORDER)
    bank = answers.select("question", "concept", "difficulty").distinct()
    return learning.recommended(weak, bank, answers.where("correct").select("student", "question"))


def diagnosis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.diagnosis_text(learning.weak_concepts(_answers(spark, sf_dir), F.lit("1998-12-01").cast("date"), _ORDER))


@query(f"""WITH {EV}, {SHAPES}, o AS (SELECT user_id, attempt_id, row_number() OVER (PARTITION BY user_id ORDER BY ano) rn FROM (SELECT DISTINCT user_id, ano, attempt_id FROM ev) JOIN (SELECT DISTINCT attempt_id FROM un) USING (attempt_id)), pairs AS (SELECT a.attempt_id, b.attempt_id source FROM o a JOIN o b ON a.user_id=b.user_id AND b.rn BETWEEN a.rn-5 AND a.rn-1), {LIKE}
SELECT o.attempt_id, round(coalesce(best,0),6) max_similarity, least(rn-1,5) compared FROM o LEFT JOIN lk USING (attempt_id)""")
def path_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest similarity of each path to its person's previous five."""
    return six(replay.similarity(replay.resampled(trace(spark, sf_dir)), 5), "attempt_id", "compared")


for _f in (recommendations, diagnosis_text):
    query()(_f)
