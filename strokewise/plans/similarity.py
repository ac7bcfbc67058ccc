"""Registered queries of pairs of paths, of aims joined to drags, and of aims' and clocks' features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strokewise.operators import aim, evaluate, features, pair_signals, segments, vectors
from strokewise.plans.catalog import EV, query, trace
from strokewise.plans.records import six
from strokewise.sources.adapters import HEIGHT, WIDTH, table

#: Each path from its origin and of unit length, without repeated points.
UNIT = f"""{EV}, q0 AS (SELECT user_id, ano, attempt_id, seq, x, y, lag(x) OVER w px, lag(y) OVER w py FROM ev WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
q1 AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY seq) k FROM q0 WHERE px IS NULL OR x<>px OR y<>py), q2 AS (SELECT *, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2) s, x-first_value(x) OVER w rx, y-first_value(y) OVER w ry FROM q1 WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
un AS (SELECT user_id, ano, attempt_id, count(*) n, sum(s) len, list(rx ORDER BY seq) xs, list(ry ORDER BY seq) ys FROM q2 GROUP BY 1,2,3),
pt AS (SELECT user_id, ano, attempt_id, CASE WHEN len>1e-12 THEN n ELSE 0 END n, [v/len FOR v IN xs] xs, [v/len FOR v IN ys] ys FROM un)"""


def _pairs(spark: SparkSession, sf_dir: str, newest: int) -> DataFrame:
    held = pair_signals.paths(trace(spark, sf_dir), ["user_id", "ano", "attempt_id"])
    return pair_signals.earlier(held, "user_id", ["ano"], "attempt_id", newest)


@query(f"""WITH RECURSIVE {UNIT}, pr AS (SELECT a.attempt_id, b.attempt_id source, a.n, b.n m, a.xs, a.ys, b.xs us, b.ys vs FROM pt a JOIN pt b ON a.user_id=b.user_id AND b.ano=a.ano-1),
dp AS (SELECT attempt_id, 0 d, i, CASE WHEN i=0 THEN 0.0 ELSE 'Infinity'::DOUBLE END c, 0 k, 'Infinity'::DOUBLE pc, 0 pk FROM pr, range(17) r(i) WHERE pr.n>0 AND pr.m>0
UNION ALL SELECT attempt_id, d+1, i, CASE WHEN best IS NULL THEN 'Infinity'::DOUBLE ELSE best.c+sqrt((xs[i]-us[d+1-i])**2+(ys[i]-vs[d+1-i])**2) END, CASE WHEN best IS NULL THEN 0 ELSE best.k+1 END, c, k FROM
 (SELECT s.*, pr.xs, pr.ys, pr.us, pr.vs, CASE WHEN i BETWEEN 1 AND n AND d+1-i BETWEEN 1 AND m THEN CASE WHEN uc<=c AND uc<=dc THEN {{'c':uc,'k':uk}} WHEN c<=dc THEN {{'c':c,'k':k}} ELSE {{'c':dc,'k':dk}} END END best
  FROM (SELECT *, lag(c) OVER w uc, lag(k) OVER w uk, lag(pc) OVER w dc, lag(pk) OVER w dk FROM dp WINDOW w AS (PARTITION BY attempt_id ORDER BY i)) s JOIN pr USING (attempt_id) WHERE d<n+m))
SELECT pr.attempt_id, pr.source, round(CASE WHEN n>0 AND m>0 THEN 1/(1+c/k) ELSE 0 END,6) similarity FROM pr LEFT JOIN dp ON dp.attempt_id=pr.attempt_id AND dp.d=n+m AND dp.i=n""")
def dtw_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path against the one before it of the same person, by dynamic time warping."""
    return six(pair_signals.dtw(_pairs(spark, sf_dir, 1)), "attempt_id", "source")


def replay_pair_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen signals of each path and the three before it of the same person; compared with loops and matrix algebra in the tests."""
    return six(pair_signals.compared(_pairs(spark, sf_dir, 3)), "attempt_id", "source")


query()(replay_pair_signals)


#: Pointer traces under the names of a recorded challenge.
RECORDED = "CASE kind WHEN 'aimmove' THEN 'aim_move' WHEN 'pointerdown' THEN 'pointer_down' WHEN 'pointermove' THEN 'pointer_move' WHEN 'pointerup' THEN 'drop' ELSE kind END"
RUNS = f"""{EV}, k AS (SELECT user_id, ano, seq, x, y, {RECORDED} kd FROM ev), m AS (SELECT *, CASE WHEN kd IN ('aim_move','pointer_down') THEN kd END mk FROM k), o AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ano, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)='pointer_down',false) op FROM m),
rn AS (SELECT *, sum((mk IS NOT NULL AND op)::INT) OVER (PARTITION BY user_id ORDER BY ano, seq) run, CASE WHEN mk='aim_move' THEN 'aim' WHEN kd IN ('pointer_move','drop') AND op THEN 'drag' END part FROM o),
rr AS (SELECT * FROM rn WHERE part IS NOT NULL QUALIFY bool_or(part='drag') OVER (PARTITION BY user_id, run))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.runs(trace(spark, sf_dir).withColumn("kind", F.expr(RECORDED)))


@query(f"WITH {RUNS} SELECT user_id, CAST(run AS BIGINT) run, count(*) FILTER (part='aim') aims, count(*) FILTER (part='drag') drags FROM rr GROUP BY 1,2")
def aim_drag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aims and the drags that follow them, each person's events as one recording."""
    return _runs(spark, sf_dir).groupBy("user_id", "run").agg(F.count_if(F.col("part") == "aim").alias("aims"), F.count_if(F.col("part") == "drag").alias("drags"))


@query(f"""WITH {RUNS}, s AS (SELECT *, coalesce(part='drag' AND lag(part) OVER w='aim' AND sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2)<1e-9,false) seam FROM rr WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY user_id, run ORDER BY ano, seq))
SELECT user_id, CAST(run AS BIGINT) run, count(*) FILTER (part='aim') n_aim, count(*) FILTER (part='drag') n_drag, count(*) n_points, count(*)>=4 judgeable FROM s WHERE NOT seam GROUP BY 1,2""")
def aim_drag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.joined_paths(_runs(spark, sf_dir), least=4)


_PI = "pi()"
AIM = f"""{EV}, c0 AS (SELECT *, coalesce((t-lag(t) OVER (PARTITION BY attempt_id ORDER BY seq)>100)::INT,0) cut FROM ev), b0 AS (SELECT attempt_id, seq, x, y, CAST(t AS DOUBLE) t, sum(cut) OVER (PARTITION BY attempt_id ORDER BY seq) burst FROM c0),
b1 AS (SELECT *, row_number() OVER w-1 i, count(*) OVER q n, x-lag(x) OVER w dx, y-lag(y) OVER w dy, t-lag(t) OVER w gap, sqrt((x-last_value(x) OVER q)**2+(y-last_value(y) OVER q)**2) lft FROM b0 WINDOW w AS (PARTITION BY attempt_id, burst ORDER BY seq), q AS (PARTITION BY attempt_id, burst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b2 AS (SELECT *, n-1 m, i-1 j, sqrt(dx*dx+dy*dy) step, atan2(dy,dx) a, sqrt(dx*dx+dy*dy)/(greatest(gap,1e-6)/1000) speed FROM b1 WHERE n>=3),
b3 AS (SELECT *, a-lag(a) OVER w raw, CASE WHEN i>=2 THEN (speed-lag(speed) OVER w)/greatest(gap/1000,1e-6) END accel, max(speed) OVER q top, first_value(lft) OVER q st FROM b2 WINDOW w AS (PARTITION BY attempt_id, burst ORDER BY seq), q AS (PARTITION BY attempt_id, burst ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b4 AS (SELECT *, raw-2*{_PI}*floor((raw+{_PI})/(2*{_PI})) turn, CASE WHEN i>=3 THEN sign(accel)<>lag(sign(accel)) OVER w END flip, i>=2 AND speed>=lag(speed) OVER w AND speed>lead(speed) OVER w AND speed>0.25*top AND speed-min(speed) OVER (PARTITION BY attempt_id, burst ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)>0.15*top crest, lft/(st+1e-9) rest, CASE WHEN top<>0 THEN top ELSE 1e-9 END high FROM b3 WINDOW w AS (PARTITION BY attempt_id, burst ORDER BY seq)),
b5 AS (SELECT *, min(CASE WHEN rest<=0.15 THEN i END) OVER (PARTITION BY attempt_id, burst) came FROM b4),
af AS (SELECT attempt_id, CAST(burst AS BIGINT) burst, max_by(t,i)-min_by(t,i) duration_ms, CAST(max(n) AS DOUBLE) point_count, sum(step) path_length, max(st) straight_distance, max(high) peak_speed, avg(speed) mean_speed, min(CASE WHEN speed=top THEN j END)/max(greatest(m-1,1)) peak_at, avg((speed<0.2*high)::INT) slow_fraction, avg((speed>0.6*high)::INT) fast_fraction,
 min(CASE WHEN rest<=0.5 THEN i END)/max(m) half_distance_at, max(CASE WHEN j=m-1 THEN speed END)/max(high) final_speed_ratio, max(CASE WHEN j=0 THEN speed END)/max(high) first_speed_ratio, avg(speed) FILTER (i>=1 AND j>=3*m//4)/(avg(speed) FILTER (i>=1 AND j<greatest(m//4,1))+1e-9) decel_ratio, CASE WHEN sum(step)>1e-9 THEN max(st)/sum(step) ELSE 0 END straightness,
 stddev_pop(speed)/(avg(speed)+1e-9) speed_cv, stddev_pop(step)/(avg(step)+1e-9) step_len_cv, CAST(count(*) FILTER (crest) AS DOUBLE) submovement_count, avg(abs(turn)) turn_abs_mean, avg(turn) turn_signed_mean, stddev_pop(abs(turn))/(avg(abs(turn))+1e-9) turn_cv, stddev_pop(accel) accel_std, coalesce(avg(flip::INT),0) accel_sign_flips,
 greatest(0,max(CASE WHEN i>=came THEN lft END))/(max(st)+1e-9) overshoot, quantile_cont(gap,0.5) interval_median_ms, stddev_pop(gap)/(avg(gap)+1e-9) interval_cv, avg((gap<=45)::INT) interval_at_floor FROM b5 GROUP BY 1,2)"""
#: Features that a step of no time makes explode, shown as logarithms.
_WILD = ("peak_speed", "mean_speed", "accel_std", "decel_ratio")
_SHOWN = ", ".join(f"round({f'log10(1+{f})' if f in _WILD else f},6) {f}" for f in aim.FEATURES if f not in ("turn_signed_mean", "turn_cv"))


@query(f"WITH {AIM} SELECT attempt_id, burst, {_SHOWN} FROM af")
def aim_burst_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of aiming bursts; those of signed turns, which half turns make uncertain, are compared with numpy in the tests."""
    out = aim.burst_features(_bursts(spark, sf_dir), ["attempt_id", "burst"])
    shown = [F.log10(1 + F.col(f)).alias(f) if f in _WILD else F.col(f) for f in aim.FEATURES if f not in ("turn_signed_mean", "turn_cv")]
    return six(out.select("attempt_id", "burst", *shown), "attempt_id", "burst")


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("attempt_id").orderBy("seq")
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > 100).cast("int"), F.lit(0))
    return trace(spark, sf_dir).withColumn("cut", cut).withColumn("burst", F.sum("cut").over(w))


_MEDIANS = ("duration_ms", "point_count", "path_length", "straightness", "submovement_count", "peak_at", "slow_fraction", "interval_median_ms")


@query(f"WITH {AIM}, u AS (SELECT unnest([{', '.join(chr(39) + f + chr(39) for f in _MEDIANS)}]) feature, unnest([{', '.join(_MEDIANS)}]) v FROM af) SELECT feature, round(quantile_cont(v,0.5),6) median FROM u GROUP BY 1")
def aim_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the bursts' features: what a plausible aim looks like."""
    out = aim.burst_features(_bursts(spark, sf_dir), ["attempt_id", "burst"])
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in _MEDIANS]))
    return six(evaluate.quantiles(out.select(named.alias("f")).select("f.*"), "v", [0.5], ("feature",)).withColumnRenamed("q0", "median"), "feature")


@query(f"""WITH {EV}, g AS (SELECT attempt_id, seq, CAST(t-lag(t) OVER (PARTITION BY attempt_id ORDER BY t) AS DOUBLE) gap, x-lag(x) OVER w dx, y-lag(y) OVER w dy, t-lag(t) OVER w dt FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
h AS (SELECT *, CASE WHEN dt>0 THEN sqrt(dx*dx+dy*dy)/dt WHEN dt IS NOT NULL THEN 0.0 END v FROM g), k AS (SELECT *, lag(v) OVER (PARTITION BY attempt_id ORDER BY seq) was FROM h),
c AS (SELECT attempt_id, gap, count(*) n FROM g WHERE gap IS NOT NULL GROUP BY 1,2), ce AS (SELECT attempt_id, count(*) dv, max(n) mx, sum(n) n, CASE WHEN sum(n)>=2 AND count(*)>1 THEN (ln(sum(n))-sum(n*ln(n))/sum(n))/ln(count(*)) ELSE 0 END e FROM c GROUP BY 1),
a AS (SELECT attempt_id, count(gap) n, avg(gap) mean, stddev_pop(gap) sd, count(v) nv, stddev_pop(v) sv, covar_pop(CASE WHEN was IS NOT NULL THEN v END, was) cv, stddev_pop(CASE WHEN was IS NOT NULL THEN v END)*stddev_pop(was) sp, count(DISTINCT CASE WHEN dx IS NOT NULL THEN {{'a':round_even(dx,3),'b':round_even(dy,3)}} END) st FROM k GROUP BY 1)
SELECT a.attempt_id, round(CASE WHEN a.n>0 THEN dv/a.n ELSE 0 END,6) dt_distinct_ratio, round(coalesce(e,0),6) dt_entropy, round(CASE WHEN a.n>=2 AND mean<>0 THEN sd/mean ELSE 0 END,6) dt_cv, round(CASE WHEN a.n>0 THEN mx/a.n ELSE 0 END,6) dt_mode_share, round(CASE WHEN nv>=3 AND sv>0 AND sp>1e-300 THEN greatest(-1,least(1,cv/sp)) ELSE 0 END,6) speed_autocorr, round(CASE WHEN a.n>0 THEN 1-st/a.n ELSE 0 END,6) step_quantisation FROM a LEFT JOIN ce USING (attempt_id)""")
def clock_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct, repeated and uneven gaps, speeds that follow each other, steps that come again."""
    return six(aim.clock_features(trace(spark, sf_dir)), "attempt_id")


POINTS = f"""{EV}, p0 AS (SELECT attempt_id, user_id, ano, list(x ORDER BY seq) xs, list(y ORDER BY seq) ys, list(CAST(t AS DOUBLE) ORDER BY seq) ts, count(*) n FROM ev WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1,2,3)"""
_EVEN = lambda a, count: f"[{a}[CAST(floor(i*(n-1)/{count - 1}.0) AS INT)+1]+(i*(n-1)/{count - 1}.0-floor(i*(n-1)/{count - 1}.0))*({a}[CAST(least(floor(i*(n-1)/{count - 1}.0)+1,n-1) AS INT)+1]-{a}[CAST(floor(i*(n-1)/{count - 1}.0) AS INT)+1]) FOR i IN range({count})]"


@query(f"""WITH {POINTS}, p1 AS (SELECT *, xs[n]-xs[1] vx, ys[n]-ys[1] vy, ts[n]-ts[1] sp FROM p0 WHERE n>=2), p2 AS (SELECT *, vx*vx+vy*vy q FROM p1),
p3 AS (SELECT attempt_id, n, [CASE WHEN sqrt(q)<1e-9 THEN xs[k]-xs[1] ELSE ((xs[k]-xs[1])*vx+(ys[k]-ys[1])*vy)/q END FOR k IN range(1,n+1)] a, [CASE WHEN sqrt(q)<1e-9 THEN ys[k]-ys[1] ELSE ((ys[k]-ys[1])*vx-(xs[k]-xs[1])*vy)/q END FOR k IN range(1,n+1)] b, [CASE WHEN sp>1e-9 THEN (ts[k]-ts[1])/sp ELSE (k-1)/(n-1) END FOR k IN range(1,n+1)] c FROM p2),
p4 AS (SELECT attempt_id, {_EVEN('a', 64)} a, {_EVEN('b', 64)} b, {_EVEN('c', 64)} c FROM p3) SELECT attempt_id, unnest(range(64)) i, round(unnest(a),6) x, round(unnest(b),6) y, round(unnest(c),6) t FROM p4""")
def canonical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from (0, 0) to (1, 0), in time from 0 to 1, a row for each of 64 points."""
    return six(vectors.canonical_points(pair_signals.paths(trace(spark, sf_dir), ["attempt_id"]), "attempt_id"), "attempt_id", "i")


@query(f"""WITH {EV}, w0 AS (SELECT attempt_id, seq, least(1,greatest(0,x/500)) px, least(1,greatest(0,y/200)) py, CAST(max(t) OVER (PARTITION BY attempt_id ORDER BY seq)-first_value(t) OVER (PARTITION BY attempt_id ORDER BY seq) AS DOUBLE) pt FROM ev), w1 AS (SELECT attempt_id, count(*) n, list(px ORDER BY seq) a, list(py ORDER BY seq) b, list(pt ORDER BY seq) c FROM w0 GROUP BY 1 HAVING count(*)>=4),
w2 AS (SELECT attempt_id, {_EVEN('a', 24)} a, {_EVEN('b', 24)} b, {_EVEN('c', 24)} c FROM w1) SELECT attempt_id, unnest(range(24)) i, round(unnest(a),6) x, round(unnest(b),6) y, round(unnest([ln(1+greatest(0,c[k]-c[greatest(k-1,1)])) FOR k IN range(1,25)]),6) gap FROM w2""")
def attempt_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the box and logarithms of gaps, a row for each of 24 points."""
    made = vectors.vectors(trace(spark, sf_dir), "attempt_id", WIDTH, HEIGHT, 24)
    rows = made.select("attempt_id", F.posexplode(F.arrays_zip("xs", "ys", "gaps")).alias("i", "v"))
    return six(rows.select("attempt_id", F.col("i").cast("long").alias("i"), F.col("v.xs").alias("x"), F.col("v.ys").alias("y"), F.col("v.gaps").alias("gap")), "attempt_id", "i")


@query(f"""WITH {POINTS}, e AS (SELECT attempt_id, user_id, ano, n, {_EVEN('xs', 32)} a, {_EVEN('ys', 32)} b FROM p0 WHERE n>=2), m AS (SELECT *, [CASE WHEN list_max(a)-list_min(a)>1e-9 THEN (v-list_min(a))/(list_max(a)-list_min(a)) ELSE 0 END FOR v IN a] u, [CASE WHEN list_max(b)-list_min(b)>1e-9 THEN (v-list_min(b))/(list_max(b)-list_min(b)) ELSE 0 END FOR v IN b] v FROM e)
SELECT q.attempt_id, p.attempt_id source, round(CASE WHEN k.n>=2 AND l.n>=2 THEN 1/(1+list_avg([sqrt((k.u[i]-l.u[i])**2+(k.v[i]-l.v[i])**2) FOR i IN range(1,33)])) ELSE 0 END,6) similarity FROM p0 q JOIN p0 p ON p.user_id=q.user_id AND p.ano=q.ano-1 LEFT JOIN m k ON k.attempt_id=q.attempt_id LEFT JOIN m l ON l.attempt_id=p.attempt_id""")
def box_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path against the one before it, axis by axis in its box."""
    pairs = _pairs(spark, sf_dir, 1)
    return six(pairs.select("attempt_id", "source", vectors.box_similarity(F.col("current"), F.col("path")).alias("similarity")), "attempt_id", "source")


@query(f"""WITH {EV}, i AS (SELECT attempt_id, count(*) event_count, sha256(string_agg(seq||':'||kind||':'||CAST(round_even(t*1000000.0,0) AS BIGINT)||':'||CAST(round_even(x*1000000,0) AS BIGINT)||':'||CAST(round_even(y*1000000,0) AS BIGINT), ';' ORDER BY seq)) input_digest FROM ev GROUP BY 1),
f AS (SELECT attempt_id, sha256('duration='||CAST((max(t)-min(t))*1000000 AS BIGINT)||';events='||count(*)*1000000) feature_digest FROM ev GROUP BY 1) SELECT * FROM i JOIN f USING (attempt_id)""")
def scoring_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each attempt's events and of two of its features."""
    rows = trace(spark, sf_dir)
    return vectors.audit(rows, rows.groupBy("attempt_id").agg((F.max("t") - F.min("t")).alias("duration"), F.count("*").alias("events")))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS DOUBLE) a, CASE WHEN l_partkey%5=0 THEN NULL ELSE l_partkey%4 END b, CASE WHEN l_suppkey%6=0 THEN 0 ELSE l_suppkey%3 END d FROM lineitem)
SELECT l_orderkey, count(*) n, sum(a) regrab_count, coalesce(sum(b),0)::DOUBLE retry_count, sum(d)::DOUBLE pointercancel_count, 0.0::DOUBLE empty_click_count, 0.0::DOUBLE failed_drop_count FROM c GROUP BY 1""")
def interaction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of interaction, cleaned and added up; some are null, not finite or missing."""
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("regrab_count"), F.when(p % 5 != 0, p % 4).alias("retry_count"), F.when(s % 6 == 0, float("nan")).otherwise(s % 3).alias("pointercancel_count"))
    made = features.counters(rows, "l_orderkey")
    return made.groupBy("l_orderkey").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in features.COUNTERS])


@query(f"""WITH {EV}, d AS (SELECT attempt_id, count(*) n, CAST(max(t)-min(t) AS DOUBLE) du, (user_id*7+ano)%5-1.5 li FROM ev GROUP BY attempt_id, user_id, ano) SELECT attempt_id, '1.0' feature_schema_version, CAST(n AS DOUBLE) event_count, du duration_ms, CAST(least(1,greatest(0,li)) AS DOUBLE) linearity, 4 extras, CAST(li AS DOUBLE) raw_linearity FROM d""")
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as they are stored: some in columns, all in one map."""
    rows = trace(spark, sf_dir).groupBy("attempt_id", "user_id", "ano").agg(F.count("*").alias("event_count"), (F.max("t") - F.min("t")).alias("duration_ms"))
    rows = rows.select("attempt_id", "event_count", "duration_ms", ((F.col("user_id") * 7 + F.col("ano")) % 5 - 1.5).alias("linearity"), F.lit(2.0).alias("other"))
    made = features.stored(rows, "1.0")
    return made.select("attempt_id", "feature_schema_version", "event_count", "duration_ms", "linearity", F.size("extra_features").alias("extras"), F.col("extra_features")["linearity"].alias("raw_linearity"))
