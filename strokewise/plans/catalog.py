"""The registered queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strokewise.functions.rounding import rounded
from strokewise.operators import calibrate, evaluate, features, learning, quality, replay, risk, segments
from strokewise.sources.adapters import HEIGHT, WIDTH, attempts, learning as answers, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Ordered traces from the events table.
EV = """base AS (SELECT *, epoch_us(ts) us, 2*CAST(json_extract_string(props,'$.k') AS DOUBLE) yy, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 rn FROM events),
ev AS (SELECT user_id, rn//16 ano, user_id||'-'||(rn//16) attempt_id, rn%16 seq, us at_us, value x, yy y, (us - min(us) OVER (PARTITION BY user_id, rn//16))//600000000 t,
 CASE event_type WHEN 'click' THEN 'pointerdown' WHEN 'view' THEN 'pointermove' WHEN 'purchase' THEN 'pointerup' WHEN 'error' THEN 'pointercancel' ELSE 'aimmove' END kind FROM base)"""
SEG = EV + """,
d AS (SELECT *, x-lag(x) OVER w dx, y-lag(y) OVER w dy, CAST(greatest(t-lag(t) OVER w,0) AS DOUBLE) dt0 FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
s1 AS (SELECT *, CASE WHEN dx IS NOT NULL THEN dt0 END dt, sqrt(dx*dx+dy*dy) dist FROM d),
s2 AS (SELECT *, CASE WHEN dt>0 THEN dist/dt WHEN dt IS NOT NULL THEN 0.0 END speed FROM s1),
s3 AS (SELECT *, (speed-lag(speed) OVER (PARTITION BY attempt_id ORDER BY seq))/greatest(dt,1e-9) accel FROM s2),
seg AS (SELECT *, (accel-lag(accel) OVER (PARTITION BY attempt_id ORDER BY seq))/greatest(dt,1e-9) jerk FROM s3)"""
#: A stand-in score, not a model: a fixed function of the attempt's clock and number.
SCORED = EV + """,
a AS (SELECT user_id, ano, attempt_id, user_id%3<>0 human, (sum(t*(seq+1))%997)/997.0 score, sum(t)%100/100.0+0 other FROM ev GROUP BY 1,2,3)"""


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts(table(spark, sf_dir, "events"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with a stand-in score and label."""
    rows = trace(spark, sf_dir).groupBy("user_id", "ano", "attempt_id").agg(F.sum(F.col("t") * (F.col("seq") + 1)).alias("a"), F.sum("t").alias("b"))
    return rows.select("user_id", "ano", "attempt_id", (F.col("user_id") % 3 != 0).alias("human"), (F.col("a") % 997 / 997.0).alias("score"), (F.col("b") % 100 / 100.0).alias("other"))


@query(f"WITH {EV} SELECT attempt_id, CAST(seq AS BIGINT) seq, CAST(t AS BIGINT) t, x, y, kind FROM ev")
def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).select("attempt_id", F.col("seq").cast("long").alias("seq"), "t", "x", "y", "kind")


_log = lambda c: rounded(F.log10(1 + F.col(c))).alias(c)  # noqa: E731  steps of no time make some features explode


@query(f"""WITH {SEG}, m AS (SELECT *, last_value(CASE WHEN dist>=1 THEN dx END IGNORE NULLS) OVER p lx, last_value(CASE WHEN dist>=1 THEN dy END IGNORE NULLS) OVER p ly,
 first_value(x) OVER e x0, first_value(y) OVER e y0, last_value(x) OVER e x1, last_value(y) OVER e y1 FROM seg WINDOW p AS (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) line FROM m),
g AS (SELECT attempt_id, count(*) c, CAST(greatest(max(t)-min(t),0) AS DOUBLE) span, coalesce(sum(dist),0) total, max(line) disp, max(speed) ms, stddev_pop(speed) ss, avg(abs(accel)) aa, max(abs(accel)) ma, avg(abs(jerk)) jm,
 count(*) FILTER (dist>=1 AND dx*lx+dy*ly<0) dc, count(*) FILTER (dist<1) pc, coalesce(sum(dt) FILTER (dist<1),0) paused,
 max(CASE WHEN line<1e-9 THEN sqrt((x-x0)*(x-x0)+(y-y0)*(y-y0)) ELSE abs((x1-x0)*(y0-y)-(x0-x)*(y1-y0))/line END) yd FROM n GROUP BY 1)
SELECT attempt_id, c event_count, span duration_ms, round(total,6) total_distance, round(CASE WHEN c>=2 THEN disp ELSE 0 END,6) displacement, round(CASE WHEN span>0 THEN total/(span+1e-9) ELSE 0 END,6) avg_speed, round(coalesce(ms,0),6) max_speed, round(coalesce(ss,0),6) speed_std,
 round(log10(1+coalesce(aa,0)),6) avg_acceleration, round(log10(1+coalesce(ma,0)),6) max_acceleration, round(log10(1+coalesce(jm,0)),6) jerk_mean, dc direction_changes, pc pause_count, round(CASE WHEN span>0 THEN paused/(span+1e-9) ELSE 0 END,6) pause_ratio,
 round(CASE WHEN total>0 THEN disp/(total+1e-9) ELSE 0 END,6) linearity, round(CASE WHEN c>=2 THEN yd ELSE 0 END,6) y_deviation FROM g""")
def trajectory_basic_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.basic(trace(spark, sf_dir))
    plain = ["attempt_id", "event_count", "duration_ms"]
    return out.select(*plain, *[_log(c) if "accel" in c or "jerk" in c else rounded(F.col(c)).alias(c) if c not in ("direction_changes", "pause_count") else F.col(c) for c in out.columns if c not in plain])


@query(f"""WITH {SEG}, v AS (SELECT attempt_id, dt, count(*) n FROM seg WHERE dt IS NOT NULL GROUP BY 1,2), g AS (SELECT attempt_id, sum(dt*n)/sum(n) m, sum(dt*dt*n)/sum(n) q, sum(n) n, sum(CASE WHEN n>1 THEN n ELSE 0 END) r FROM v GROUP BY 1)
SELECT attempt_id, round(m,6) interval_mean_ms, round(sqrt(greatest(q-m*m,0)),6) interval_std_ms, round(CASE WHEN m>0 THEN sqrt(greatest(q-m*m,0))/(m+1e-9) ELSE 0 END,6) interval_cv, round(r/(n+1e-9),6) duplicate_interval_ratio FROM g""")
def trajectory_interval_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.intervals(trace(spark, sf_dir))
    return out.select("attempt_id", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


@query(f"""WITH {EV.replace("value x", "value/500.0 x").replace("yy y,", "yy/200.0 y,")}, d AS (SELECT *, x-lag(x) OVER w dx, y-lag(y) OVER w dy, CAST(greatest(t-lag(t) OVER w,0) AS DOUBLE) dt FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
s AS (SELECT *, sqrt(dx*dx+dy*dy) dist, CASE WHEN dt>0 THEN sqrt(dx*dx+dy*dy)/dt ELSE 0 END speed, CASE WHEN sqrt(dx*dx+dy*dy)>1e-6 THEN atan2(dy,dx) END h FROM d WHERE dx IS NOT NULL),
u AS (SELECT *, h-last_value(h IGNORE NULLS) OVER (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) gap, dt>=greatest(100.0, quantile_cont(dt,0.9) OVER (PARTITION BY attempt_id)) dwell FROM s),
b AS (SELECT *, dwell AND NOT coalesce(lag(dwell) OVER (PARTITION BY attempt_id ORDER BY seq),false) begins, abs(atan2(sin(gap),cos(gap))) turn FROM u)
SELECT attempt_id, round(sum(dist),6) normalized_path_length, round(quantile_cont(speed,0.1),6) normalized_speed_p10, round(quantile_cont(speed,0.5),6) normalized_speed_p50, round(quantile_cont(speed,0.9),6) normalized_speed_p90, round(coalesce(avg(turn),0),6) turn_angle_mean, round(coalesce(stddev_pop(turn),0),6) turn_angle_std, count(*) FILTER (begins) dwell_burst_count FROM b GROUP BY 1""")
def features_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.normalised(trace(spark, sf_dir), WIDTH, HEIGHT)
    return out.select("attempt_id", *[rounded(F.col(c)).alias(c) if c != "dwell_burst_count" else F.col(c) for c in out.columns[1:]])


#: Defects put into traces, so that each of the gate's rules has attempts that break it: the kind of defect follows from the attempt.
DEFECTS = 20


def _gated(spark: SparkSession, sf_dir: str, defects: bool = True) -> DataFrame:
    w = Window.partitionBy("attempt_id")
    kind = F.when(F.col("seq") == 0, "pointerdown").when(F.col("seq") == F.max("seq").over(w), "pointerup").otherwise("pointermove")
    c = (F.col("user_id") * 7 + F.col("ano")) % DEFECTS if defects else F.lit(0)
    rows = trace(spark, sf_dir).withColumns({"pointer_type": kind, "c": c, "end": F.max("t").over(w)})
    rows = rows.where("c <> 1 or seq = 0")
    at = lambda code, *others: F.col("c").isin(code, *others)
    one = F.col("seq") == 1
    early = F.col("seq").isin(1, 2)
    rows = rows.select(
        "attempt_id",
        F.when(at(2) & (F.col("seq") >= 1), F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"),
        F.when(at(3), -F.col("t")).when(at(8), 0).when(at(11) & early, 0).otherwise(F.col("t")).alias("t"),
        F.when(at(6) & one, float("nan")).when(at(7) & one, F.col("x") + 2_000).when(at(9), 1.0).when(at(11) & early, 5.0).when(at(16) & one, None).otherwise(F.col("x")).alias("x"),
        F.when(at(9), 1.0).when(at(11) & early, 5.0).otherwise(F.col("y")).alias("y"),
        F.when(at(10) & one, -0.5).otherwise(F.col("x") / WIDTH).alias("x_normalized"),
        (F.col("y") / HEIGHT).alias("y_normalized"),
        F.when(at(15), None).when(at(4) & (F.col("seq") == 0), "pointermove").when(at(5) & (F.col("pointer_type") == "pointerup"), "pointermove").otherwise(F.col("pointer_type")).alias("pointer_type"),
        F.when(~at(14), F.when(at(13), F.col("end") + 6_000).otherwise(-100)).cast("long").alias("presented"),
        F.when(at(12), -1_100).when(at(13), F.col("end") + 6_100).otherwise(F.col("end") + 100).cast("long").alias("submitted"),
    )
    return quality.gate(rows, WIDTH, HEIGHT, "presented", "submitted", enforced=True)


GATE = f"""{EV}, p0 AS (SELECT *, CASE WHEN seq=0 THEN 'pointerdown' WHEN seq=max(seq) OVER w THEN 'pointerup' ELSE 'pointermove' END k0, (user_id*7+ano)%{DEFECTS} c, max(t) OVER w te FROM ev WINDOW w AS (PARTITION BY attempt_id)),
p1 AS (SELECT attempt_id, CASE WHEN c=2 AND seq>=1 THEN seq+1 ELSE seq END seq, CASE WHEN c=3 THEN -t WHEN c=8 OR (c=11 AND seq IN (1,2)) THEN 0 ELSE t END t, CASE WHEN c=6 AND seq=1 THEN 'NaN'::DOUBLE WHEN c=7 AND seq=1 THEN x+2000 WHEN c=9 THEN 1.0 WHEN c=11 AND seq IN (1,2) THEN 5.0 WHEN c=16 AND seq=1 THEN NULL ELSE x END x,
 CASE WHEN c=9 THEN 1.0 WHEN c=11 AND seq IN (1,2) THEN 5.0 ELSE y END y, CASE WHEN c=10 AND seq=1 THEN -0.5 ELSE x/500 END xn, y/200 yn, CASE WHEN c=15 THEN NULL WHEN c=4 AND seq=0 THEN 'pointermove' WHEN c=5 AND k0='pointerup' THEN 'pointermove' ELSE k0 END pt,
 CASE WHEN c=14 THEN NULL WHEN c=13 THEN te+6000 ELSE -100 END pr, CASE WHEN c=12 THEN -1100 WHEN c=13 THEN te+6100 ELSE te+100 END su FROM p0 WHERE c<>1 OR seq=0),
p AS (SELECT *, row_number() OVER w>1 AND NOT coalesce(t>=lag(t) OVER w,false) back FROM p1 WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
g AS (SELECT attempt_id, count(*) n, min(seq)=0 AND max(seq)=count(*)-1 AND count(DISTINCT seq)=count(*) sq, bool_or(back) back, coalesce(bool_or(pt='pointerdown'),false) dn, coalesce(bool_or(pt IN ('pointerup','pointercancel')),false) up, bool_or(coalesce(isnan(x) OR isinf(x) OR isnan(y) OR isinf(y) OR isnan(xn) OR isnan(yn),false)) odd, count(*) FILTER ((x < -250 OR x > 750 OR y < -100 OR y > 300) AND NOT isnan(x)) outs,
 sum(coalesce((xn<0 OR xn>1) AND NOT isnan(xn),false)::INT+coalesce(yn<0 OR yn>1,false)::INT) loose, max_by(t,seq)-min_by(t,seq) span, count(*)-count(DISTINCT (t,)) ts, count(*)-count(DISTINCT {{'a':pt,'b':t,'c':x,'d':y}}) ks, count(DISTINCT {{'a':x,'b':y}}) ps, min(t) f, max(t) l, max(pr) pr, max(su) su FROM p GROUP BY 1),
v AS (SELECT *, CASE WHEN pr IS NULL OR su IS NULL THEN 'missing_server_timing' WHEN su<pr THEN 'submitted_before_presented' WHEN NOT (f>=pr-5000 AND l<=su+5000 AND l-f<=su-pr+5000) THEN 'event_timestamps_outside_server_window' END tm FROM g),
r AS (SELECT *, CASE WHEN n<2 THEN 'event_count_lt_2' ELSE concat_ws(';', CASE WHEN NOT sq THEN 'seq_not_sequential' END, CASE WHEN back THEN 't_ms_decreasing' END, CASE WHEN NOT dn THEN 'missing_pointerdown' END, CASE WHEN NOT up THEN 'missing_pointerup_or_cancel' END, CASE WHEN odd THEN 'non_finite_value' END, CASE WHEN outs>0 THEN 'coordinates_out_of_bounds' END, CASE WHEN span<=0 THEN 'duration_not_positive' END, CASE WHEN ps<2 THEN 'too_few_distinct_coordinates' END, tm) END h,
 CASE WHEN n<2 THEN '' ELSE concat_ws(';', CASE WHEN loose>0 THEN 'normalized_out_of_range' END, CASE WHEN ts>0 THEN 'duplicate_timestamps' END, CASE WHEN ks>0 THEN 'duplicate_events' END) END s FROM v),
q AS (SELECT attempt_id, CASE WHEN h<>'' THEN 'rejected' WHEN s<>'' THEN 'pending' ELSE 'valid' END status, CASE WHEN h<>'' THEN h ELSE s END reasons, n, ts, ps, outs, CASE WHEN su>=pr THEN su-pr END sd FROM r)"""


@query(f"WITH {GATE} SELECT attempt_id, status, reasons, n event_count, CASE WHEN n>=2 THEN ts END duplicate_timestamp_count, CASE WHEN n>=2 THEN ps END distinct_coordinates, CASE WHEN n>=2 THEN outs END out_of_bounds_count, CASE WHEN n>=2 THEN sd END server_duration_ms FROM q")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = ("event_count", "duplicate_timestamp_count", "distinct_coordinates", "out_of_bounds_count", "server_duration_ms")
    return _gated(spark, sf_dir).select("attempt_id", "status", "reasons", *[F.col("checks")[m].cast("long").alias(m) for m in measured])


@query(f"WITH {GATE}, e AS (SELECT unnest(string_split(reasons,';')) reason FROM q) SELECT reason, count(*) n FROM e WHERE reason<>'' GROUP BY 1")
def quality_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reason_counts(_gated(spark, sf_dir))


@query(f"""WITH {EV}, d AS (SELECT *, sum((kind='pointerdown')::INT) OVER (PARTITION BY user_id ORDER BY ano, seq) drag, kind='pointerup' up FROM ev),
r AS (SELECT *, coalesce(sum(up::INT) OVER (PARTITION BY user_id, drag ORDER BY ano, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) rel FROM d WHERE drag>0)
SELECT user_id, CAST(drag AS BIGINT) drag, count(*) n_events, count(*) FILTER (kind='pointermove') n_moves, bool_or(up) closed FROM r WHERE rel=0 GROUP BY 1,2 HAVING bool_or(up) OR count(*)>1""")
def split_drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.drags(trace(spark, sf_dir))


@query(f"""WITH {EV}, c AS (SELECT *, coalesce((t-lag(t) OVER (PARTITION BY attempt_id ORDER BY seq)>100)::INT,0) cut FROM ev), b AS (SELECT *, sum(cut) OVER (PARTITION BY attempt_id ORDER BY seq) burst FROM c)
SELECT attempt_id, CAST(burst AS BIGINT) burst, count(*) n, CAST(min(t) AS BIGINT) "start", CAST(max(t) AS BIGINT) "end" FROM b GROUP BY 1,2 HAVING count(*)>=3""")
def aim_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.bursts(trace(spark, sf_dir), 100, 3)


@query(f"""WITH {EV}, c AS (SELECT *, coalesce((t-lag(t) OVER (PARTITION BY attempt_id ORDER BY seq)>400)::INT,0) cut FROM ev), b AS (SELECT *, sum(cut) OVER (PARTITION BY attempt_id ORDER BY seq) burst FROM c), g AS (SELECT attempt_id, burst, count(*) n, min(t) s, max(t) e FROM b GROUP BY 1,2)
SELECT attempt_id, max_by(n,burst) n, CAST(max_by(s,burst) AS BIGINT) "start", CAST(max_by(e,burst) AS BIGINT) "end" FROM g GROUP BY 1""")
def trim_aim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.last_burst(trace(spark, sf_dir))


PRINTS = f"""{EV}, o AS (SELECT *, x-first_value(x) OVER w px, y-first_value(y) OVER w py FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
fp AS (SELECT user_id, ano, attempt_id, CASE WHEN count(*)>=2 THEN sha256(count(*)||';'||string_agg(CAST(round_even(px*1000000,0) AS BIGINT)||','||CAST(round_even(py*1000000,0) AS BIGINT), ';' ORDER BY seq)) END fingerprint, max(t)-min(t) duration, max_by(x,seq) end_x, max_by(y,seq) end_y, max(at_us) at_us FROM o GROUP BY 1,2,3)"""


@query(f"WITH {PRINTS} SELECT attempt_id, fingerprint FROM fp")
def path_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.fingerprints(trace(spark, sf_dir)).select("attempt_id", "fingerprint")


#: Paths at 32 even steps of arc length, around their mean and of unit norm.
SHAPES = """z0 AS (SELECT user_id, ano, attempt_id, seq, x, y, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2) s FROM ev WHERE isfinite(x) AND isfinite(y) WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)), z1 AS (SELECT *, sum(coalesce(s,0)) OVER (PARTITION BY attempt_id ORDER BY seq) arc FROM z0 WHERE s IS NULL OR s>1e-12),
z2 AS (SELECT *, lead(arc) OVER w na, lead(x) OVER w nx, lead(y) OVER w ny, max(arc) OVER (PARTITION BY attempt_id) tot FROM z1 WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
z3 AS (SELECT attempt_id, i, max_by({'a':arc,'n':na,'x':x,'y':y,'u':nx,'v':ny},arc) g, any_value(tot) tot FROM z2, range(32) r(i) WHERE na IS NOT NULL AND tot>0 AND arc<=i*tot/31 GROUP BY 1,2),
z4 AS (SELECT attempt_id, i, g.x+least(1,greatest(0,(i*tot/31-g.a)/(g.n-g.a)))*(g.u-g.x) px, g.y+least(1,greatest(0,(i*tot/31-g.a)/(g.n-g.a)))*(g.v-g.y) py FROM z3), z5 AS (SELECT attempt_id, i, px-avg(px) OVER w px, py-avg(py) OVER w py FROM z4 WINDOW w AS (PARTITION BY attempt_id)),
un AS (SELECT attempt_id, i, px/sqrt(sum(px*px+py*py) OVER w) px, py/sqrt(sum(px*px+py*py) OVER w) py FROM z5 WINDOW w AS (PARTITION BY attempt_id))"""
#: The greatest similarity of pairs (attempt_id, source).
LIKE = """l0 AS (SELECT p.attempt_id, p.source, sum(a.px*b.px) xx, sum(a.px*b.py) xy, sum(a.py*b.px) yx, sum(a.py*b.py) yy FROM pairs p JOIN un a ON a.attempt_id=p.attempt_id JOIN un b ON b.attempt_id=p.source AND b.i=a.i GROUP BY 1,2),
lk AS (SELECT attempt_id, max(1/(1+4*sqrt(greatest(2-2*sqrt(greatest(xx*xx+xy*xy+yx*yx+yy*yy+2*abs(xx*yy-xy*yx),0)),0)))) best FROM l0 GROUP BY 1)"""


@query(f"""WITH {PRINTS}, {SHAPES}, pr AS (SELECT f.attempt_id, h.attempt_id source, h.fingerprint=f.fingerprint ex, abs(h.duration-f.duration)<=2 rd, abs(h.end_x-f.end_x)<=50 AND abs(h.end_y-f.end_y)<=50 re, f.at_us-h.at_us<=86400000000 rc, row_number() OVER (PARTITION BY f.attempt_id ORDER BY h.at_us DESC, h.ano DESC) rk FROM fp f JOIN fp h ON f.user_id=h.user_id AND h.ano<f.ano AND f.at_us-h.at_us BETWEEN 0 AND 864000000000)
, g AS (SELECT attempt_id, bool_or(ex) ex, count(*) FILTER (rd) rd, count(*) FILTER (re) re, count(*) FILTER (rc) rc FROM pr WHERE rk<=50 GROUP BY 1), pairs AS (SELECT attempt_id, source FROM pr WHERE rk<=50), {LIKE}
SELECT fp.attempt_id, coalesce(ex,false) exact_replay_detected, coalesce(rd,0) repeated_duration_count, coalesce(re,0) repeated_endpoint_count, coalesce(rc,0) recent_attempt_count, round(coalesce(rc,0)*60000000.0/86400000000,6) attempts_per_minute, round(coalesce(best,0),6) max_similarity FROM fp LEFT JOIN g USING (attempt_id) LEFT JOIN lk USING (attempt_id)""")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _history(trace(spark, sf_dir), end_tolerance=50.0, recent_us=86_400_000_000)
    return out.select(*[c for c in out.columns if c not in ("attempts_per_minute", "max_similarity")], *[rounded(F.col(c)).alias(c) for c in ("attempts_per_minute", "max_similarity")])


def _history(rows: DataFrame, window_us: int = 864_000_000_000, newest: int = 50, **how: float) -> DataFrame:
    """The replay features of each attempt, the greatest similarity to its session's past among them."""
    prints = replay.fingerprints(rows)
    shapes = prints.select("user_id", "ano", "attempt_id", "at_us").join(replay.resampled(rows).select("attempt_id", "xs", "ys"), "attempt_id", "left")
    like = replay.best_before(shapes.withColumn("u", replay.unit(F.col("xs"), F.col("ys"))), "user_id", ["at_us", "ano"], "attempt_id", newest, ("at_us", window_us))
    return replay.history(prints, window_us, newest, **how).join(like.select("attempt_id", F.col("best").alias("max_similarity")), "attempt_id", "left").withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0)))


@query("""WITH d AS (SELECT doc_id, source, sha256(text) h FROM documents WHERE text IS NOT NULL) SELECT doc_id, row_number() OVER (PARTITION BY h ORDER BY doc_id)>1 seen_before FROM d""")
def global_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"), F.lit(0).alias("all"))
    return replay.seen_before(docs, "all", "h", ["doc_id"]).select("doc_id", "seen_before")


@query("""WITH f AS (SELECT vec_id, label, [e::DOUBLE FOR e, i IN embedding IF i%2=1] xs, [e::DOUBLE FOR e, i IN embedding IF i%2=0] ys FROM embeddings), c AS (SELECT vec_id, label, [v-list_sum(xs)/len(xs) FOR v IN xs] xs, [v-list_sum(ys)/len(ys) FOR v IN ys] ys FROM f),
n AS (SELECT *, sqrt(list_sum([v*v FOR v IN xs])+list_sum([v*v FOR v IN ys])) nm FROM c), p AS (SELECT vec_id, label, [v/nm FOR v IN xs] xs, [v/nm FOR v IN ys] ys FROM n),
q AS (SELECT b.vec_id, list_dot_product(b.xs,a.xs) a1, list_dot_product(b.xs,a.ys) b1, list_dot_product(b.ys,a.xs) c1, list_dot_product(b.ys,a.ys) d1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) rn FROM p) b JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) rn FROM p) a ON a.label=b.label AND a.rn<b.rn),
g AS (SELECT vec_id, max(1/(1+4*sqrt(greatest(2-2*sqrt(greatest(a1*a1+b1*b1+c1*c1+d1*d1+2*abs(a1*d1-b1*c1),0)),0)))) best, count(*) n FROM q GROUP BY 1)
SELECT vec_id, round(coalesce(best,0),6) best, coalesce(n,0) n FROM embeddings LEFT JOIN g USING (vec_id)""")
def procrustes_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.procrustes_best(table(spark, sf_dir, "embeddings"), "label", "vec_id").withColumn("best", rounded(F.col("best")))


@query(f"""WITH {SCORED}, q AS (SELECT attempt_id, score human_score, user_id%7=0 ex, other similarity, ano*1.0 apm, user_id%11=0 rej FROM a),
r0 AS (SELECT *, (1-human_score)*50 r FROM q), r1 AS (SELECT * REPLACE (CASE WHEN human_score<0.5 THEN greatest(r,40) ELSE r END AS r) FROM r0), r2 AS (SELECT * REPLACE (CASE WHEN ex THEN greatest(r,80) ELSE r END AS r) FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN similarity>=0.9 THEN greatest(r+35,40) ELSE r END AS r) FROM r2), r4 AS (SELECT * REPLACE (CASE WHEN apm>=3 THEN greatest(r+30,40) ELSE r END AS r) FROM r3), r5 AS (SELECT *, least(100,greatest(0,CASE WHEN rej THEN greatest(r,40) ELSE r END)) s FROM r4), r6 AS (SELECT *, round(s,2) v FROM r5)
SELECT attempt_id, CAST(v AS DOUBLE) risk_score, CASE WHEN v>=70 THEN 'high' WHEN v>=40 THEN 'medium' ELSE 'low' END risk_level, CASE WHEN v>=70 THEN 'step_up_and_rate_limit' WHEN v>=40 THEN 'step_up' ELSE 'allow' END action, concat_ws(';', CASE WHEN human_score<0.5 THEN 'ml_bot_score' END, CASE WHEN ex THEN 'exact_trace_fingerprint' END, CASE WHEN similarity>=0.9 THEN 'dtw_similar_trace' END, CASE WHEN apm>=3 THEN 'session_rate_exceeded' END, CASE WHEN rej THEN 'invalid_event_telemetry' END) reasons FROM r6""")
def risk_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("attempt_id", F.col("score").alias("human_score"), (F.col("user_id") % 7 == 0).alias("exact_replay_detected"), F.col("other").alias("similarity"), F.col("ano").cast("double").alias("attempts_per_minute"), (F.col("user_id") % 11 == 0).alias("quality_rejected"))
    return risk.fuse(rows, risk.Policy(similarity_threshold=0.9, most_per_minute=3.0)).select("attempt_id", "risk_score", "risk_level", "action", "reasons")


@query("""SELECT o_orderstatus action, count(*) n, count(*) FILTER (o_totalprice>200000) passed, round(count(*) FILTER (o_totalprice>200000)/count(*),6) pass_rate, round(count(*)/sum(count(*)) OVER (),6) part FROM orders GROUP BY 1""")
def shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.count_if(F.col("o_totalprice") > 200000)
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("action")).agg(F.count("*").alias("n"), passed.alias("passed"))
    return out.select("action", "n", "passed", rounded(F.col("passed") / F.col("n")).alias("pass_rate"), rounded(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("part"))


@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (human AND score>=0.5) tp, count(*) FILTER (NOT human AND score>=0.5) fp, count(*) FILTER (human AND score<0.5) fn, count(*) FILTER (NOT human AND score<0.5) tn FROM a)
SELECT tp, fp, fn, tn, round((tp+tn)/(tp+fp+fn+tn),6) accuracy, round(tp/(tp+fp),6) "precision", round(tp/(tp+fn),6) recall, round(2*tp/(2*tp+fp+fn),6) f1, round(fn/(tp+fn),6) human_rejected, round(tn/(fp+tn),6) bot_recall FROM c""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.confusion(scored(spark, sf_dir).withColumn("predicted", F.col("score") >= 0.5))
    return out.select(*out.columns[:4], *[rounded(F.col(c)).alias(c) for c in out.columns[4:]])


@query(f"""WITH {SCORED}, w AS (SELECT sum(CASE WHEN h.score>b.score THEN 1.0 WHEN h.score=b.score THEN 0.5 ELSE 0 END)/count(*) auc FROM a h JOIN a b ON h.human AND NOT b.human) SELECT round(auc,6) auc, round(greatest(auc,1-auc),6) folded_auc FROM w""")
def rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.rank_auc(scored(spark, sf_dir), "human", "score")
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(f"""WITH {SCORED}, t AS (SELECT DISTINCT score FROM a UNION SELECT 0.5), m AS (SELECT t.score threshold, count(*) FILTER (a.human AND a.score<t.score)/count(*) FILTER (a.human) rejected, count(*) FILTER (NOT a.human AND a.score<t.score)/count(*) FILTER (NOT a.human) caught FROM t, a GROUP BY 1)
SELECT round(threshold,6) threshold, round(rejected,6) human_rejected, round(caught,6) bot_recall FROM m WHERE rejected<=0.05 ORDER BY m.caught DESC, m.threshold DESC LIMIT 1""")
def threshold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = calibrate.counts(scored(spark, sf_dir), "human", "score")
    out = calibrate.threshold(held, 0.05)
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@query(f"""WITH {SCORED}, u AS (SELECT human, 'score' feature, score v FROM a UNION ALL SELECT human, 'other', other FROM a UNION ALL SELECT human, 'ano', ano FROM a), g AS (SELECT feature, avg(v) FILTER (human) m1, avg(v) FILTER (NOT human) m0, var_pop(v) FILTER (human) v1, var_pop(v) FILTER (NOT human) v0 FROM u GROUP BY 1)
SELECT feature, round(CASE WHEN v1+v0>0 THEN (m1-m0)/sqrt((v1+v0)/2) ELSE 0 END,6) difference FROM g""")
def feature_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.separation(scored(spark, sf_dir), "human", ["score", "other", "ano"]).withColumn("difference", rounded(F.col("difference")))


@query(f"WITH {SCORED} SELECT human, count(*) n, round(min(score),6) low, round(quantile_cont(score,0.25),6) p25, round(quantile_cont(score,0.5),6) p50, round(quantile_cont(score,0.75),6) p75, round(max(score),6) high, round(avg((score>=0.5)::INT),6) pass_rate FROM a GROUP BY 1")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.summary(scored(spark, sf_dir), "human", "score", 0.5)
    return out.select("human", "n", *[rounded(F.col(c)).alias(c) for c in out.columns[2:]])


@query("""WITH g AS (SELECT source, count(*) FILTER (toxic=1) hits, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY 1), z AS (SELECT *, hits/n p, 1.959963984540054 z FROM g)
SELECT source, hits, n, round(greatest((p+z*z/(2*n))/(1+z*z/n)-z*sqrt(p*(1-p)/n+z*z/(4.0*n*n))/(1+z*z/n),0),6) wilson_low, round(least((p+z*z/(2*n))/(1+z*z/n)+z*sqrt(p*(1-p)/n+z*z/(4.0*n*n))/(1+z*z/n),1),6) wilson_high FROM z""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("hits"), F.count("*").alias("n"))
    out = evaluate.wilson(rows, "hits", "n")
    return out.select("source", "hits", "n", rounded(F.col("wilson_low")).alias("wilson_low"), rounded(F.col("wilson_high")).alias("wilson_high"))


@query(f"WITH {SCORED} SELECT attempt_id, round((SELECT count(*) FROM a r WHERE r.human AND r.score<=a.score)/(SELECT count(*) FROM a WHERE human),6) percentile FROM a")
def anomaly_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return evaluate.anomaly_percentile(rows, rows.where("human"), "score").select("attempt_id", rounded(F.col("percentile")).alias("percentile"))


@query("""SELECT c_custkey, CASE WHEN b<0.7 THEN 'train' WHEN b<0.85 THEN 'validation' ELSE 'test' END part FROM (SELECT c_custkey, CAST('0x'||substr(sha256('salt:'||c_custkey),1,8) AS BIGINT)/4294967296.0 b FROM customer)""")
def salted_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.salted_split(table(spark, sf_dir, "customer"), "c_custkey", "salt", (("train", 0.7), ("validation", 0.15), ("test", 0.15))).select("c_custkey", "part")


@query("""WITH s AS (SELECT o_custkey, o_orderkey%2 half FROM orders) SELECT count(DISTINCT o_custkey) leaking FROM (SELECT o_custkey FROM s WHERE half=0 INTERSECT SELECT o_custkey FROM s WHERE half=1)""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 2).alias("half"))
    return rows.groupBy("o_custkey").agg(F.count_distinct("half").alias("halves")).agg(F.count_if(F.col("halves") > 1).alias("leaking"))


@query("""WITH d AS (SELECT a.vec_id, sqrt(list_sum([(x::DOUBLE-y)*(x::DOUBLE-y) FOR (x,y) IN list_zip(a.embedding,b.embedding)])) d FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id AND a.vec_id%50=0), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) k FROM d) SELECT vec_id, round(avg(d),6) mean_distance FROM r WHERE k<=15 GROUP BY 1""".replace("[(x::DOUBLE-y)*(x::DOUBLE-y) FOR (x,y) IN list_zip(a.embedding,b.embedding)]", "list_transform(list_zip(a.embedding,b.embedding), lambda p: (p[1]::DOUBLE-p[2])*(p[1]::DOUBLE-p[2]))"))
def knn_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return evaluate.nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 15).withColumn("mean_distance", rounded(F.col("mean_distance")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) k FROM orders) SELECT o_custkey, o_orderkey latest FROM r WHERE k=1""")
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("""WITH l AS (SELECT source, count(*) n FROM documents WHERE lang='en' GROUP BY 1), r AS (SELECT source, count(*) m FROM documents WHERE lang='es' GROUP BY 1) SELECT source, coalesce(n,0) left_n, coalesce(m,0) right_n FROM l FULL JOIN r USING (source)""")
def summary_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    side = lambda lang, n: docs.where(F.col("lang") == lang).groupBy("source").agg(F.count("*").alias(n))
    return side("en", "left_n").join(side("es", "right_n"), "source", "full_outer").select("source", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


@query("""SELECT count(*) "rows", count(DISTINCT user_id) participants, count(DISTINCT event_type) families, count(*) FILTER (props IS NULL) missing, count(*) FILTER (user_id%3=0) bots, round(count(*) FILTER (user_id%3=0)/count(*),6) bot_share FROM events""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    bot = F.count_if(F.col("user_id") % 3 == 0)
    return table(spark, sf_dir, "events").agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("participants"), F.count_distinct("event_type").alias("families"), F.count_if(F.col("props").isNull()).alias("missing"), bot.alias("bots"), rounded(bot / F.count("*")).alias("bot_share"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + count(*) OVER (PARTITION BY user_id) - count(*) OVER (PARTITION BY user_id, ts) + row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) - 1 earlier FROM events""")
def session_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier events of the user in the last three days; of equal times only those before."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    within = Window.partitionBy("user_id").orderBy("us").rangeBetween(-259_200_000_000, 0)
    same = Window.partitionBy("user_id", "us")
    rows = table(spark, sf_dir, "events").withColumn("us", at)
    return rows.select("event_id", (F.count("*").over(within) - F.count("*").over(same) + F.row_number().over(same.orderBy("event_id")) - 1).alias("earlier"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(*[table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")])


LEARN = """ans AS (SELECT o_custkey student, substr(p_brand,1,7) concept, p_partkey question, p_size/50.0 difficulty, l_orderkey presentation, l_linenumber line, CAST(l_shipdate AS DATE) answered_at, l_returnflag<>'R' correct, p_size%5 options, l_extendedprice price, l_suppkey supplier FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey),
ms AS (SELECT student, concept, count(*) attempts, count(*) FILTER (correct) correct, avg(CASE WHEN options>=2 THEN 1.0/options ELSE 0 END) guess FROM ans GROUP BY 1,2),
mt AS (SELECT *, greatest(0,least(1,CASE WHEN guess>=1 THEN (correct+2)/(attempts+4) ELSE ((correct+2)/(attempts+4)-guess)/(1-guess) END)) mastery FROM ms)"""
_ORDER = ["answered_at", "presentation", "line", "question", "price", "supplier"]


@query("WITH " + LEARN + " SELECT student, concept, attempts, correct, round(mastery,6) mastery, round(guess,6) guess, attempts<3 diagnostic_needed FROM mt")
def concept_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.mastery(_answers(spark, sf_dir)).withColumn("mastery", rounded(F.col("mastery"))).withColumn("guess", rounded(F.col("guess")))


@query("WITH " + LEARN + """, t AS (SELECT *, row_number() OVER (PARTITION BY student, presentation ORDER BY line, question, price, supplier, answered_at) try FROM ans), f AS (SELECT *, row_number() OVER (PARTITION BY student, presentation, concept ORDER BY try) k FROM t WHERE try<=3)
SELECT student, presentation, concept, CAST(try AS BIGINT) try, correct FROM f WHERE k=1""")
def presentation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learning.counted(_answers(spark, sf_dir), ["line", "question", "price", "supplier", "answered_at"])
    return out.select("student", "presentation", "concept", F.col("try").cast("long").alias("try"), "correct")


@query("WITH " + LEARN + """, r AS (SELECT *, row_number() OVER (PARTITION BY student, concept ORDER BY answered_at DESC, presentation DESC, line DESC, question DESC, price DESC, supplier DESC) age FROM ans),
sg AS (SELECT student, concept, avg((NOT correct)::INT) FILTER (age<=5) recent, max(answered_at) last, coalesce(avg((NOT correct)::INT) FILTER (difficulty>=0.7),0) hard FROM r GROUP BY 1,2),
w AS (SELECT student, concept, mastery, 0.45*(1-mastery) a, 0.30*recent b, 0.15*greatest(0,least(1,date_diff('day',last,DATE '1998-12-01')/30.0)) c, 0.10*hard d FROM mt JOIN sg USING (student, concept) WHERE attempts>=3),
v AS (SELECT student, concept, round(mastery,4) mastery, round(a+b+c+d,4) weakness, CASE WHEN a>=greatest(b,c,d) THEN 'mastery' WHEN b>=greatest(c,d) THEN 'recent' WHEN c>=d THEN 'review' ELSE 'hard' END reason, CASE WHEN mastery<0.4 THEN 'easy' WHEN mastery<0.7 THEN 'medium' ELSE 'hard' END target_band FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY student ORDER BY weakness DESC, concept) "rank" FROM v) SELECT student, concept, mastery, weakness, reason, target_band, "rank" FROM k WHERE "rank"<=3""")
def weak_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.weak_concepts(_answers(spark, sf_dir), F.lit("1998-12-01").cast("date"), _ORDER)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From events to explained decisions: gate, features, history, fusion; one row per attempt."""
    rows = trace(spark, sf_dir)
    gated = _gated(spark, sf_dir, defects=False).select("attempt_id", (F.col("status") == "rejected").alias("quality_rejected"))
    past = _history(rows)
    joined = features.basic(rows).select("attempt_id", "linearity").join(gated, "attempt_id").join(past, "attempt_id")
    joined = joined.withColumn("human_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("linearity")))).withColumnRenamed("max_similarity", "similarity")
    return risk.fuse(joined).select("attempt_id", "risk_score", "risk_level", "action", "reasons")
