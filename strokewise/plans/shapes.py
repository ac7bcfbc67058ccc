"""Registered queries of shape, rhythm and correction features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokewise.functions.rounding import rounded
from strokewise.operators import shape
from strokewise.plans.catalog import EV, query, trace
from strokewise.sources.adapters import HEIGHT, WIDTH

_CORR = lambda a, b: f"coalesce(CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)*stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)*count({a}+{b})>1e-12 THEN greatest(-1,least(1,covar_pop({b},{a})/(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END)*stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)))) END,0)"
_ENTROPY = lambda name, source, value, bins: f"""{name}_r AS (SELECT attempt_id, {value} v, min({value}) OVER (PARTITION BY attempt_id) lo, max({value}) OVER (PARTITION BY attempt_id) hi FROM {source} WHERE {value} IS NOT NULL),
{name}_c AS (SELECT attempt_id, least(floor((v-lo)/(hi-lo)*{bins}),{bins - 1}) cell, count(*) n FROM {name}_r WHERE hi>lo GROUP BY 1,2),
{name} AS (SELECT attempt_id, (ln(sum(n))-sum(n*ln(n))/sum(n))/ln({bins}) e FROM {name}_c GROUP BY 1)"""  # noqa: E731
PARTS = f"""{EV.replace("value x", "value/500.0 x").replace("yy y,", "yy/200.0 y,")}, d AS (SELECT *, x-lag(x) OVER w dx, y-lag(y) OVER w dy, CAST(greatest(t-lag(t) OVER w,0) AS DOUBLE) dt FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
p0 AS (SELECT *, sqrt(dx*dx+dy*dy) dist, CASE WHEN dt>0 THEN sqrt(dx*dx+dy*dy)/dt ELSE 0.0 END speed FROM d WHERE dx IS NOT NULL),
p1 AS (SELECT *, (speed-lag(speed) OVER (PARTITION BY attempt_id ORDER BY seq))/greatest(dt,1e-9) accel FROM p0),
p AS (SELECT *, (accel-lag(accel) OVER (PARTITION BY attempt_id ORDER BY seq))/greatest(dt,1e-9) jerk, row_number() OVER (PARTITION BY attempt_id ORDER BY seq)-1 k, count(*) OVER (PARTITION BY attempt_id) m, sum(dist) OVER (PARTITION BY attempt_id ORDER BY seq) gone, sum(dist) OVER (PARTITION BY attempt_id) total,
 greatest(0.002, coalesce(quantile_cont(CASE WHEN dist>0 THEN dist END,0.25) OVER (PARTITION BY attempt_id)*0.5,0.002)) micro, greatest(100.0, quantile_cont(dt,0.9) OVER (PARTITION BY attempt_id)) longest FROM p1)"""


@query(f"""WITH {PARTS},
base_f AS (SELECT attempt_id, stddev_pop(accel) a, stddev_pop(jerk) j, avg((dist<=micro)::INT) micro FROM p GROUP BY 1),
mv AS (SELECT *, atan2(dy,dx) h, count(*) OVER (PARTITION BY attempt_id) moves FROM p WHERE dist>1e-9), tg AS (SELECT *, h-lag(h) OVER (PARTITION BY attempt_id ORDER BY seq) gap FROM mv),
tn AS (SELECT *, atan2(sin(gap),cos(gap)) turn, abs(atan2(sin(gap),cos(gap))) size FROM tg WHERE gap IS NOT NULL), tc AS (SELECT *, abs(size-lag(size) OVER (PARTITION BY attempt_id ORDER BY seq)) change FROM tn),
tf AS (SELECT attempt_id, quantile_cont(size,0.9) p90, CASE WHEN max(moves)>=3 THEN coalesce(avg(change),0) ELSE 0 END smooth, CASE WHEN max(moves)>=3 THEN {_CORR('speed', 'size')} ELSE 0 END sc FROM tc GROUP BY 1),
sg AS (SELECT attempt_id, sign(turn) s, lag(sign(turn)) OVER (PARTITION BY attempt_id ORDER BY seq) b FROM tn WHERE size>1e-6), sf AS (SELECT attempt_id, avg((s<>b)::INT) ratio FROM sg GROUP BY 1),
sp AS (SELECT *, lag(speed) OVER w last, lead(speed) OVER w nxt, quantile_cont(speed,0.5) OVER (PARTITION BY attempt_id)+stddev_pop(speed) OVER (PARTITION BY attempt_id) fl, max(speed) OVER (PARTITION BY attempt_id) top FROM p WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)),
sq AS (SELECT *, min(CASE WHEN speed=top THEN k END) OVER (PARTITION BY attempt_id) peak FROM sp),
sr AS (SELECT attempt_id, max(m) m, count(*) FILTER (speed>last AND speed>=nxt AND speed>fl) peaks, max(peak) peak, max(top) top, coalesce(avg(speed) FILTER (k<greatest(1,ceil(m*0.25))),0) early, coalesce(avg(speed) FILTER (k>=floor(m*0.35) AND k<greatest(1,ceil(m*0.65))),0) middle, coalesce(avg(speed) FILTER (k>=floor(m*0.75)),0) late,
 coalesce(avg(greatest(speed-last,0)) FILTER (k>0 AND k<=peak),0) rise, coalesce(avg(greatest(last-speed,0)) FILTER (k>peak),0) fall, avg(speed) mean, sum(dist) path, list(speed ORDER BY k) sl, CAST(greatest(2,ceil(max(m)*0.2)) AS INT) wd FROM sq GROUP BY 1),
ss AS (SELECT *, m>=3 AND top>1e-12 ok, CASE WHEN m>=3 THEN list_max([list_sum(sl[i:i+wd-1]) FOR i IN range(1, m-wd+2)])/wd END rolled FROM sr),
{_ENTROPY('te', 'p', 'dt', 8)},
pg AS (SELECT attempt_id, gone/total progress FROM p WHERE dt>=longest AND total>1e-12), {_ENTROPY('pe', 'pg', 'progress', 4)},
gr AS (SELECT attempt_id, CASE WHEN max(x) OVER q-min(x) OVER q>1e-12 THEN (x-min(x) OVER q)/(max(x) OVER q-min(x) OVER q) ELSE 0 END gx, CASE WHEN max(y) OVER q-min(y) OVER q>1e-12 THEN (y-min(y) OVER q)/(max(y) OVER q-min(y) OVER q) ELSE 0 END gy FROM ev WINDOW q AS (PARTITION BY attempt_id)),
gc AS (SELECT attempt_id, least(floor(gx*4),3)*4+least(floor(gy*4),3) cell, count(*) n FROM gr GROUP BY 1,2), ge AS (SELECT attempt_id, (ln(sum(n))-sum(n*ln(n))/sum(n))/ln(16) e FROM gc GROUP BY 1),
r0 AS (SELECT attempt_id, seq, CAST(greatest(t-lag(t) OVER (PARTITION BY attempt_id ORDER BY seq),0) AS DOUBLE) dt, count(*) OVER (PARTITION BY attempt_id) n FROM ev), r1 AS (SELECT *, lag(dt) OVER (PARTITION BY attempt_id ORDER BY seq) was, count(*) OVER (PARTITION BY attempt_id) pn FROM r0 WHERE dt>0 AND n>=4),
r2 AS (SELECT *, dt-was delta, lag(dt-was) OVER (PARTITION BY attempt_id ORDER BY seq) dwas FROM r1),
rf AS (SELECT attempt_id, {_CORR('was', 'dt')} c1, CASE WHEN max(pn)>=4 THEN {_CORR('dwas', 'delta')} ELSE 0 END c2, coalesce(avg(abs(delta-dwas))/greatest(avg(dt),1),0) sd FROM r2 WHERE pn>=3 GROUP BY 1),
en AS (SELECT attempt_id, sqrt((max_by(x,seq)-min_by(x,seq))**2+(max_by(y,seq)-min_by(y,seq))**2) line FROM ev GROUP BY 1)
SELECT b.attempt_id, CASE WHEN ss.m>=3 THEN ss.peaks ELSE 0 END speed_peak_count, round(log10(1+coalesce(a,0)),6) normalized_acceleration_std, round(log10(1+coalesce(j,0)),6) normalized_jerk_std, round(coalesce(p90,0),6) turn_angle_p90, round(coalesce(ratio,0),6) turn_direction_change_ratio, round(b.micro,6) micro_move_ratio, round(coalesce(te.e,0),6) timing_entropy, round(coalesce(ge.e,0),6) spatial_entropy,
 round(CASE WHEN ok THEN peak/greatest(m-1,1) ELSE 0 END,6) speed_peak_position_ratio, round(CASE WHEN ok THEN middle/greatest((early+late)/2,1e-9) ELSE 0 END,6) mid_to_edge_speed_ratio, round(CASE WHEN ok THEN rolled/greatest(mean,1e-9) ELSE 0 END,6) speed_burst_concentration, round(CASE WHEN ok AND greatest(rise,fall)>1e-12 THEN least(rise,fall)/greatest(rise,fall) ELSE 0 END,6) peak_accel_decel_symmetry,
 round(CASE WHEN ok AND path>1e-12 THEN line/path*rolled/greatest(mean,1e-9) ELSE 0 END,6) straight_burst_score, round(coalesce(c1,0),6) interval_lag1_autocorrelation, round(coalesce(c2,0),6) interval_delta_lag1_autocorrelation, round(coalesce(sd,0),6) interval_second_difference_relative, round(coalesce(sc,0),6) speed_turn_abs_correlation, round(coalesce(smooth,0),6) turn_change_smoothness, round(coalesce(pe.e,0),6) pause_position_entropy
FROM base_f b LEFT JOIN tf USING (attempt_id) LEFT JOIN sf USING (attempt_id) LEFT JOIN ss USING (attempt_id) LEFT JOIN te USING (attempt_id) LEFT JOIN ge USING (attempt_id) LEFT JOIN pe USING (attempt_id) LEFT JOIN rf USING (attempt_id) LEFT JOIN en USING (attempt_id)""")
def features_v23(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shape.shapes(trace(spark, sf_dir), WIDTH, HEIGHT)
    wide = lambda c: rounded(F.log10(1 + F.col(c))) if c in ("normalized_acceleration_std", "normalized_jerk_std") else rounded(F.col(c))  # noqa: E731  steps of no time make these explode
    return out.select("attempt_id", "speed_peak_count", *[wide(c).alias(c) for c in out.columns[2:]])


@query(f"""WITH {EV}, e AS (SELECT *, first_value(x) OVER w x0, last_value(x) OVER w x1, first_value(y) OVER w y0, last_value(y) OVER w y1, count(*) OVER (PARTITION BY attempt_id) n, seq-min(seq) OVER (PARTITION BY attempt_id) k FROM ev WINDOW w AS (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a AS (SELECT *, sqrt((x1-x0)**2+(y1-y0)**2) axis FROM e), b AS (SELECT *, CASE WHEN axis<1e-9 THEN sqrt((x-x0)**2+(y-y0)**2) ELSE ((x-x0)*(x1-x0)+(y-y0)*(y1-y0))/axis END along FROM a),
c AS (SELECT *, along-CASE WHEN axis<1e-9 THEN 0 ELSE axis END beyond FROM b), o AS (SELECT *, beyond>1 AND NOT coalesce(lag(beyond>1) OVER (PARTITION BY attempt_id ORDER BY seq),false) begins FROM c),
ov AS (SELECT attempt_id, count(*) FILTER (begins) overshoot_count, coalesce(max(beyond) FILTER (beyond>1),0) overshoot_distance FROM o GROUP BY 1),
l AS (SELECT attempt_id, seq, t, x, y FROM c WHERE n>=2 AND CASE WHEN axis<1e-9 THEN k>=greatest(0,n-greatest(2,n//4)) ELSE along>=axis*0.75 END),
d AS (SELECT *, x-lag(x) OVER w dx, y-lag(y) OVER w dy, CAST(greatest(t-lag(t) OVER w,0) AS DOUBLE) dt FROM l WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)), s AS (SELECT *, sqrt(dx*dx+dy*dy) dist, CASE WHEN dx IS NULL THEN NULL WHEN dt>0 THEN sqrt(dx*dx+dy*dy)/dt ELSE 0.0 END speed FROM d),
m AS (SELECT *, last_value(CASE WHEN dist>=1 THEN dx END IGNORE NULLS) OVER q lx, last_value(CASE WHEN dist>=1 THEN dy END IGNORE NULLS) OVER q ly FROM s WINDOW q AS (PARTITION BY attempt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT attempt_id, count(*) FILTER (dist>=1 AND dx*lx+dy*ly<0) correction_count, CAST(greatest(max_by(t,seq)-min_by(t,seq),0) AS DOUBLE) adj, coalesce(avg(speed),0) fs FROM m GROUP BY 1)
SELECT attempt_id, overshoot_count, round(overshoot_distance,6) overshoot_distance, coalesce(correction_count,0) correction_count, coalesce(adj,0) endpoint_adjustment_time, round(coalesce(fs,0),6) final_segment_speed FROM ov LEFT JOIN f USING (attempt_id)""")
def correction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shape.corrections(trace(spark, sf_dir))
    return out.withColumns({c: rounded(F.col(c)) for c in ("overshoot_distance", "final_segment_speed")})
