"""Queries of row picks, traces, tracers and the digitize job."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, pixels, traces
from .pixel_queries import _COL, _ROW, _RUNS, _VERTICAL, LARGEST, _blur3
from .registry import nudged, query, r6, whole
from .standins import RASTER, raster

#: SQL: nulls of m (image_id, row_idx, m) filled linearly where a value stands within 50 rows.
_FILL = """near AS (SELECT *, max(CASE WHEN m IS NOT NULL THEN row_idx END) OVER (PARTITION BY image_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS lo,
  min(CASE WHEN m IS NOT NULL THEN row_idx END) OVER (PARTITION BY image_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi, count(*) OVER (PARTITION BY image_id) AS n FROM med),
fill AS (SELECT n.*, a.m AS av, b.m AS bv FROM near n LEFT JOIN med a ON a.image_id = n.image_id AND a.row_idx = n.lo LEFT JOIN med b ON b.image_id = n.image_id AND b.row_idx = n.hi),
tr AS (SELECT image_id, row_idx, n, CASE WHEN m IS NOT NULL THEN m WHEN NOT coalesce(least(row_idx - lo, hi - row_idx) <= 50, false) THEN NULL WHEN av IS NULL THEN bv WHEN bv IS NULL THEN av
  ELSE av + (row_idx - lo) / (hi - lo) * (bv - av) END AS x FROM fill)"""

_JOBS = """jobs(pos, name, mode, l, r, lv, rv) AS (VALUES (0, 'GR', 'red', 4, 60, 0.0::DOUBLE, 150.0::DOUBLE), (1, 'RHOB', 'black', 0, 64, 1.95::DOUBLE, 2.95::DOUBLE))"""
#: SQL of the digitize job over the raster: crop, blur, colour test, gridlines, gap fill, spines, picks, median, fill, scale.
_DIGITIZE = f"""{RASTER.replace('pix AS (', 'pix9 AS (')}, {_JOBS}, tall AS (SELECT image_id AS img, max(y) + 1 - 4 AS h FROM pix9 GROUP BY 1),
roi AS (SELECT p.image_id || '|' || pos AS image_id, p.image_id AS img, pos, name, lv, rv, jobs.r - l AS w, h, mode, y - 2 AS y, x - l AS x, b, g, p.r AS rr FROM pix9 p JOIN tall ON img = p.image_id, jobs WHERE x >= l AND x < jobs.r AND y >= 2 AND y < h + 2),
s1 AS (SELECT *, {_blur3('b')} AS b1, {_blur3('g')} AS g1, {_blur3('rr')} AS r1 FROM roi WINDOW {_ROW}),
s2 AS (SELECT * EXCLUDE (b1, g1, r1), round({_blur3('b1')}) AS b2, round({_blur3('g1')}) AS g2, round({_blur3('r1')}) AS r2 FROM s1 WINDOW {_COL}),
m0 AS (SELECT *, CASE mode WHEN 'red' THEN r2 > 120 AND r2 > g2 + 20 AND r2 > b2 + 20 ELSE greatest(b2, g2, r2) <= 80 END AS o FROM s2),
v0 AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS g0 FROM m0 WHERE o), v1 AS (SELECT *, min(y) OVER (PARTITION BY image_id, x, g0) AS run, count(*) OVER (PARTITION BY image_id, x, g0) AS len, least(15, h // 3) AS k FROM v0),
v2 AS (SELECT image_id, y, x, w FROM v1 WHERE h <= 15 OR len < CASE WHEN run = 0 THEN k - k // 2 WHEN run + len = h THEN k // 2 + 1 ELSE k END),
z0 AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g0 FROM v2), z1 AS (SELECT *, min(x) OVER (PARTITION BY image_id, y, g0) AS run, count(*) OVER (PARTITION BY image_id, y, g0) AS len, least(15, w // 3) AS k FROM z0),
z2 AS (SELECT image_id, y, x FROM z1 WHERE w <= 15 OR len < CASE WHEN run = 0 THEN k - k // 2 WHEN run + len = w THEN k // 2 + 1 ELSE k END),
d0 AS (SELECT m.*, CASE WHEN z.x IS NULL THEN 0 ELSE 255 END AS c FROM m0 m LEFT JOIN z2 z ON z.image_id = m.image_id AND z.y = m.y AND z.x = m.x),
d1 AS (SELECT *, {_blur3('c')} AS c1 FROM d0 WINDOW {_ROW}), d2 AS (SELECT *, CAST(round({_blur3('c1')}) AS BIGINT) AS level FROM d1 WINDOW {_COL}),
hist AS (SELECT image_id, level, count(*) AS n FROM d2 GROUP BY 1, 2), cum AS (SELECT *, sum(n) OVER u AS w0, sum(n * level) OVER u AS s0, sum(n) OVER a AS ww, sum(n * level) OVER a AS s FROM hist WINDOW u AS (PARTITION BY image_id ORDER BY level), a AS (PARTITION BY image_id)),
var AS (SELECT image_id, level, round(w0::DOUBLE * (ww - w0)::DOUBLE * power(s0::DOUBLE / w0::DOUBLE - (s - s0)::DOUBLE / (ww - w0)::DOUBLE, 2), 0) AS bv FROM cum WHERE ww > w0),
cut AS (SELECT image_id, min(level) AS threshold FROM (SELECT *, max(bv) OVER (PARTITION BY image_id) AS top FROM var) WHERE bv = top GROUP BY 1),
f0 AS (SELECT d2.*, level > coalesce(threshold, 0) AS f FROM d2 LEFT JOIN cut USING (image_id)), sp AS (SELECT image_id, x, count(*) FILTER (f) / max(h) AS share FROM f0 GROUP BY 1, 2),
f1 AS (SELECT f0.*, f AND NOT (share > 0.9 AND h >= 40 AND w >= 4) AS "on" FROM f0 JOIN sp USING (image_id, x)),
pick AS (SELECT image_id, y AS row_idx, any_value(img) AS img, any_value(name) AS name, any_value(pos) AS pos, any_value(lv) AS lv, any_value(rv) AS rv, any_value(w) AS w, any_value(h) AS h, CASE WHEN count(*) FILTER ("on") >= 2 THEN quantile_cont(x, 0.5) FILTER ("on") END AS x0 FROM f1 GROUP BY 1, 2),
med AS (SELECT *, quantile_cont(x0, 0.5) OVER (PARTITION BY image_id ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM pick), {_FILL},
done AS (SELECT img, pos, name, row_idx, h, 1000 + row_idx / greatest(1, h - 1) * 500 AS depth, coalesce(lv + tr.x / greatest(1, w - 1) * (rv - lv), -999.25) AS value, tr.x FROM tr JOIN pick USING (image_id, row_idx))"""


def _digitize(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "b", "g", "r")
    curve = lambda *v: F.struct(*(F.lit(x).alias(k) for k, x in zip(("pos", "name", "unit", "mode", "left_px", "right_px", "left_value", "right_value"), v)))
    both = F.explode(F.array(curve(0, "GR", "API", "red", 4, 60, 0.0, 150.0), curve(1, "RHOB", "G/CC", "black", 0, 64, 1.95, 2.95))).alias("c")
    sizes = pixels.sizes_of(p)
    md = F.create_map(F.lit("company"), F.lit(" Acme "), F.lit("well"), F.concat(F.lit("W "), "image_id"), F.lit("county"), F.lit("White Pine"))
    jobs = sizes.select("image_id", F.lit(2).alias("top_px"), (F.col("height") - 2).alias("bottom_px"), F.lit(1000.0).alias("top_depth"), F.lit(1500.0).alias("bottom_depth"), F.lit("ft").alias("depth_unit"), md.alias("metadata"), both)
    return traces.digitize(p, jobs.select("*", "c.*").drop("c"))


@query("trc_digitize", f"""WITH {_DIGITIZE} SELECT img AS file, CAST(row_idx AS BIGINT) AS idx, round(depth, 6) AS depth, name AS mnemonic, round(value, 6) AS value FROM done""")
def trc_digitize(spark, sf):
    """The digitize job: from pixels to the values of two curves of every image."""
    return whole(r6(_digitize(spark, sf)[0], "depth", "value"), "idx")


@query("trc_digitize_points", f"""WITH {_DIGITIZE} SELECT img AS image_id, name, count(*) AS n, round(sum(x + CASE name WHEN 'GR' THEN 4 ELSE 0 END), 4) AS x, CAST(sum(row_idx + 2) AS BIGINT) AS y FROM done WHERE x IS NOT NULL GROUP BY 1, 2""")
def trc_digitize_points(spark, sf):
    p = _digitize(spark, sf)[1].select("image_id", "name", F.explode("points").alias("p"))
    return p.groupBy("image_id", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p.x"), 4).alias("x"), F.sum("p.y").cast("long").alias("y"))


_LAS_HEAD = """'~VERSION INFORMATION' || e || ' VERS.                 1.20:   CWLS LOG ASCII STANDARD -VERSION 1.20' || e || ' WRAP.                   NO:   ONE LINE PER DEPTH STEP' || e || '~WELL INFORMATION BLOCK' || e
  || '#MNEM.UNIT       DATA TYPE    INFORMATION' || e || '#---------     -----------    ---------------------------' || e"""
_LAS_MIDDLE = """'~PARAMETER INFORMATION BLOCK' || e || '#MNEM.UNIT       VALUE        DESCRIPTION' || e || '#---------     -----------    ---------------------------' || e || ' EKB .               0.0000:  ELEVATION OF KELLY BUSHING' || e
  || '~CURVE INFORMATION BLOCK' || e || '#MNEM.UNIT                 API CODE     CURVE DESCRIPTION' || e || '#---------               -----------    ---------------------------' || e"""


@query("trc_digitize_las", f"""WITH {_DIGITIZE}, wide AS (SELECT img, row_idx, max(depth) AS depth, max(CASE name WHEN 'GR' THEN value END) AS gr, max(CASE name WHEN 'RHOB' THEN value END) AS rhob FROM done GROUP BY 1, 2),
body AS (SELECT img, chr(13) || chr(10) AS e, min(depth) AS a, max(depth) AS b, min(CASE row_idx WHEN 1 THEN depth END) - min(depth) AS step, string_agg(printf('%10.4f %10.4f %10.4f', depth, gr, rhob), chr(13) || chr(10) ORDER BY row_idx) AS rows FROM wide GROUP BY 1)
SELECT img AS file, 'Acme__W_' || img || '.las' AS name, {_LAS_HEAD} || ' STRT.F               ' || printf('%.4f', a) || ':' || e || ' STOP.F               ' || printf('%.4f', b) || ':' || e || ' STEP.F               ' || printf('%.4f', step) || ':' || e
  || ' NULL.               -999.2500:' || e || ' COMP.       Acme:' || e || ' WELL.       W ' || img || ':' || e || ' CNTY.       White Pine:' || e || {_LAS_MIDDLE}
  || ' DEPT.F                 00 000 000 000:  DEPTH' || e || ' GR.API :  GR' || e || ' RHOB.G/CC :  RHOB' || e || '~A      DEPTH         GR       RHOB' || e || rows || e AS text FROM body""")
def trc_digitize_las(spark, sf):
    return _digitize(spark, sf)[2]


_SPAN = """m AS (SELECT *, max(p) OVER (PARTITION BY image_id, y) AS m FROM pix), s AS (SELECT *, min(CASE WHEN p >= greatest(0.12, 0.55 * m) THEN x END) OVER w AS lo, max(CASE WHEN p >= greatest(0.12, 0.55 * m) THEN x END) OVER w AS hi FROM m WHERE m >= 1e-4 WINDOW w AS (PARTITION BY image_id, y)),
span AS (SELECT image_id, y AS row_idx, sum(x * p) / sum(p) AS x, max(m) AS conf FROM s WHERE x BETWEEN lo AND hi GROUP BY 1, 2)"""
_PEAK = """mm AS (SELECT *, max(p) OVER (PARTITION BY image_id, y) AS m FROM pix), k AS (SELECT *, min(CASE WHEN p = m THEN x END) OVER (PARTITION BY image_id, y) AS spot FROM mm),
gg AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS grp FROM k WHERE p >= greatest(0.6 * m, 0.01)), hh AS (SELECT *, bool_or(x = spot) OVER (PARTITION BY image_id, y, grp) AS has FROM gg),
peak AS (SELECT image_id, y AS row_idx, sum(x * p) / sum(p) AS x, max(m) AS conf FROM hh WHERE has GROUP BY 1, 2)"""


def _prob(spark, sf):
    return raster(spark, sf).select("image_id", "y", "x", "p")


def _mask(spark, sf):
    return raster(spark, sf).select("image_id", "y", "x", F.least(F.lit(255), F.col("value") * 2).alias("value"))


def _trace(df):
    return whole(r6(df, "x", "conf"), "row_idx")


def _settings(spark, sf):
    """Half of the images are GR with a hot side, the others RHOB."""
    images = raster(spark, sf).select("image_id").distinct()
    gr = F.col("image_id").cast("int") % 2 == 0
    kind, side = F.when(gr, "GR").otherwise("RHOB"), F.when(gr, "right")
    of = lambda k: evaluation.evaluation_setting(kind, k)
    return traces.settings(images, curve_type=kind, scale_min=F.when(gr, 0.0).otherwise(1.0), scale_max=F.when(gr, 250.0).otherwise(3.0), hot_side=side, step=of("step"), smooth=of("smooth"), bend=of("bend"))


@query("trc_span_centroid", f"WITH {RASTER}, {_SPAN} SELECT image_id, row_idx, round(x, 6) AS x, round(conf, 6) AS conf FROM span")
def trc_span_centroid(spark, sf):
    return _trace(traces.span_centroid(raster(spark, sf)))


@query("trc_max_centroid", f"WITH {RASTER}, {_PEAK} SELECT image_id, row_idx, round(x, 6) AS x, round(conf, 6) AS conf FROM peak")
def trc_max_centroid(spark, sf):
    return _trace(traces.max_centroid(raster(spark, sf)))


@query("trc_peaks", f"""WITH {RASTER}, s AS (SELECT *, CASE WHEN lag(p) OVER w = p THEN 0 ELSE 1 END AS st FROM pix WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), g AS (SELECT *, sum(st) OVER (PARTITION BY image_id, y ORDER BY x) AS grp FROM s),
i AS (SELECT image_id, y, grp, min(x) AS a, max(x) AS b, min(p) AS p FROM g GROUP BY 1, 2, 3), n AS (SELECT *, lag(p) OVER w AS before, lead(p) OVER w AS after FROM i WINDOW w AS (PARTITION BY image_id, y ORDER BY grp))
SELECT image_id, y, (a + b) // 2 AS x, round(p, 6) AS p FROM n WHERE p > before AND p > after AND p >= 0.012""")
def trc_peaks(spark, sf):
    return whole(r6(traces.peaks(_prob(spark, sf)), "p"), "y", "x")


@query("trc_to_probability", f"""WITH {RASTER}, m AS (SELECT image_id, y, avg(x) FILTER ("on") AS c FROM pix GROUP BY 1, 2), n AS (SELECT image_id, max(y) + 1 AS n, 2 * max(y) AS h FROM pix GROUP BY 1),
q AS (SELECT image_id, r, r * (n - 1)::DOUBLE / (h - 1) AS pos, n FROM n, LATERAL (SELECT unnest(range(h)) AS r)), z AS (SELECT q.*, a.c + (pos - floor(pos)) * (b.c - a.c) AS c FROM q LEFT JOIN m a ON a.image_id = q.image_id AND a.y = floor(pos) LEFT JOIN m b ON b.image_id = q.image_id AND b.y = least(n - 1, floor(pos) + 1))
SELECT image_id, round(sum(exp(-(i - c) * (i - c) / 12.5)), 4) AS total, count(*) AS cells FROM z, range(0, 64) t(i) WHERE c IS NOT NULL GROUP BY 1""")
def trc_to_probability(spark, sf):
    r = raster(spark, sf)
    m = r.groupBy("image_id", F.col("y").alias("row_idx")).agg(F.avg(F.when(F.col("on"), F.col("x"))).alias("x"))
    heights = pixels.sizes_of(r).select("image_id", (2 * F.col("height") - 2).alias("height"))
    return traces.to_probability(m, 64, 2.5, heights).groupBy("image_id").agg(F.round(F.sum("p"), 4).alias("total"), F.count(F.lit(1)).alias("cells"))


@query("trc_fused", f"""WITH {RASTER.replace("pix AS (", "pix AS MATERIALIZED (")}, {_SPAN.replace("span AS (", "span AS MATERIALIZED (")}, {_PEAK.replace("peak AS (", "peak AS MATERIALIZED (")}, j AS (SELECT s.*, k.x AS ox, a.p AS pa, b.p AS pb FROM span s LEFT JOIN peak k USING (image_id, row_idx)
  LEFT JOIN pix a ON a.image_id = s.image_id AND a.y = s.row_idx AND a.x = round_even(least(63, greatest(0, s.x)), 0) LEFT JOIN pix b ON b.image_id = s.image_id AND b.y = s.row_idx AND b.x = round_even(least(63, greatest(0, k.x)), 0))
SELECT image_id, row_idx, round(CASE WHEN pb > coalesce(pa, -1) THEN ox ELSE x END, 6) AS x, round(conf, 6) AS conf FROM j""")
def trc_fused(spark, sf):
    p = _prob(spark, sf)
    return _trace(traces.fused(traces.span_centroid(p), traces.max_centroid(p), p))


@query("trc_overlay", f"""WITH {RASTER}, {_PEAK} SELECT image_id, count(*) AS n, round(sum(x + 10), 4) AS x, CAST(sum(row_idx + 5) AS BIGINT) AS y FROM peak GROUP BY 1""")
def trc_overlay(spark, sf):
    o = traces.overlay(traces.max_centroid(raster(spark, sf)), 10, 5).select("image_id", F.explode("points").alias("p"))
    return o.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p.x"), 4).alias("x"), F.sum("p.y").cast("long").alias("y"))


#: SQL of the cost table (image_id, y, x, gr, p, cost) of the raster as a mask.
_COSTS = f"""{RASTER.replace('pix AS (', 'pix9 AS (')}, pix AS (SELECT image_id, y, x, least(255, value * 2) / 255.0::DOUBLE AS p, least(255, value * 2) / 255.0::DOUBLE > 0.10 AS "on" FROM pix9), n AS (SELECT image_id, max(y) + 1 AS h FROM pix GROUP BY 1),
g0 AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM pix WHERE "on"), runs AS (SELECT *, min(x) OVER (PARTITION BY image_id, y, g) AS run, count(*) OVER (PARTITION BY image_id, y, g) AS length FROM g0),
c0 AS (SELECT *, least(x - run, run + length - 1 - x) + 1 AS dx, x = run + (length - 1) // 2 AS mid, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS hh FROM runs),
c1 AS (SELECT *, least(dx, least(y - min(y) OVER v, max(y) OVER v - y) + 1) AS d FROM c0 WINDOW v AS (PARTITION BY image_id, x, hh)), c2 AS (SELECT image_id, y, x, mid, d / max(d) OVER (PARTITION BY image_id) AS d FROM c1),
a AS (SELECT pix.*, coalesce(d, 0) AS d, CASE WHEN mid THEN 1.0::DOUBLE ELSE 0.0 END AS m FROM pix LEFT JOIN c2 USING (image_id, y, x)), r1 AS (SELECT *, {_blur3('m')} AS s FROM a WINDOW {_ROW}), r2 AS (SELECT *, {_blur3('s')} AS ridge FROM r1 WINDOW {_COL}),
r3 AS (SELECT *, ridge / max(ridge) OVER (PARTITION BY image_id) AS rr FROM r2),
l1 AS (SELECT *, least(1, greatest(1e-6, greatest(power(p, 0.7) * (0.15 + 0.85 * power(d, 0.9)), 0.55 * rr + CASE WHEN "on" THEN 0.05 ELSE 0 END))) AS l0 FROM r3), l2 AS (SELECT *, least(1, greatest(1e-6, l0 * (0.7 + 0.3 * d))) AS live FROM l1),
col AS (SELECT image_id, x, count(*) FILTER ("on") / max(h) > 0.6 AS rail FROM pix JOIN n USING (image_id) GROUP BY 1, 2), rails AS (SELECT image_id, x, rail AND coalesce(lag(rail) OVER w, false) AND coalesce(lead(rail) OVER w, false) AS rail FROM col WINDOW w AS (PARTITION BY image_id ORDER BY x)),
grid AS (SELECT image_id, y FROM (SELECT image_id, y, count(*) AS k FROM runs WHERE length >= CASE WHEN run = 0 THEN 8 WHEN run + length = 64 THEN 9 ELSE 16 END GROUP BY 1, 2) WHERE k / 64 > 0.3),
f AS (SELECT l2.*, rail, g.y IS NOT NULL AS flat, l2.image_id::INT % 2 = 0 AS gr FROM l2 JOIN rails USING (image_id, x) LEFT JOIN grid g ON g.image_id = l2.image_id AND g.y = l2.y),
costs AS (SELECT image_id, y, x, gr, CASE WHEN flat THEN 0.001::DOUBLE ELSE live END AS p, CASE WHEN flat THEN -ln(0.001::DOUBLE) ELSE -ln(live) + CASE WHEN rail THEN 15 ELSE 0 END + CASE WHEN gr THEN 1 - x / 63 ELSE 0 END
  + CASE WHEN gr AND x / 63 * 250 > 200 THEN 1 WHEN NOT gr AND (1 + x / 63 * 2 < 1.5 OR 1 + x / 63 * 2 > 3.5) THEN 1 ELSE 0 END END AS cost FROM f)"""


@query("trc_costs", f"WITH {_COSTS} SELECT image_id, y, x, round(p + 1e-9, 6) AS p, round(cost + 1e-9, 6) AS cost FROM costs")
def trc_costs(spark, sf):
    prob = _mask(spark, sf).select("image_id", "y", "x", (F.col("value") / 255.0).alias("p"))
    c = traces.trace_costs(prob, _settings(spark, sf))
    return whole(r6(nudged(c, "p", "cost").select("image_id", "y", "x", "p", "cost"), "p", "cost"), "y", "x")


#: SQL of the seam: totals row by row, then the way back; places count from 1 inside.
_SEAM = """line AS (SELECT image_id, y, list(1 - p ORDER BY x) AS c, list(p ORDER BY x) AS p FROM pix GROUP BY 1, 2),
down AS (SELECT image_id, y, c AS t FROM line WHERE y = 0 UNION ALL
  SELECT n.image_id, n.y, list_transform(n.c, lambda v, i: v + least(t[i], coalesce(t[i - 1], 1e300), coalesce(t[i + 1], 1e300))) FROM down JOIN line n ON n.image_id = down.image_id AND n.y = down.y + 1),
up AS (SELECT image_id, y, list_position(t, list_min(t)) AS x FROM down WHERE y = (SELECT max(y) FROM line l WHERE l.image_id = down.image_id) UNION ALL
  SELECT d.image_id, d.y, x + CASE WHEN t[x] <= coalesce(t[x - 1], 1e300) AND t[x] <= coalesce(t[x + 1], 1e300) THEN 0 WHEN coalesce(t[x - 1], 1e300) <= coalesce(t[x + 1], 1e300) THEN -1 ELSE 1 END
  FROM up JOIN down d ON d.image_id = up.image_id AND d.y = up.y - 1)"""


@query("trc_seam", f"""WITH RECURSIVE {RASTER}, {_SEAM} SELECT image_id, y AS row_idx, (x - 1)::DOUBLE AS x, round(p[x], 6) AS conf FROM up JOIN line USING (image_id, y)""")
def trc_seam(spark, sf):
    return _trace(traces.seam(_prob(spark, sf)))


#: SQL of following: each row's peaks (else its first maximum) with the weighted middle of the run round them; from the row of most ink down (d = 1) and up, the best for what its distance from the place before costs.
_FOLLOWED = """f0 AS (SELECT *, CASE WHEN lag(p) OVER r IS DISTINCT FROM p THEN 1 ELSE 0 END AS st FROM pix WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
f1 AS (SELECT *, sum(st) OVER (PARTITION BY image_id, y ORDER BY x) AS level FROM f0),
f2 AS (SELECT image_id, y, min(x) AS a, max(x) AS b, any_value(p) AS p FROM f1 GROUP BY image_id, y, level),
f3 AS (SELECT *, lag(p) OVER r AS before, lead(p) OVER r AS after FROM f2 WINDOW r AS (PARTITION BY image_id, y ORDER BY a)),
top AS (SELECT image_id, y, sum(value) AS ink, max(p) AS top, arg_min(x, (-p, x)) AS px FROM pix GROUP BY 1, 2),
peak AS (SELECT image_id, y, (a + b) // 2 AS px, p AS s FROM f3 WHERE p > before AND p > after AND p >= 0.012),
spot AS (SELECT * FROM peak UNION ALL SELECT image_id, y, px, top FROM top WHERE top >= 0.012 AND (image_id, y) NOT IN (SELECT (image_id, y) FROM peak)),
edge AS (SELECT c.image_id, c.y, px, s, coalesce(max(q.x) FILTER (q.x < px AND q.p < greatest(0.4 * s, 0.003)), -1) AS lo, coalesce(min(q.x) FILTER (q.x > px AND q.p < greatest(0.4 * s, 0.003)), 64) AS hi FROM spot c JOIN pix q ON q.image_id = c.image_id AND q.y = c.y GROUP BY 1, 2, 3, 4),
mid AS (SELECT e.image_id, e.y, px, s, sum(q.x * q.p) / sum(q.p) AS c FROM edge e JOIN pix q ON q.image_id = e.image_id AND q.y = e.y AND q.x > lo AND q.x < hi GROUP BY 1, 2, 3, 4),
rows1 AS MATERIALIZED (SELECT t.image_id, t.y, list({'px': m.px, 's': s, 'c': c} ORDER BY m.px) FILTER (c IS NOT NULL) AS spots FROM top t LEFT JOIN mid m ON m.image_id = t.image_id AND m.y = t.y GROUP BY 1, 2),
first AS (SELECT image_id, arg_min(y, (-ink, y)) AS y FROM top GROUP BY 1),
walk AS (SELECT t.image_id, d, t.y, t.px::DOUBLE AS x, t.top AS conf, t.px::DOUBLE AS here FROM top t JOIN first USING (image_id, y), (VALUES (-1), (1)) v(d) UNION ALL
  SELECT image_id, d, y, best.c, coalesce(best.s, 0), coalesce(best.c, here) FROM (SELECT w.image_id, w.d, r.y, w.here, list_sort(list_transform(r.spots, lambda e: {'k': -(e.s - 0.020::DOUBLE * (abs(e.px - w.here) / 80) * (1 - e.s)), 'px': e.px, 'c': e.c, 's': e.s}))[1] AS best
    FROM walk w JOIN rows1 r ON r.image_id = w.image_id AND r.y = w.y + w.d)),
followed AS (SELECT DISTINCT image_id, y AS row_idx, x, conf FROM walk)"""


@query("trc_followed", f"WITH RECURSIVE {RASTER}, {_FOLLOWED} SELECT image_id, row_idx, round(x, 6) AS x, round(conf, 6) AS conf FROM followed")
def trc_followed(spark, sf):
    return _trace(traces.followed(_prob(spark, sf)))


#: SQL of the tracer: the cost table's rows downwards (d = 0) and upwards (d = 1), least totals with the place that each came from, the way back, what lies below the end, and the merge.
_DP = f"""{_COSTS}, args AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM (SELECT image_id, y, any_value(gr) AS gr, list(cost ORDER BY x) AS c, list(p ORDER BY x) AS p FROM costs GROUP BY 1, 2)),
line AS (SELECT image_id, 0 AS d, y, n, gr, c, p FROM args UNION ALL SELECT image_id, 1, n - 1 - y, n, gr, c, p FROM args),
sets AS (SELECT * FROM (VALUES (true, 30, 0.001::DOUBLE, 0.001::DOUBLE), (false, 50, 0.02::DOUBLE, 0.005::DOUBLE)) v(gr, step, smooth, bend)),
rows1 AS (SELECT line.*, step, smooth, bend FROM line JOIN sets USING (gr)),
down AS (SELECT image_id, d, y, c AS t, list_transform(c, lambda v, i: 0::BIGINT) AS b FROM rows1 WHERE y = 0 UNION ALL
  SELECT image_id, d, y, list_transform(c, lambda v, i: v + best[i].w), list_transform(best, lambda e: e.k) FROM (SELECT r.image_id, r.d, r.y, r.c, list_transform(range(1, 65), lambda i: list_min(list_transform(range(greatest(1, i - step), least(64, i + step) + 1),
    lambda k: {{'w': down.t[k] + smooth * ((i - k) * (i - k))::DOUBLE + CASE WHEN bend > 0 AND r.y >= 2 THEN bend * ((i - 2 * k + down.b[k]) * (i - 2 * k + down.b[k]))::DOUBLE ELSE 0 END, 'k': k}}))) AS best
    FROM down JOIN rows1 r ON r.image_id = down.image_id AND r.d = down.d AND r.y = down.y + 1)),
ends AS (SELECT image_id, d, arg_min(y, (list_min(t), y)) AS y, arg_min(list_position(t, list_min(t)), (list_min(t), y)) AS x FROM down JOIN (SELECT DISTINCT image_id, n FROM args) USING (image_id) WHERE y >= floor(n * 0.8) GROUP BY 1, 2),
way AS (SELECT image_id, d, y, x FROM ends UNION ALL SELECT v.image_id, v.d, v.y - 1, v.b[way.x] FROM way JOIN down v ON v.image_id = way.image_id AND v.d = way.d AND v.y = way.y WHERE way.y > 0),
tail AS (SELECT image_id, d, y, x FROM ends UNION ALL SELECT image_id, d, y, low - 1 + list_position(near, list_max(near)) FROM (SELECT r.image_id, r.d, r.y, greatest(1, tail.x - step) AS low, r.p[greatest(1, tail.x - step):tail.x + step] AS near
  FROM tail JOIN rows1 r ON r.image_id = tail.image_id AND r.d = tail.d AND r.y = tail.y + 1)),
path AS (SELECT * FROM way UNION SELECT * FROM tail),
rated AS (SELECT r.image_id, r.d, CASE r.d WHEN 0 THEN r.y ELSE n - 1 - r.y END AS y, CASE WHEN p[x] >= 0.01 THEN x - 1 END AS x, p[x] - greatest(0, coalesce(list_sort(p[greatest(1, x - step):x + step], 'DESC')[2], 0)) AS conf, p FROM path JOIN rows1 r USING (image_id, d, y)),
both_ways AS (SELECT image_id, y, a.p, a.x AS a, a.conf AS ca, b.x AS b, b.conf AS cb FROM rated a JOIN rated b USING (image_id, y) WHERE a.d = 0 AND b.d = 1)"""


@query("trc_dp", f"""WITH RECURSIVE {_DP} SELECT image_id, y AS row_idx, round(CASE WHEN a IS NULL OR b IS NULL THEN coalesce(a, b)::DOUBLE WHEN abs(a - b) > 5 THEN CASE WHEN p[a + 1] > p[b + 1] THEN a ELSE b END ELSE (a + b) / 2 END, 6) AS x,
  round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN ca WHEN a IS NULL THEN cb ELSE (ca + cb) / 2 END + 1e-9, 6) AS conf FROM both_ways""")
def trc_dp(spark, sf):
    prob = _mask(spark, sf).select("image_id", "y", "x", (F.col("value") / 255.0).alias("p"))
    return _trace(nudged(traces.dp_tracer(prob, _settings(spark, sf)), "conf"))


def _hues(spark, sf):
    from ..functions import columns as C

    p = raster(spark, sf).withColumn("c", C.hsv(F.col("b"), F.col("g"), F.col("r")))
    return p.select("image_id", "y", "x", F.col("c.h").alias("h"), F.col("value").alias("ink"))


@query("trc_dot_print")
def trc_dot_print(spark, sf):
    return _trace(traces.dot_print_tracer(_mask(spark, sf), _hues(spark, sf)))


@query("trc_dot_print_crest")
def trc_dot_print_crest(spark, sf):
    return _trace(traces.dot_print_tracer(_mask(spark, sf), crest=True))


#: SQL of the ridge tracer: the mask without rails, its largest component, the middles of that one's bars, and the seam along them.
_RIDGE = f"""{RASTER.replace('pix AS (', 'pix1 AS (')}, mask AS (SELECT image_id, y, x, least(255, value * 2) AS value FROM pix1), pix AS (SELECT image_id, y, x, value < 40 AS "on" FROM mask), {_RUNS}, {_VERTICAL.replace('least(15, h // 3)', 'greatest(12, h // 24)')},
rail AS (SELECT image_id, y, x FROM runs WHERE length >= CASE WHEN run = 0 THEN 12 - 6 WHEN run + length = 64 THEN 7 ELSE 12 END UNION SELECT image_id, y, x FROM upright WHERE length >= CASE WHEN run = 0 THEN k - k // 2 WHEN run + length = h THEN k // 2 + 1 ELSE k END),
lit AS (SELECT image_id, y, x FROM mask WHERE value > 25 AND (image_id, y, x) NOT IN (SELECT (image_id, y, x) FROM rail)), {LARGEST},
mid AS (SELECT bar.image_id, y, a + (b - a) // 2 AS x FROM bar JOIN spread USING (id) JOIN largest USING (label)),
ridge AS (SELECT image_id, y, x, CASE WHEN m.x IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS p FROM mask LEFT JOIN mid m USING (image_id, y, x)), {_SEAM.replace('FROM pix ', 'FROM ridge ')}"""


@query("trc_ridge", f"""WITH RECURSIVE {_RIDGE} SELECT u.image_id, u.y AS row_idx, CASE WHEN l.label IS NOT NULL THEN (u.x - 1)::DOUBLE END AS x, CASE WHEN l.label IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS conf FROM up u LEFT JOIN largest l ON l.image_id = u.image_id""")
def trc_ridge(spark, sf):
    return _trace(traces.ridge_tracer(_mask(spark, sf)))


@query("trc_multiscale")
def trc_multiscale(spark, sf):
    return _trace(traces.multiscale_tracer(_mask(spark, sf), _settings(spark, sf)))


@query("evl_methods")
def evl_methods(spark, sf):
    """One row a method: the row pick, the path tracers and the ridge, against the mean place of dark pixels."""
    p = pixels.cut(raster(spark, sf).select("image_id", "y", "x", "value", "on"))
    mask = p.select("image_id", "y", "x", F.least(F.lit(255), F.col("value") * 2).alias("value"))
    target = p.where("on").groupBy("image_id", F.col("y").alias("row_idx")).agg(F.avg("x").alias("t"))
    prob = mask.select("image_id", "y", "x", (F.col("value") / 255.0).alias("p"))
    picks = traces.row_picks(p.select("image_id", "y", "x", "on"), p.select("image_id", F.col("y").alias("row_idx")).distinct()).withColumn("conf", F.col("x").isNotNull().cast("double"))
    runs = {
        "row_pick": picks,
        "dp": traces.dp_tracer(prob, _settings(spark, sf)),
        "ridge": traces.ridge_tracer(mask),
        "dot_print": traces.dot_print_tracer(mask),
        "multiscale": traces.multiscale_tracer(mask, _settings(spark, sf)),
    }
    pred = None
    for name, d in runs.items():
        d = d.select("image_id", "row_idx", "x", "conf", F.lit(name).alias("method"))
        pred = d if pred is None else pred.union(d)
    return r6(evaluation.trace_metrics(pixels.cut(pred), target, 64), "coverage", "mae_px", "hit_1", "hit_3", "hit_5", "mean_conf")
