"""Queries of operators that are documented only."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curves, documented, pixels, traces
from .curve_queries import _V
from .registry import nudged, query, r6, whole
from .standins import RASTER, SAMPLES, raster, samples, t
from .trace_queries import _PEAK, _SPAN


@query("doc_regular_depth", f"""WITH {SAMPLES}, v AS (SELECT well, curve, depth AS dp, {_V} AS v, 0 AS asks FROM samples),
b AS (SELECT well, curve, min(dp) AS lo, max(dp) AS hi FROM v GROUP BY 1, 2), g AS (SELECT well, curve, lo + i * 0.5::DOUBLE AS dp FROM b, LATERAL (SELECT unnest(range(0, CAST(floor((hi - lo) / 0.5) AS BIGINT) + 1)) AS i)),
u AS (SELECT well, curve, dp, v, 0 AS asks FROM v WHERE v IS NOT NULL UNION ALL SELECT well, curve, dp, NULL, 1 FROM g),
n AS (SELECT *, max(CASE WHEN asks = 0 THEN dp END) OVER (PARTITION BY well, curve ORDER BY dp, asks ROWS UNBOUNDED PRECEDING) AS la, min(CASE WHEN asks = 0 THEN dp END) OVER (PARTITION BY well, curve ORDER BY dp, asks ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ha, count(v) OVER (PARTITION BY well, curve) AS k FROM u)
SELECT n.well, n.curve, round(n.dp, 6) AS depth, round(CASE WHEN k < 1 THEN NULL WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL OR la = n.dp THEN a.v ELSE a.v + (n.dp - la) / (ha - la) * (b.v - a.v) END, 6) AS value
FROM n LEFT JOIN v a ON a.well = n.well AND a.curve = n.curve AND a.dp = la LEFT JOIN v b ON b.well = n.well AND b.curve = n.curve AND b.dp = ha WHERE n.asks = 1""")
def doc_regular_depth(spark, sf):
    return r6(curves.regular_depth(samples(spark, sf), ("well", "curve")), "depth", "value")


@query("doc_warnings", """SELECT p_partkey, concat_ws(',', CASE WHEN p_retailprice <= 1000 THEN 'bottom_not_below_top' END, CASE WHEN abs(p_retailprice - 1000) / greatest(1, p_size - 5) > 10 THEN 'extreme_depth_per_pixel' END, CASE WHEN p_size - 10 < 0 OR p_size + 20 > 50 THEN 'outside_image' END) AS warnings FROM part""")
def doc_warnings(spark, sf):
    s = F.col("p_size")
    w = documented.depth_warnings(s * 0 + 5, s, F.lit(1000.0), F.col("p_retailprice"), F.lit(1 << 20))
    o = F.when((s - 10 < 0) | (s + 20 > 50), F.lit("outside_image"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.array_compact(F.concat(w, F.array(o))), ",").alias("warnings"))


@query("doc_curve_warnings", f"""WITH {SAMPLES}, v AS (SELECT well, curve, {_V} AS v FROM samples), f AS (SELECT well, curve, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS s, (1 - count(v) / count(*)) * 100 AS m FROM v GROUP BY 1, 2)
SELECT well, curve, concat_ws(',', CASE WHEN lo < 4 OR hi > 20 THEN 'out_of_range' END, CASE WHEN s < 1e-3 THEN 'flat' END, CASE WHEN m > 30 THEN 'many_nulls' END) AS warnings FROM f""")
def doc_curve_warnings(spark, sf):
    f = documented.curve_warnings(curves.features(samples(spark, sf)).withColumn("type", F.lit("CALI")))
    return f.select("well", "curve", F.array_join("warnings", ",").alias("warnings"))


@query("doc_snap", """WITH c AS (SELECT o_custkey AS image_id, o_orderkey AS click, CAST(round(o_totalprice / 100, 0) AS BIGINT) AS y FROM orders), l AS (SELECT o_custkey AS image_id, o_orderkey AS label, CAST(round(o_totalprice / 100, 0) AS BIGINT) + o_orderkey % 40 AS y FROM orders),
j AS (SELECT c.image_id, click, label, row_number() OVER (PARTITION BY c.image_id, click ORDER BY abs(c.y - l.y), l.y, label) AS n FROM c JOIN l ON c.image_id = l.image_id AND abs(c.y - l.y) <= 30) SELECT image_id, click, label FROM j WHERE n = 1""")
def doc_snap(spark, sf):
    o = t(spark, sf, "orders")
    y = F.round(F.col("o_totalprice") / 100).cast("long")
    return documented.snapped(o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("click"), y.alias("y")), o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("label"), (y + F.col("o_orderkey") % 40).alias("y")), 30)


@query("doc_depth_lines", """SELECT p_partkey AS image_id, i * 50.0::DOUBLE AS depth, round(10 + (i * 50.0 - p_retailprice) / 500.0 * 990, 6) AS y FROM part, LATERAL (SELECT unnest(range(CAST(ceil(p_retailprice / 50) AS BIGINT), CAST(floor((p_retailprice + 500) / 50) AS BIGINT) + 1)) AS i)""")
def doc_depth_lines(spark, sf):
    j = t(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.lit(10).alias("top_px"), F.lit(1000).alias("bottom_px"), F.col("p_retailprice").alias("top"), (F.col("p_retailprice") + 500).alias("bottom"))
    return r6(documented.depth_lines(j, 50.0), "y")


@query("doc_nice_depth_lines", """WITH s AS (SELECT p_partkey AS image_id, p_retailprice AS top, p_size * p_size * 1.5::DOUBLE AS span, 3 + p_partkey % 9 AS lines FROM part),
steps AS (SELECT m * power(10.0::DOUBLE, e) AS step FROM (VALUES (1), (2), (5)) a(m), range(-3, 6) b(e)),
own AS (SELECT s.*, (SELECT min(step) FROM steps WHERE step * lines >= span * (1 - 1e-9)) AS step FROM s)
SELECT image_id, round(i * step, 6) AS depth, round(10 + (i * step - top) / span * 990, 6) AS y FROM own, LATERAL (SELECT unnest(range(CAST(ceil(top / step) AS BIGINT), CAST(floor((top + span) / step) AS BIGINT) + 1)) AS i)""")
def doc_nice_depth_lines(spark, sf):
    """Lines at steps that each image's own span and wished number of lines choose."""
    span = F.col("p_size") * F.col("p_size") * 1.5
    j = t(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), F.lit(10).alias("top_px"), F.lit(1000).alias("bottom_px"), F.col("p_retailprice").alias("top"), (F.col("p_retailprice") + span).alias("bottom"), (3 + F.col("p_partkey") % 9).alias("lines"))
    return r6(documented.depth_lines(j, lines=F.col("lines")), "depth", "y")


@query("doc_subpixel", f"""WITH {RASTER}, n AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS c FROM pix WINDOW w AS (PARTITION BY image_id, y ORDER BY x))
SELECT image_id, y, round(x + CASE WHEN abs(a - 2 * p + c) > 1e-12 THEN 0.5 * (a - c) / (a - 2 * p + c) ELSE 0 END, 6) AS x FROM n WHERE p > a AND p > c AND p >= 0.5""")
def doc_subpixel(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "p")
    w = Window.partitionBy("image_id", "y").orderBy("x")
    at = p.withColumn("a", F.lag("p").over(w)).withColumn("c", F.lead("p").over(w)).where("p > a and p > c and p >= 0.5")
    return whole(r6(traces.subpixel(p, at), "x"), "y")


@query("doc_damped", f"""WITH {RASTER}, g0 AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS g1 FROM pix WHERE "on"), r AS (SELECT *, count(*) OVER (PARTITION BY image_id, x, g1) AS length FROM g0)
SELECT image_id, round(sum(CASE WHEN length > 3 THEN p * 0.05 ELSE p END), 4) AS p FROM r GROUP BY 1""")
def doc_damped(spark, sf):
    p = raster(spark, sf)
    r = pixels.runs(p.select("image_id", "y", "x", "on", "p"), "y")
    return documented.vertical_damped(r, 3).groupBy("image_id").agg(F.round(F.sum("p"), 4).alias("p"))


@query("doc_fused", f"""WITH {RASTER}, {_SPAN}, {_PEAK}, j AS (SELECT image_id, row_idx, s.x AS fx, s.conf * CASE WHEN row_idx % 2 = 0 THEN 0.5 ELSE 1 END AS fc, k.x AS dx, k.conf AS dc FROM span s FULL JOIN peak k USING (image_id, row_idx)),
c AS (SELECT *, dx IS NOT NULL AND (fx IS NULL OR (dc > 1.1 * fc AND round(abs(dx - fx), 9) < 20)) AS take FROM j) SELECT image_id, row_idx, round(CASE WHEN take THEN dx ELSE fx END + 1e-9, 6) AS x, round(CASE WHEN take THEN dc ELSE fc END, 6) AS conf FROM c""")
def doc_fused(spark, sf):
    p = raster(spark, sf)
    weak = traces.span_centroid(p).withColumn("conf", F.col("conf") * F.when(F.col("row_idx") % 2 == 0, 0.5).otherwise(1.0))
    return whole(r6(nudged(traces.gated_fusion(traces.max_centroid(p), weak, near=20.0), "x"), "x", "conf"), "row_idx")
