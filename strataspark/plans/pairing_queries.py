"""Queries of pairing scans with measured curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pairing
from .registry import pick, query, r6, whole
from .standins import t

_SCORES = """r AS (SELECT l_suppkey AS scan, l_linenumber AS panel, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS x, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS value FROM lineitem),
g AS (SELECT scan, panel, count(*) AS rows, count(x) AS placed, count(*) FILTER (x IS NOT NULL AND value IS NOT NULL) AS n, quantile_cont(x, 0.02) FILTER (value IS NOT NULL) AS a, quantile_cont(x, 0.98) FILTER (value IS NOT NULL) AS b,
  quantile_cont(value, 0.02) FILTER (x IS NOT NULL) AS c, quantile_cont(value, 0.98) FILTER (x IS NOT NULL) AS d FROM r GROUP BY 1, 2),
k AS (SELECT scan, panel, corr(least(1, greatest(0, (x - a) / (b - a))), least(1, greatest(0, (value - c) / (d - c)))) AS r FROM r JOIN g USING (scan, panel) WHERE x IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
scores AS (SELECT g.scan, g.panel, placed / rows AS valid, CASE WHEN n >= 20 AND b - a >= 8 THEN abs(k.r) * greatest(0.25, placed / rows) * greatest(0.25, least(1, (b - a) / 49 / 0.25)) END AS score FROM g LEFT JOIN k ON k.scan = g.scan AND k.panel = g.panel)"""


def _scores(spark, sf):
    l = t(spark, sf, "lineitem")
    x, v = F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")), F.when(F.col("l_partkey") % 13 != 0, F.col("l_extendedprice"))
    rows = l.select(F.col("l_suppkey").alias("scan"), F.col("l_linenumber").alias("panel"), x.alias("x"), v.alias("value"), F.lit(50.0).alias("width"))
    return pairing.match_scores(rows, ("scan", "panel"), least=20)


@query("pair_scores", f"WITH {_SCORES} SELECT scan, panel, round(valid, 6) AS valid, round(score, 6) AS score FROM scores")
def pair_scores(spark, sf):
    return r6(_scores(spark, sf), "valid", "score")


@query("pair_best_panel", f"""WITH {_SCORES}, n AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY round(score, 9) DESC, panel) AS n FROM scores WHERE valid >= 0.5 AND score IS NOT NULL) SELECT scan, panel, round(valid, 6) AS valid, round(score, 6) AS score FROM n WHERE n = 1 AND score >= 0.01""")
def pair_best_panel(spark, sf):
    return r6(pairing.best_panel(_scores(spark, sf).withColumn("score", F.round("score", 9)), 0.5, 0.01), "valid", "score")


@query("pair_panels", """WITH s AS (SELECT p_partkey AS scan, p_size * 7 + 20 AS width, p_size % 3 + 1 AS n FROM part), p AS (SELECT scan, width, n, panel, round_even(width * panel / n, 0) AS l, round_even(width * (panel + 1) / n, 0) AS r FROM s, range(0, 3) t(panel) WHERE panel < n),
k AS (SELECT * FROM p WHERE n = 1 OR r - l >= 32) SELECT scan, panel, CAST(l AS BIGINT) AS left_px, CAST(r AS BIGINT) AS right_px FROM k UNION ALL SELECT scan, 0, 0, width FROM s WHERE scan NOT IN (SELECT scan FROM k)""")
def pair_panels(spark, sf):
    s = t(spark, sf, "part").select(F.col("p_partkey").alias("scan"), (F.col("p_size") * 7 + 20).alias("width"), (F.col("p_size") % 3 + 1).alias("panels"))
    return whole(pairing.panels(s), "panel", "left_px", "right_px")


@query("pair_windows", """WITH s AS (SELECT p_partkey, greatest(0, p_size * 90 + 100 - 256) AS last FROM part), g AS (SELECT p_partkey, list_sort(list_distinct(list_append(range(0, last + 1, 128), last))) AS g FROM s)
SELECT p_partkey, array_to_string(CASE WHEN len(g) <= 18 THEN g ELSE list_sort(list_distinct([g[1 + CAST(floor(i * (len(g) - 1) / 17) AS BIGINT)] for i in range(18)])) END, ',') AS starts FROM g""")
def pair_windows(spark, sf):
    p = t(spark, sf, "part")
    return p.select("p_partkey", F.array_join(pairing.window_starts(F.col("p_size") * 90 + 100, 256, 128, 18).cast("array<string>"), ",").alias("starts"))


@query("pair_hints", r"""WITH x AS (SELECT p_partkey, p_size, p_name || ['_DGC', '-ngc', ' ILZ', '_t_5', '', '_I_2', '9i', 'it', ' T'][1 + p_partkey % 9] AS name FROM part), y AS (SELECT *, lower(name) AS n FROM x),
z AS (SELECT *, CASE WHEN contains(n, 'dgc') THEN 'BD,CAL,GR' WHEN contains(n, 'ngc') THEN 'CAL,DPHI,GR' WHEN contains(n, 'ilz') OR regexp_matches(n, '(^|[^a-z])i([^a-z]|$)') THEN 'RILD' WHEN regexp_matches(n, '(^|[^a-z])t([^a-z]|$)') THEN 'TEMP' END AS curves FROM y)
SELECT p_partkey, curves, coalesce(contains(curves, 'GR'), true) AS gr, CASE WHEN contains(n, 'dgc') OR contains(n, 'ngc') THEN 3 ELSE 1 END::BIGINT AS panels, printf('%d_%s_panel%d_r%05d', p_partkey, name, p_size % 3, p_size * 10) AS image_id FROM z""")
def pair_hints(spark, sf):
    p = t(spark, sf, "part")
    name = F.concat("p_name", pick(F.col("p_partkey") % 9, "_DGC", "-ngc", " ILZ", "_t_5", "", "_I_2", "9i", "it", " T"))
    image = pairing.image_id(F.col("p_partkey").cast("string"), name, F.col("p_size") % 3, F.col("p_size") * 10)
    return whole(p.select("p_partkey", F.array_join(pairing.hinted_curves(name), ",").alias("curves"), pairing.hinted(name, F.lit(" gr")).alias("gr"), pairing.panel_count(name).alias("panels"), image.alias("image_id")), "panels")


@query("pair_skips", """SELECT p_partkey, CASE WHEN p_size % 13 = 0 OR p_size % 11 = 0 THEN 'missing_las_or_tif' WHEN p_size % 7 = 0 THEN 'curve_not_found:GR' WHEN p_partkey % 200 < 50 THEN 'invalid_las_curve' END AS pair_reason,
  CASE WHEN p_size % 5 = 0 THEN 'curve_hint_excludes_target' WHEN p_partkey % 17 = 0 THEN 'image_read_failed' WHEN p_size * 40 < 700 THEN 'content_too_small' WHEN p_size % 3 = 0 AND p_partkey * 3 % 4000 > 2600 THEN 'full_scan_requires_allow_full_scans' WHEN p_size % 2 = 0 THEN 'no_panel_match' END AS scan_reason FROM part""")
def pair_skips(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    pair = pairing.pair_reason(s % 13 != 0, s % 11 != 0, F.when(s % 7 != 0, "GR"), F.lit("GR"), k % 200)
    scan = pairing.scan_reason(s % 5 != 0, F.when(k % 17 != 0, k * 3 % 4000), s * 40, F.when(s % 3 == 0, 1).otherwise(3), s % 2 != 0)
    return t(spark, sf, "part").select("p_partkey", pair.alias("pair_reason"), scan.alias("scan_reason"))


@query("pair_summary", """WITH p AS (SELECT DISTINCT p_type AS source, p_brand AS pair_id FROM part), r AS (SELECT source, pair_id, CASE WHEN length(source || pair_id) % 4 = 0 THEN 'invalid_las_curve' END AS reason FROM p),
e AS (SELECT p_type AS source, p_brand AS pair_id, count(*) AS n FROM part WHERE p_size % 40 = 1 GROUP BY 1, 2), s AS (SELECT p_type AS source, p_brand AS pair_id, string_agg(p_partkey || ':no_panel_match', ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS skipped FROM part WHERE p_size % 10 = 3 GROUP BY 1, 2)
SELECT r.source, r.pair_id, CASE WHEN n > 0 THEN 'ok' ELSE 'skipped' END AS status, CASE WHEN coalesce(n, 0) = 0 THEN coalesce(reason, 'no_examples') END AS reason, coalesce(n, 0) AS example_count, coalesce(skipped, '') AS skipped_scans FROM r LEFT JOIN e USING (source, pair_id) LEFT JOIN s USING (source, pair_id)""")
def pair_summary(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_type").alias("source"), F.col("p_brand").alias("pair_id"), "p_size", F.col("p_partkey").cast("string").alias("scan"))
    why = F.when(F.length(F.concat("source", "pair_id")) % 4 == 0, "invalid_las_curve")
    pairs = p.select("source", "pair_id").distinct().withColumn("reason", why)
    scans = p.select("source", "pair_id", "scan", F.when(F.col("p_size") % 10 == 3, "no_panel_match").alias("reason"))
    out = pairing.pair_summary(pairs, scans, p.where("p_size % 40 = 1"))
    return out.withColumn("skipped_scans", F.array_join(F.transform("skipped_scans", lambda s: F.concat(s["scan"], F.lit(":"), s["reason"])), ","))


def windows_of(spark, sf):
    """Panels, window traces and measured curves from the line items of each supplier, in the order of their keys."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    l = t(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_suppkey").alias("pair_id"), (F.row_number().over(w) - 1).alias("row"), F.col("l_quantity").alias("q"), "l_partkey")
    measured = l.select("pair_id", (100 + F.col("row") * 0.5).alias("at"), F.col("q").alias("value"))
    size = l.groupBy("pair_id").agg((F.max("row") + 1).alias("rows"))
    panel = size.select(
        "pair_id", F.concat("pair_id", F.lit("_dgc.tif")).alias("scan"), F.lit(1).alias("panel"), F.lit(100).alias("left_px"), F.lit(160).alias("right_px"), "rows", F.lit(100.0).alias("depth_first"), (100 + (F.col("rows") - 1) * 0.5).alias("depth_last"),
        F.lit("wvgs").alias("source"), F.lit("a.las").alias("las_name"), F.lit("GR").alias("mnemonic"), F.lit(0.5).alias("panel_score"))
    start = F.explode(pairing.window_starts(F.col("rows"), 256, 200, 18))
    traces_ = l.join(size, "pair_id").withColumn("start_row", start).where("row >= start_row and row < start_row + 256")
    x = F.when(F.col("l_partkey") % 9 != 0, F.when(F.col("l_partkey") % 4 == 0, 50 - F.col("q")).otherwise(F.col("q")))
    traces_ = traces_.select("pair_id", F.concat("pair_id", F.lit("_dgc.tif")).alias("scan"), "start_row", (F.col("row") - F.col("start_row")).alias("row"), x.alias("x"))
    return panel, traces_, measured


#: SQL of the examples from l (pair_id, row, q: the measured value, x: the trace's place), for panels of some columns and 256 rows a window.
_EXAMPLES = """size AS (SELECT pair_id, count(*) AS rows FROM l GROUP BY 1), g AS (SELECT pair_id, rows, list_sort(list_distinct(list_append(range(0, greatest(0, rows - 256) + 1, 200), greatest(0, rows - 256)))) AS g FROM size),
w AS (SELECT pair_id, rows, unnest(CASE WHEN len(g) <= 18 THEN g ELSE list_distinct([g[1 + CAST(floor(i * (len(g) - 1) / 17) AS BIGINT)] for i in range(18)]) END) AS s FROM g),
k AS (SELECT w.pair_id, s, least(rows, s + 256) AS e, l.row - s AS i, q AS value, x FROM w JOIN l ON l.pair_id = w.pair_id AND l.row >= s AND l.row < least(rows, s + 256) WHERE least(rows, s + 256) - s >= 128),
c AS (SELECT pair_id, s, e, count(x) / count(*) AS valid, count(x) AS n, quantile_cont(x, 0.02) AS a, quantile_cont(x, 0.98) AS b, quantile_cont(value, 0.02) FILTER (x IS NOT NULL) AS c, quantile_cont(value, 0.98) FILTER (x IS NOT NULL) AS d, list(coalesce(x, -999.25::DOUBLE) ORDER BY i) AS trace FROM k GROUP BY 1, 2, 3),
u AS (SELECT c.pair_id, c.s, least(1, greatest(0, (x - a) / greatest(1e-6, b - a))) AS u, least(1, greatest(0, (value - c) / greatest(1e-6, d - c))) AS v FROM k JOIN c ON c.pair_id = k.pair_id AND c.s = k.s WHERE x IS NOT NULL),
r AS (SELECT pair_id, s, CASE WHEN stddev_pop(u) >= 1e-4 AND stddev_pop(v) >= 1e-4 THEN abs(corr(u, v)) END AS r FROM u GROUP BY 1, 2),
score AS (SELECT c.*, CASE WHEN n >= 100 AND b - a >= 8 AND d - c >= 1e-6 THEN r * greatest(0.25, valid) * greatest(0.25, least(1, (b - a) / WIDTH / 0.25)) END AS score FROM c JOIN r ON r.pair_id = c.pair_id AND r.s = c.s)"""


_LINES = """l AS (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN 50 - q ELSE q END AS x FROM (
  SELECT 'p' || l_suppkey AS pair_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row, l_quantity AS q, l_partkey FROM lineitem))"""


@query("pair_examples", f"""WITH {_LINES}, {_EXAMPLES.replace('WIDTH', '59')} SELECT 'log_pair_bootstrap_v1' AS schema, 'wvgs' AS source, pair_id, pair_id || '_dgc.tif' AS scan_name, 'a.las' AS las_name, 'GR' AS curve_name, 'GR' AS curve_mnemonic, 'black' AS mode, printf('%s_%s_dgc_panel1_r%05d.png', pair_id, pair_id, s) AS roi_image_path, trace,
  -999.25::DOUBLE AS null_value, 1::INTEGER AS panel_index, 100::INTEGER AS panel_left_px, 160::INTEGER AS panel_right_px, 0.5::DOUBLE AS panel_match_score, round(score, 6) AS window_match_score, round(valid, 6) AS trace_valid_fraction, (100 + s * 0.5)::DOUBLE AS depth_start, (100 + (e - 1) * 0.5)::DOUBLE AS depth_end, TIMESTAMP '2024-02-01 00:00:00' AS saved_at_utc
  FROM score WHERE valid >= 0.7 AND score >= 0.08""")
def pair_examples(spark, sf):
    panel, traces_, measured = windows_of(spark, sf)
    e = pairing.window_examples(pairing.window_rows(panel, traces_, 256, 200), measured, "gr", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return r6(e, "panel_match_score", "window_match_score", "trace_valid_fraction", "depth_start", "depth_end")


#: Scans of 500 rows, a row a vector, with a thin stroke that follows the mean label of nine rows, and what was measured there.
_STROKE = """l AS (SELECT 'p' || i // 500 AS pair_id, i % 500 AS row, x, 2.0::DOUBLE * x + label AS q FROM (SELECT i, label, 8 + floor(s * 5 / n)::DOUBLE AS x FROM (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, label, sum(label) OVER w AS s, count(*) OVER w AS n FROM embeddings WINDOW w AS (ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))))"""


def strokes(spark, sf):
    """Pixels, scans and measured curves of pairs of one stroke: each has a plain scan, one whose name tells of another curve, and one without pixels."""
    near = Window.partitionBy(F.lit(0)).orderBy("vec_id")
    around = near.rowsBetween(-4, 4)
    e = t(spark, sf, "embeddings").select("label", (F.row_number().over(near) - 1).alias("i"), F.sum("label").over(around).alias("s"), F.count(F.lit(1)).over(around).alias("n"))
    e = e.select(F.concat(F.lit("p"), F.floor(F.col("i") / 500)).alias("pair_id"), (F.col("i") % 500).alias("y"), "label", (8 + F.floor(F.col("s") * 5 / F.col("n"))).alias("c"))
    image = lambda *ends: F.explode(F.array(*(F.struct(F.concat("pair_id", F.lit(f"/{n}")).alias("image_id"), F.concat("pair_id", F.lit(f"{n}.tif")).alias("scan")) for n in ends))).alias("of")
    ink = F.when(F.col("x") == F.col("c"), 30).otherwise(255)
    pixels_ = e.select(image("", "_t"), "y", "c", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x")).select("of.image_id", "y", "x", *(ink.alias(c) for c in "bgr"))
    scans = e.select("pair_id").distinct().select("pair_id", image("", "_t", "_x")).select("of.image_id", F.lit("wvgs").alias("source"), "pair_id", "of.scan", F.lit("a.las").alias("las_name"), F.lit("GR").alias("mnemonic"))
    return pixels_, scans, e.select("pair_id", (100 + F.col("y") * 0.5).alias("at"), (2.0 * F.col("c") + F.col("label")).alias("value"))


@query("pair_scan_examples", f"""WITH {_STROKE}, {_EXAMPLES.replace('WIDTH', '63')} SELECT pair_id, pair_id || '.tif' AS scan_name, printf('%s_%s_panel0_r%05d.png', pair_id, pair_id, s) AS roi_image_path, trace, round(score, 6) AS window_match_score, round(valid, 6) AS trace_valid_fraction, (100 + s * 0.5)::DOUBLE AS depth_start, (100 + (e - 1) * 0.5)::DOUBLE AS depth_end
  FROM score JOIN size USING (pair_id) WHERE valid >= 0.7 AND score >= 0.08 AND size.rows >= 256""")
def pair_scan_examples(spark, sf):
    """Examples from pixels: content, panel, windows, traces and match."""
    e, _ = pairing.scan_examples(*strokes(spark, sf), "gr", F.to_timestamp(F.lit("2024-02-01 00:00:00")), 256, 200, score_rows=500)
    return r6(e.select("pair_id", "scan_name", "roi_image_path", "trace", "window_match_score", "trace_valid_fraction", "depth_start", "depth_end"), "window_match_score", "trace_valid_fraction", "depth_start", "depth_end")
