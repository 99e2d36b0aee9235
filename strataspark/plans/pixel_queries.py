"""Queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import pixels
from .registry import nudged, query, r6, whole
from .standins import RASTER, raster

#: Runs of on-pixels (pix: image_id, y, x, "on") along rows, with the place of their start and their length.
_RUNS = """g0 AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM pix WHERE "on"),
runs AS (SELECT *, min(x) OVER (PARTITION BY image_id, y, g) AS run, count(*) OVER (PARTITION BY image_id, y, g) AS length FROM g0)"""


def _bgr():
    return F.col("b"), F.col("g"), F.col("r")


_HSV = """h0 AS (SELECT *, greatest(b, g, r) AS v, (greatest(b, g, r) - least(b, g, r))::DOUBLE AS d FROM pix),
h1 AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN 60.0::DOUBLE * (g - b) / d WHEN v = g THEN 120.0::DOUBLE + 60.0::DOUBLE * (b - r) / d ELSE 240.0::DOUBLE + 60.0::DOUBLE * (r - g) / d END AS a FROM h0),
hsv AS (SELECT *, CAST(round(CASE WHEN a < 0 THEN a + 360 ELSE a END / 2) AS BIGINT) % 180 AS h, CASE WHEN v = 0 THEN 0 ELSE CAST(round(255.0::DOUBLE * d / v) AS BIGINT) END AS s FROM h1)"""


@query("pix_colours", f"""WITH {RASTER}, {_HSV}
SELECT image_id, sum(CAST(round(0.299 * r::DOUBLE + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS BIGINT))::BIGINT AS gray, sum(h)::BIGINT AS hue, sum(s)::BIGINT AS saturation, sum(v)::BIGINT AS value,
  count(*) FILTER (r > 120 AND r > g + 20 AND r > b + 20) AS red, count(*) FILTER (g > 120 AND g > r + 20 AND g > b + 20) AS green, count(*) FILTER (b > 120 AND b > r + 20 AND b > g + 20) AS blue, count(*) FILTER (v <= 80) AS black,
  count(*) FILTER ((h <= 10 OR h >= 170) AND s >= 80 AND v >= 80) AS red_hue, count(*) FILTER (h BETWEEN 40 AND 90 AND s >= 80 AND v >= 80) AS green_hue, count(*) FILTER (h BETWEEN 90 AND 140 AND s >= 80 AND v >= 80) AS blue_hue
FROM hsv GROUP BY 1""")
def pix_colours(spark, sf):
    b, g, r = _bgr()
    p = raster(spark, sf).withColumn("c", C.hsv(b, g, r))
    h, s, v = F.col("c.h"), F.col("c.s"), F.col("c.v")
    masks = [F.count_if(C.mode_mask(F.lit(m), b, g, r)).alias(m) for m in ("red", "green", "blue", "black")]
    hues = [F.count_if(C.hue_mask(m, h, s, v)).alias(f"{m}_hue") for m in ("red", "green", "blue")]
    sums = [F.sum(C.gray(b, g, r)).alias("gray"), F.sum(h).alias("hue"), F.sum(s).alias("saturation"), F.sum(v).alias("value")]
    return p.groupBy("image_id").agg(*sums, *masks, *hues)


@query("pix_dominant_hue", f"""WITH {RASTER}, {_HSV}, ink AS (SELECT image_id, h // 10 AS bin FROM hsv WHERE x >= 22 AND x < 41 AND s > 60 AND v > 50 AND v < 230 AND image_id IN (SELECT image_id FROM pix GROUP BY 1 HAVING max(y) >= 9)),
b AS (SELECT image_id, bin, count(*) AS n FROM ink GROUP BY 1, 2), tb AS (SELECT image_id, sum(n) AS total, max(n) AS peak, arg_min(bin, -n * 100 + bin) AS bin FROM b GROUP BY 1)
SELECT i.image_id, CASE WHEN bin IN (0, 17) THEN 'red' WHEN bin BETWEEN 4 AND 8 THEN 'green' WHEN bin BETWEEN 9 AND 13 THEN 'blue' END AS colour FROM (SELECT DISTINCT image_id FROM pix) i LEFT JOIN (SELECT * FROM tb WHERE total >= 50 AND peak >= 0.1 * total) USING (image_id)""")
def pix_dominant_hue(spark, sf):
    p = raster(spark, sf).withColumn("c", C.hsv(*_bgr()))
    return pixels.dominant_hue(p.select("image_id", "y", "x", "c.*"), share=0.1)


@query("pix_crop", f"""WITH {RASTER} SELECT image_id, y - 3 AS y, x - 8 AS x, value FROM pix WHERE x >= 8 AND x < 40 AND y >= 3 AND y < 30""")
def pix_crop(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "value")
    bounds = (("left_px", 8), ("right_px", 40), ("top_px", 3), ("bottom_px", 30))
    return whole(pixels.crop(p, p.select("image_id").distinct().select("image_id", *(F.lit(v).alias(k) for k, v in bounds))), "x", "y")


def _blur3(value: str) -> str:
    """SQL of the row and the column pass of a 3 x 3 blur; w is the window."""
    return f"0.25 * coalesce(lag({value}) OVER w, lead({value}) OVER w, {value}) + 0.5 * {value} + 0.25 * coalesce(lead({value}) OVER w, lag({value}) OVER w, {value})"


_ROW, _COL = "w AS (PARTITION BY image_id, y ORDER BY x)", "w AS (PARTITION BY image_id, x ORDER BY y)"
#: A row or column pass of a 5 x 5 blur: beyond an edge the row is mirrored at its edge pixel, so the place next to the edge stands for the one two before it.
_FIVE = ("0.0625 * coalesce(lag({v}, 2) OVER w, CASE WHEN lag({v}) OVER w IS NOT NULL THEN {v} END, lead({v}, 2) OVER w, {v}) + 0.25 * coalesce(lag({v}) OVER w, lead({v}) OVER w, {v}) + 0.375 * {v} "
         "+ 0.25 * coalesce(lead({v}) OVER w, lag({v}) OVER w, {v}) + 0.0625 * coalesce(lead({v}, 2) OVER w, CASE WHEN lead({v}) OVER w IS NOT NULL THEN {v} END, lag({v}, 2) OVER w, {v})")


@query("pix_blur", f"""WITH {RASTER}, h AS (SELECT *, {_blur3('value')} AS s, {_FIVE.format(v='value')} AS f FROM pix WINDOW {_ROW})
SELECT image_id, y, x, CAST(round({_blur3('s')}) AS BIGINT) AS value, CAST(round({_FIVE.format(v='f')}) AS BIGINT) AS wide FROM h WINDOW {_COL}""")
def pix_blur(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", F.col("value").cast("double").alias("value"))
    wide = pixels.blur(p, size=4).withColumnRenamed("value", "wide")  # an even size is widened by one
    return whole(pixels.blur(p).join(wide, ["image_id", "y", "x"]), "y", "x", "value", "wide")


@query("pix_adaptive", f"""WITH {RASTER}, n AS (SELECT image_id, max(y) AS last FROM pix GROUP BY 1), w0 AS (SELECT d, exp(-d * d / 128.0::DOUBLE) AS w FROM range(-25, 26) t(d)), w AS (SELECT d, w / (SELECT sum(w) FROM w0) AS w FROM w0),
h AS (SELECT p.image_id, p.y, p.x, sum(w * q.value) AS m FROM pix p, w, pix q WHERE q.image_id = p.image_id AND q.y = p.y AND q.x = least(63, greatest(0, p.x + d)) GROUP BY 1, 2, 3),
v AS (SELECT p.image_id, p.y, p.x, round(sum(w * q.m)) AS m FROM h p JOIN n USING (image_id), w, h q WHERE q.image_id = p.image_id AND q.x = p.x AND q.y = least(n.last, greatest(0, p.y + d)) GROUP BY 1, 2, 3)
SELECT image_id, count(*) FILTER (value - m <= -10) AS "on" FROM pix JOIN v USING (image_id, y, x) GROUP BY 1""")
def pix_adaptive(spark, sf):
    p = pixels.adaptive_mask(raster(spark, sf).select("image_id", "y", "x", "value"))
    return p.groupBy("image_id").agg(F.count_if("on").alias("on"))


@query("pix_gridlines", f"""WITH {RASTER}, {_RUNS} SELECT image_id, y, x FROM runs WHERE length < CASE WHEN run = 0 THEN 4 - 2 WHEN run + length = 64 THEN 3 ELSE 4 END""")
def pix_gridlines(spark, sf):
    return whole(pixels.without_lines(raster(spark, sf).select("image_id", "y", "x", "on"), "x", 4, 64).select("image_id", "y", "x"), "y", "x")


_VERTICAL = """n AS (SELECT image_id, max(y) + 1 AS h FROM pix GROUP BY 1),
u0 AS (SELECT image_id, y, x, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS g FROM pix WHERE "on"),
u1 AS (SELECT *, min(y) OVER (PARTITION BY image_id, x, g) AS run, count(*) OVER (PARTITION BY image_id, x, g) AS length FROM u0),
upright AS (SELECT u1.*, least(15, h // 3) AS k, h FROM u1 JOIN n USING (image_id))"""


@query("pix_cleaned_lines", f"""WITH {RASTER}, {_VERTICAL}, left0 AS (SELECT image_id, y, x FROM upright WHERE h <= 15 OR length < CASE WHEN run = 0 THEN k - k // 2 WHEN run + length = h THEN k // 2 + 1 ELSE k END),
g0 AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM left0), g1 AS (SELECT *, min(x) OVER (PARTITION BY image_id, y, g) AS run, count(*) OVER (PARTITION BY image_id, y, g) AS length FROM g0)
SELECT image_id, y, x FROM g1 WHERE length < CASE WHEN run = 0 THEN 15 - 7 WHEN run + length = 64 THEN 8 ELSE 15 END""")
def pix_cleaned_lines(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "on")
    return whole(pixels.without_gridlines(p, pixels.sizes_of(p)).select("image_id", "y", "x"), "y", "x")


@query("pix_spines", f"""WITH {RASTER}, n AS (SELECT image_id, max(y) + 1 AS h FROM pix GROUP BY 1), f AS (SELECT image_id, x, count(*) FILTER ("on") / max(h) AS f, max(h) AS h FROM pix JOIN n USING (image_id) GROUP BY 1, 2)
SELECT image_id, y, pix.x FROM pix JOIN f USING (image_id, x) WHERE "on" AND NOT (f > 0.34 AND h >= 50)""")
def pix_spines(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "on")
    return whole(pixels.without_spines(p, pixels.sizes_of(p), 0.34, (50, 4)).select("image_id", "y", "x"), "y", "x")


_OTSU = """hist AS (SELECT image_id, value AS level, count(*) AS n FROM pix GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER u AS w0, sum(n * level) OVER u AS s0, sum(n) OVER a AS w, sum(n * level) OVER a AS s FROM hist WINDOW u AS (PARTITION BY image_id ORDER BY level), a AS (PARTITION BY image_id)),
v AS (SELECT image_id, level, round(w0::DOUBLE * (w - w0)::DOUBLE * power(s0::DOUBLE / w0::DOUBLE - (s - s0)::DOUBLE / (w - w0)::DOUBLE, 2), 0) AS bv FROM c WHERE w > w0),
otsu AS (SELECT image_id, min(level) AS threshold FROM (SELECT *, max(bv) OVER (PARTITION BY image_id) AS m FROM v) WHERE bv = m GROUP BY 1)"""


@query("pix_otsu", f"WITH {RASTER}, {_OTSU} SELECT image_id, CAST(threshold AS BIGINT) AS threshold FROM otsu")
def pix_otsu(spark, sf):
    return whole(pixels.otsu(raster(spark, sf)), "threshold")


@query("pix_gap_fill", f"""WITH {RASTER.replace('pix AS (', 'pix1 AS (')}, h AS (SELECT image_id, y, x, CASE WHEN "on" THEN 255 ELSE 0 END AS m, {_blur3('CASE WHEN "on" THEN 255 ELSE 0 END')} AS s FROM pix1 WINDOW {_ROW}),
pix AS (SELECT image_id, y, x, CAST(round({_blur3('s')}) AS BIGINT) AS value FROM h WINDOW {_COL}), {_OTSU}
SELECT image_id, y, x FROM pix LEFT JOIN otsu USING (image_id) WHERE value > coalesce(threshold, 0)""")
def pix_gap_fill(spark, sf):
    return whole(pixels.gap_filled(raster(spark, sf).select("image_id", "y", "x", "on")).where("on").select("image_id", "y", "x"), "y", "x")


@query("pix_rails", f"""WITH {RASTER.replace('pix AS (', 'pix1 AS (')}, pix AS (SELECT image_id, y, x, value < 40 AS "on" FROM pix1), {_RUNS}, {_VERTICAL.replace('least(15, h // 3)', 'greatest(12, h // 24)')},
rail AS (SELECT image_id, y, x FROM runs WHERE length >= CASE WHEN run = 0 THEN 12 - 6 WHEN run + length = 64 THEN 7 ELSE 12 END UNION SELECT image_id, y, x FROM upright WHERE length >= CASE WHEN run = 0 THEN k - k // 2 WHEN run + length = h THEN k // 2 + 1 ELSE k END)
SELECT p.image_id, p.y, p.x FROM pix1 p LEFT JOIN rail r ON r.image_id = p.image_id AND r.y = p.y AND r.x = p.x WHERE p.value > 25 AND r.x IS NULL""")
def pix_rails(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "value")
    return whole(pixels.without_rails(p, pixels.sizes_of(p)).where("on").select("image_id", "y", "x"), "y", "x")


def _edges(low: float, high: float) -> str:
    """SQL of the edge map: gradients of repeated borders, what no neighbour across the edge exceeds, and what can be reached from the sure ones."""
    return f"""g0 AS (SELECT image_id, y, x, value::DOUBLE AS v FROM pix),
g1 AS (SELECT *, lead(v, 1, v) OVER r - lag(v, 1, v) OVER r AS dx, lag(v, 1, v) OVER r + 2 * v + lead(v, 1, v) OVER r AS sx FROM g0 WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
g2 AS (SELECT image_id, y, x, lag(dx, 1, dx) OVER c + 2 * dx + lead(dx, 1, dx) OVER c AS gx, lead(sx, 1, sx) OVER c - lag(sx, 1, sx) OVER c AS gy FROM g1 WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
g3 AS (SELECT *, abs(gx) + abs(gy) AS m FROM g2),
beside AS (SELECT g3.image_id, g3.y, g3.x, dy, dx, n.m FROM g3, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), g3 n WHERE n.image_id = g3.image_id AND n.y = g3.y + dy AND n.x = g3.x + dx),
n AS (SELECT image_id, y, x, map_from_entries(list((dy * 3 + dx, m))) AS m FROM beside GROUP BY 1, 2, 3),
near AS (SELECT g3.*, list_transform(range(-4, 5), lambda i: coalesce(n.m[i], 0)) AS k FROM g3 JOIN n USING (image_id, y, x)),
weak AS MATERIALIZED (SELECT image_id, y, x, m FROM near WHERE m > {low} AND CASE WHEN abs(gy) < abs(gx) * tan(pi() / 8) THEN m > k[4] AND m >= k[6] WHEN abs(gy) > abs(gx) * tan(3 * pi() / 8) THEN m > k[2] AND m >= k[8]
  WHEN (gx < 0) <> (gy < 0) THEN m > k[3] AND m > k[7] ELSE m > k[1] AND m > k[9] END),
edge AS (SELECT image_id, y, x FROM weak WHERE m > {high} UNION
  SELECT w.image_id, w.y, w.x FROM edge e, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), weak w WHERE w.image_id = e.image_id AND w.y = e.y + dy AND w.x = e.x + dx)"""


#: SQL of the largest 8-connected component: of the pixels of `lit`, bars are runs of a row, the least number of a bar goes from bar to touching bar until nothing changes.
LARGEST = """bar AS MATERIALIZED (SELECT row_number() OVER (ORDER BY image_id, y, min(x)) AS id, image_id, y, min(x) AS a, max(x) AS b FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM lit) GROUP BY image_id, y, k),
touch AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM bar p, (VALUES (-1), (1)) v(dy), bar q WHERE q.image_id = p.image_id AND q.y = p.y + dy AND q.a <= p.b + 1 AND p.a <= q.b + 1),
spread(id, label) USING KEY (id) AS (SELECT id, id FROM bar UNION SELECT t.b, min(s.label) FROM spread s JOIN touch t ON t.a = s.id JOIN recurring.spread o ON o.id = t.b WHERE s.label < o.label GROUP BY t.b),
area AS (SELECT image_id, label, sum(b - a + 1)::BIGINT AS area FROM spread JOIN bar USING (id) GROUP BY 1, 2),
largest AS (SELECT image_id, arg_min(label, (-area, label)) AS label, max(area) AS area FROM area GROUP BY 1)"""


@query("pix_edges", f"WITH RECURSIVE {RASTER}, {_edges(150, 400)} SELECT image_id, y, x FROM edge")
def pix_edges(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", F.col("value").cast("double").alias("value"))
    return whole(pixels.edges(p, 150.0, 400.0), "y", "x")


#: SQL of the tracks from s (image_id, x, e: the column's edge pixels).
_TRACKS = """k AS (SELECT *, lag(e) OVER w AS a, lead(e) OVER w AS b, max(e) OVER (PARTITION BY image_id) AS top FROM s WINDOW w AS (PARTITION BY image_id ORDER BY x)),
p AS (SELECT image_id, x, row_number() OVER (PARTITION BY image_id ORDER BY x) AS n FROM k WHERE e > a AND e > b AND e > 0.3 * top),
kept AS (WITH RECURSIVE f(image_id, n, x, last) AS (SELECT image_id, n, x, x FROM p WHERE n = 1 UNION ALL SELECT p.image_id, p.n, p.x, CASE WHEN p.x - f.last >= 64 * 0.05 THEN p.x ELSE f.last END FROM f JOIN p ON p.image_id = f.image_id AND p.n = f.n + 1) SELECT DISTINCT image_id, last AS x FROM f),
m AS (SELECT image_id, x AS l, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS r, count(*) OVER (PARTITION BY image_id) AS n FROM kept)
SELECT image_id, CAST(l AS BIGINT) AS left_px, CAST(r AS BIGINT) AS right_px FROM m WHERE r IS NOT NULL UNION ALL
SELECT image_id, l, l + 21 FROM (SELECT DISTINCT image_id FROM pix WHERE image_id NOT IN (SELECT image_id FROM m WHERE n >= 2)), (VALUES (0), (21), (42)) v(l)"""


@query("pix_tracks", f"WITH {RASTER}, s AS (SELECT image_id, x, count(*) FILTER (value > 90) AS e FROM pix GROUP BY 1, 2), {_TRACKS}")
def pix_tracks(spark, sf):
    p = raster(spark, sf)
    return whole(pixels.tracks(p.where("value > 90").select("image_id", "y", "x"), pixels.sizes_of(p)), "left_px", "right_px")


@query("pix_edge_tracks", f"WITH RECURSIVE {RASTER}, {_edges(50, 150)}, s AS (SELECT image_id, x, count(e.y) AS e FROM pix LEFT JOIN edge e USING (image_id, y, x) GROUP BY 1, 2), {_TRACKS}")
def pix_edge_tracks(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", F.col("value").cast("double").alias("value"))
    return whole(pixels.tracks(pixels.edges(p, 50.0, 150.0), pixels.sizes_of(p)), "left_px", "right_px")


@query("pix_bounds", f"""WITH {RASTER}, s AS (SELECT image_id, y, avg(CASE WHEN value > 175 THEN 1.0 ELSE 0.0 END) AS f FROM pix GROUP BY 1, 2), c AS (SELECT *, greatest(0.03, 0.2 * max(f) OVER (PARTITION BY image_id)) AS cut, max(y) OVER (PARTITION BY image_id) + 1 AS h FROM s)
SELECT image_id, coalesce(greatest(0, min(y) FILTER (f > cut) - 8), 0) AS top_px, coalesce(least(max(h), max(y) FILTER (f > cut) + 9), max(h)) AS bottom_px FROM c GROUP BY 1""")
def pix_bounds(spark, sf):
    return whole(pixels.content_bounds(raster(spark, sf).withColumn("value", F.when(F.col("value") > 175, 0).otherwise(255))), "top_px", "bottom_px")


@query("pix_component", f"""WITH RECURSIVE {RASTER}, lit AS (SELECT image_id, y, x FROM pix WHERE "on"), {LARGEST} SELECT image_id, area FROM largest""")
def pix_component(spark, sf):
    return pixels.largest_component(raster(spark, sf).select("image_id", "y", "x", "on")).groupBy("image_id").agg(F.count(F.lit(1)).alias("area"))


def _near(f: str, c: str, along: str) -> str:
    by = "image_id, y ORDER BY x" if along == "x" else "image_id, x ORDER BY y"
    return f"{f}({c}) OVER (PARTITION BY {by} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


_OPENING = f"""b AS (SELECT *, {_near('bool_and', 'o', 'x')} AS o1 FROM a), c AS (SELECT *, {_near('bool_and', 'o1', 'y')} AS o2 FROM b),
d AS (SELECT *, {_near('bool_or', 'o2', 'x')} AS o3 FROM c), e AS (SELECT *, {_near('bool_or', 'o3', 'y')} AS o4 FROM d)"""


@query("pix_opening", f"""WITH {RASTER}, a AS (SELECT image_id, y, x, value > 20 AS o FROM pix), {_OPENING} SELECT image_id, count(*) FILTER (o4) AS area FROM e GROUP BY 1""")
def pix_opening(spark, sf):
    p = pixels.opened(raster(spark, sf).select("image_id", "y", "x", (F.col("value") > 20).alias("on")))
    return p.groupBy("image_id").agg(F.count_if("on").alias("area"))


@query("pix_fallback_mask", f"""WITH {RASTER}, l AS (SELECT image_id, y, x, least(255, value + 150) AS value FROM pix), h AS (SELECT *, {_FIVE.format(v='value')} AS f FROM l WINDOW {_ROW}),
a AS (SELECT image_id, y, x, round({_FIVE.format(v='f')}) <= 205 AS o FROM h WINDOW {_COL}), {_OPENING} SELECT image_id, count(*) FILTER (o4) AS area FROM e GROUP BY 1""")
def pix_fallback_mask(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", F.least(F.lit(255), F.col("value") + 150).alias("value"))
    return pixels.fallback_mask(p).groupBy("image_id").agg(F.count_if("on").alias("area"))


@query("pix_area_resample", f"""WITH {RASTER} SELECT image_id, y, x // 4 AS x, round(avg(value), 6) AS value FROM pix GROUP BY 1, 2, 3""")
def pix_area_resample(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "value")
    held = p.join(pixels.sizes_of(p), "image_id")
    return whole(r6(pixels.area_resampled(held, 64, F.col("height"), 16, F.col("height")), "value"), "y", "x")


@query("pix_bilinear", f"""WITH {RASTER}, n AS (SELECT image_id, max(y) + 1 AS h FROM pix GROUP BY 1), o AS (SELECT image_id, h, CAST(floor(h * 0.75) AS BIGINT) AS oh FROM n),
c AS (SELECT image_id, oy, ox, least(h - 1, greatest(0, (oy + 0.5::DOUBLE) * h / oh - 0.5)) AS sy, least(63, greatest(0, (ox + 0.5::DOUBLE) * 64 / 24 - 0.5)) AS sx, h FROM o, range(0, 24) t(ox), LATERAL (SELECT unnest(range(oh)) AS oy)),
d AS (SELECT *, CAST(floor(sy) AS BIGINT) AS y0, least(h - 1, CAST(floor(sy) AS BIGINT) + 1) AS y1, CAST(floor(sx) AS BIGINT) AS x0, least(63, CAST(floor(sx) AS BIGINT) + 1) AS x1 FROM c)
SELECT d.image_id, oy AS y, ox AS x, round((a.value * (1 - (sx - x0)) + b.value * (sx - x0)) * (1 - (sy - y0)) + (e.value * (1 - (sx - x0)) + f.value * (sx - x0)) * (sy - y0) + 1e-9, 6) AS value
FROM d JOIN pix a ON a.image_id = d.image_id AND a.y = y0 AND a.x = x0 JOIN pix b ON b.image_id = d.image_id AND b.y = y0 AND b.x = x1 JOIN pix e ON e.image_id = d.image_id AND e.y = y1 AND e.x = x0 JOIN pix f ON f.image_id = d.image_id AND f.y = y1 AND f.x = x1""")
def pix_bilinear(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "value")
    held = p.join(pixels.sizes_of(p), "image_id")
    return whole(r6(nudged(pixels.bilinear_resampled(held, 64, F.col("height"), 24, F.floor(F.col("height") * 0.75)), "value"), "value"), "y", "x")


_CENTRE = f"""{_RUNS}, c0 AS (SELECT *, least(x - run, run + length - 1 - x) + 1 AS dx, x = run + (length - 1) // 2 AS mid, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS h FROM runs),
c1 AS (SELECT *, least(y - min(y) OVER v, max(y) OVER v - y) + 1 AS dy FROM c0 WINDOW v AS (PARTITION BY image_id, x, h)), centre AS (SELECT image_id, y, x, mid, least(dx, dy) AS d FROM c1)"""


@query("pix_centre_score", f"""WITH {RASTER}, {_CENTRE} SELECT image_id, y, x, round(power(d / max(d) OVER (PARTITION BY image_id), 0.9), 6) AS p, mid FROM centre""")
def pix_centre_score(spark, sf):
    return whole(r6(pixels.centre_score(raster(spark, sf).select("image_id", "y", "x", "on")).drop("d"), "p"), "y", "x")


@query("pix_ridge", f"""WITH {RASTER}, {_CENTRE}, r0 AS (SELECT p.image_id, p.y, p.x, CASE WHEN mid THEN 1.0::DOUBLE ELSE 0.0 END AS m FROM pix p LEFT JOIN centre c ON c.image_id = p.image_id AND c.y = p.y AND c.x = p.x),
h AS (SELECT *, {_blur3('m')} AS s FROM r0 WINDOW {_ROW}), r AS (SELECT image_id, y, x, {_blur3('s')} AS ridge FROM h WINDOW {_COL}) SELECT image_id, y, x, round(ridge / max(ridge) OVER (PARTITION BY image_id), 6) AS ridge FROM r""")
def pix_ridge(spark, sf):
    p = raster(spark, sf).select("image_id", "y", "x", "on")
    mids = pixels.centre_score(p).select("image_id", "y", "x", "mid")
    dense = p.join(mids, ["image_id", "y", "x"], "left").fillna(False, ["mid"])
    return whole(r6(pixels.ridge_score(dense).select("image_id", "y", "x", "ridge"), "ridge"), "y", "x")


@query("pix_hue_weight", f"""WITH {RASTER}, {_HSV}, q AS (SELECT image_id, quantile_cont(value, 0.7) AS cut FROM hsv GROUP BY 1),
m AS (SELECT image_id, degrees(atan2(avg(sin(radians(h * 2.0::DOUBLE))), avg(cos(radians(h * 2.0::DOUBLE))))) AS m, count(*) AS n FROM hsv JOIN q USING (image_id) WHERE value > cut GROUP BY 1),
w AS (SELECT image_id, h - CASE WHEN m < 0 THEN m + 360 ELSE m END + 90 AS e, n FROM hsv LEFT JOIN m USING (image_id)), o AS (SELECT image_id, n, abs(e - 180 * floor(e / 180) - 90) AS o FROM w)
SELECT image_id, round(avg(CASE WHEN n > 20 THEN least(1, greatest(0.15, exp(-o * o / 288.0))) ELSE 1 END), 6) AS weight FROM o GROUP BY 1""")
def pix_hue_weight(spark, sf):
    p = raster(spark, sf).withColumn("c", C.hsv(*_bgr())).select("image_id", "y", "x", F.col("c.h").alias("h"), F.col("value").alias("ink"))
    return pixels.hue_weight(p).groupBy("image_id").agg(F.round(F.avg("weight"), 6).alias("weight"))
