"""Pairing of scans with measured curves: hints, panels, windows, match scores, window examples and skip reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NULL_MARKER, gray, mode_mask
from . import pixels as P
from . import traces as T

# What a file name hints at, and the schema name of an example.
HINTS = (("dgc", ("BD", "CAL", "GR")), ("ngc", ("CAL", "DPHI", "GR")), ("ilz", ("RILD",)))
LONE = (("i", ("RILD",)), ("t", ("TEMP",)))
EXAMPLE_SCHEMA = "log_pair_bootstrap_v1"
#: The least rows and columns of an example, and the widest scan that isn't taken as several logs side by side.
LEAST_ROWS, LEAST_COLUMNS, WIDEST = 128, 32, 2600
#: Rows and most columns of a panel where it is scored.
SCORE_ROWS, SCORE_COLUMNS = 1800, 900


def hinted_curves(name: Column) -> Column:
    """Sorted curves that a file name hints at; null where it hints at none, so that any is possible. A lone letter has no letter beside it."""
    n = F.lower(name)
    lone = lambda c: n.rlike(rf"(^|[^a-z]){c}([^a-z]|$)")
    curves = dict(HINTS)
    words = lambda cs: F.array(*map(F.lit, cs))
    return (
        F.when(n.contains("dgc"), words(curves["dgc"]))
        .when(n.contains("ngc"), words(curves["ngc"]))
        .when(n.contains("ilz") | lone(LONE[0][0]), words(LONE[0][1]))
        .when(lone(LONE[1][0]), words(LONE[1][1]))
    )


def hinted(name: Column, curve: Column) -> Column:
    """Whether a file name allows a curve."""
    return F.coalesce(F.array_contains(hinted_curves(name), F.upper(F.trim(curve))), F.lit(True))


def panel_count(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("dgc") | n.contains("ngc"), 3).otherwise(1)


def panels(scans: DataFrame, least: int = LEAST_COLUMNS) -> DataFrame:
    """scan, panel, left_px, right_px: the width (scans: scan, width, panels) cut evenly, half-even; narrow panels are left out; where none is left, the whole width is one."""
    p = scans.select("scan", "width", "panels", F.explode(F.expr("sequence(0, greatest(panels, 1) - 1)")).alias("panel"))
    bound = lambda i: F.bround(F.col("width") * i / F.greatest(F.lit(1), "panels")).cast("int")
    p = p.select("scan", "width", "panels", "panel", bound(F.col("panel")).alias("left_px"), bound(F.col("panel") + 1).alias("right_px"))
    wide = (F.col("panels") <= 1) | (F.col("right_px") - F.col("left_px") >= least)
    rows = F.filter(F.array_sort(F.collect_list(F.when(wide, F.struct("panel", "left_px", "right_px")))), lambda x: x.isNotNull())
    whole = F.array(F.struct(F.lit(0).alias("panel"), F.lit(0).alias("left_px"), F.col("width").cast("int").alias("right_px")))
    g = p.groupBy("scan", "width").agg(rows.alias("r"))
    return g.select("scan", F.explode(F.when(F.size("r") > 0, F.col("r")).otherwise(whole)).alias("p")).select("scan", "p.*")


def window_starts(height: Column, size: int, stride: int, most: int) -> Column:
    """Starts on the stride grid and the last one, thinned to `most` evenly spaced picks."""
    last = F.greatest(F.lit(0), height - size)
    grid = F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    n = F.size(grid)
    thin = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(grid, F.floor(i * (n - 1) / max(1, most - 1)).cast("int"))))
    return F.when(n > most, thin).otherwise(grid)


def match_scores(rows: DataFrame, keys: tuple[str, ...], width: str = "width", least: int = 100) -> DataFrame:
    """keys, valid, score from rows of keys, x, value, width: the better correlation of both signs, of places and values each clipped to their 2nd and 98th percentile, weighed by valid share and span.

    valid is the share of rows with a place. The score is null under `least` common rows, for a span under 8 columns or
    5 % of the width, and where places or values don't vary.
    """
    ok = F.col("x").isNotNull() & F.col("value").isNotNull()
    edge = F.array(F.lit(0.02), F.lit(0.98))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("placed"), F.count_if(ok).alias("n"), F.first(width).alias("w"),
        F.percentile(F.when(ok, F.col("x")), edge).alias("qx"), F.percentile(F.when(ok, F.col("value")), edge).alias("qv"))
    low, high = (lambda q: F.get(q, F.lit(0))), (lambda q: F.get(q, F.lit(1)))
    clipped = lambda c, q: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - low(q)) / F.greatest(F.lit(1e-6), high(q) - low(q))))
    j = rows.alias("r").join(g.select(*(F.col(k).alias(f"_{k}") for k in keys), "qx", "qv"), F.expr(" and ".join(f"{k} <=> _{k}" for k in keys))).where(ok)
    j = j.select(*keys, clipped("x", "qx").alias("u"), clipped("value", "qv").alias("v"))
    r = j.groupBy(*keys).agg(F.corr("u", "v").alias("r"), F.stddev_pop("u").alias("su"), F.stddev_pop("v").alias("sv"))
    out = g.alias("g").join(r.alias("c"), F.expr(" and ".join(f"g.{k} <=> c.{k}" for k in keys)), "left")
    span = high("qx") - low("qx")
    good = (F.col("n") >= least) & (span >= F.greatest(F.lit(8.0), 0.05 * F.col("w"))) & (F.col("su") >= 1e-4) & (F.col("sv") >= 1e-4) & (high("qv") - low("qv") >= 1e-6)
    valid = F.col("placed") / F.col("rows")
    score = F.abs("r") * F.greatest(F.lit(0.25), valid) * F.greatest(F.lit(0.25), F.least(F.lit(1.0), span / F.greatest(F.lit(1.0), F.col("w") - 1.0) / 0.25))
    return out.select(*(F.col(f"g.{k}").alias(k) for k in keys), valid.alias("valid"), F.when(good & ~F.isnan("r"), score).alias("score"))


def best_panel(scores: DataFrame, valid: float = 0.7, least: float = 0.1) -> DataFrame:
    """Each scan's panel of highest score, the first on ties, of those that reach the valid share; scans whose best is under the least score have none."""
    w = Window.partitionBy("scan").orderBy(F.desc("score"), "panel")
    return scores.where((F.col("valid") >= valid) & F.col("score").isNotNull()).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("score") >= least)).drop("_n")


def window_rows(panel: DataFrame, traces: DataFrame, height: int = 1400, stride: int = 1000, most: int = 18) -> DataFrame:
    """The rows of each window of the chosen panels: panel columns, start_row, end_row, row, x.

    panel: pair_id, scan, panel, left_px, right_px, rows (height of the content), depth_first, depth_last; traces: pair_id,
    scan, start_row, row, x, the trace of each window by itself (row from 0). Windows under 128 rows or 32 columns are out.
    """
    w = panel.withColumn("start_row", F.explode(window_starts(F.col("rows"), height, stride, most)))
    w = w.withColumn("end_row", F.least("rows", F.col("start_row") + height))
    w = w.where((F.col("end_row") - F.col("start_row") >= LEAST_ROWS) & (F.col("right_px") - F.col("left_px") >= LEAST_COLUMNS))
    at = lambda r: F.col("depth_first") + r / F.greatest(F.lit(1), F.col("rows") - 1) * (F.col("depth_last") - F.col("depth_first"))
    w = w.withColumn("depth_start", at(F.col("start_row"))).withColumn("depth_end", at(F.col("end_row") - 1))
    return w.join(traces.select("pair_id", "scan", "start_row", "row", "x"), ["pair_id", "scan", "start_row"]).where("row < end_row - start_row")


def window_examples(rows: DataFrame, measured: DataFrame, curve: str, saved_at: Column, valid: float = 0.70, least: float = 0.08) -> DataFrame:
    """The example record of every window whose trace has the valid share and matches the measured curve: rows of window_rows() with source, las_name, mnemonic and panel_score, measured (pair_id, at, value).

    The measured curve is read linearly between the window's depths. A record is one value of its window's rows.
    """
    from .curves import resampled

    keys = ("pair_id", "scan", "panel", "start_row")
    n = F.col("end_row") - F.col("start_row")
    r = rows.withColumn("at", F.col("depth_start") + F.col("row") / F.greatest(F.lit(1), n - 1) * (F.col("depth_end") - F.col("depth_start")))
    # A pair's curve is read once at the depths of all its windows' rows; what is read is stored, for scores and traces both need it.
    curves = resampled(measured.select("pair_id", "at", "value"), r.select("pair_id", "at").distinct(), ("pair_id",))
    j = P.cut(r.join(P.apart(curves), ["pair_id", "at"], "left").withColumn("width", F.col("right_px") - F.col("left_px")))
    s = match_scores(j, keys).where((F.col("valid") >= valid) & (F.col("score") >= least)).withColumnRenamed("score", "window_score")
    trace = F.transform(F.array_sort(F.collect_list(F.struct("row", "x"))), lambda p: F.coalesce(p["x"], F.lit(NULL_MARKER)))
    one = ("source", "las_name", "mnemonic", "left_px", "right_px", "panel_score", "depth_start", "depth_end")
    e = j.groupBy(*keys).agg(trace.alias("trace"), *(F.first(c).alias(c) for c in one)).join(s, list(keys))
    stem = F.regexp_replace("scan", r"\.[^.]*$", "")
    return e.select(
        F.lit(EXAMPLE_SCHEMA).alias("schema"), "source", "pair_id", F.col("scan").alias("scan_name"), "las_name", F.lit(curve.strip().upper()).alias("curve_name"), F.col("mnemonic").alias("curve_mnemonic"),
        F.lit("black").alias("mode"), F.concat(image_id(F.col("pair_id"), stem, F.col("panel"), F.col("start_row")), F.lit(".png")).alias("roi_image_path"), "trace", F.lit(NULL_MARKER).alias("null_value"),
        F.col("panel").alias("panel_index"), F.col("left_px").alias("panel_left_px"), F.col("right_px").alias("panel_right_px"), F.col("panel_score").alias("panel_match_score"),
        F.col("window_score").alias("window_match_score"), F.col("valid").alias("trace_valid_fraction"), "depth_start", "depth_end", saved_at.alias("saved_at_utc"))


def black_traces(pixels: DataFrame, curve: str) -> DataFrame:
    """image_id, row_idx, x of the path through the dark ink of each image (image_id, y, x, b, g, r)."""
    prob = pixels.select("image_id", "y", "x", mode_mask(F.lit("black"), F.col("b"), F.col("g"), F.col("r")).cast("double").alias("p"))
    images = prob.select("image_id").distinct()
    setting = T.settings(images, curve_type=curve, scale_min=0.0, scale_max=150.0, hot_side="right", step=30, smooth=0.001, bend=0.001)
    return P.cut(T.dp_tracer(P.cut(prob), setting).select("image_id", "row_idx", "x"))


def _at(row: Column, rows: Column) -> Column:
    """The depth of a row, evenly from depth_first to depth_last."""
    return F.col("depth_first") + row / F.greatest(F.lit(1), rows - 1) * (F.col("depth_last") - F.col("depth_first"))


def panel_scores(pixels: DataFrame, regions: DataFrame, measured: DataFrame, curve: str, score_rows: int = SCORE_ROWS) -> DataFrame:
    """key, valid, score of panels: regions (key, image_id, pair_id, left_px, right_px, top_px, bottom_px, depth_first, depth_last).

    A panel is brought to score_rows rows and at most 900 columns, by area where it shrinks both ways, else linearly, traced
    there, and its trace compared with the pair's measured curve (pair_id, at, value) read at the same depths.
    """
    from .curves import resampled

    w, h = F.col("right_px") - F.col("left_px"), F.col("bottom_px") - F.col("top_px")
    sized = P.cut(regions.select("*", w.alias("w"), h.alias("h"), F.least(w, F.lit(SCORE_COLUMNS)).alias("out_w")))
    roi = P.crop(pixels, sized.select("image_id", "key", "left_px", "right_px", "top_px", "bottom_px", "w", "h", "out_w")).withColumn("image_id", F.col("key"))
    args = F.col("w"), F.col("h"), F.col("out_w"), F.lit(score_rows)
    small = P.area_resampled(roi.where(F.col("h") >= score_rows), *args, ("b", "g", "r")).union(P.bilinear_resampled(roi.where(F.col("h") < score_rows), *args, ("b", "g", "r")))
    trace = black_traces(small.select("image_id", "y", "x", *(F.round(c).alias(c) for c in "bgr")), curve)
    rows = trace.withColumnRenamed("image_id", "key").join(sized, "key").select("key", "x", F.col("out_w").alias("width"), _at(F.col("row_idx"), F.lit(score_rows)).alias("at"))
    read = resampled(sized.select("key", "pair_id").join(measured, "pair_id").select("key", "at", "value"), rows.select("key", "at"), ("key",))
    return match_scores(P.cut(rows.join(read, ["key", "at"])), ("key",))


def scan_examples(
    pixels: DataFrame, scans: DataFrame, measured: DataFrame, curve: str, saved_at: Column, height: int = 1400, stride: int = 1000, most: int = 18, score_rows: int = SCORE_ROWS,
    valid: float = 0.70, least_panel: float = 0.10, least_window: float = 0.08, full_scans: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """From scans' pixels and their pairs' measured curves to example records and to every scan's reason for having none (null where it has a panel).

    pixels: image_id, y, x, b, g, r, dense; scans: image_id, source, pair_id, scan (file name), las_name, mnemonic; measured:
    pair_id, at, value. Each scan's content is cut into panels by what its name tells, the panel is taken whose trace
    matches the measured curve best, and its windows are traced by themselves. Content is taken to run evenly from the
    least to the greatest measured depth. Images without a scan row are ignored; scans without pixels are unreadable.
    """
    name = F.regexp_replace("scan", r"\.[^.]*$", "")
    bounds = P.content_bounds(pixels.select("image_id", "y", "x", gray(F.col("b"), F.col("g"), F.col("r")).alias("value")))
    bounds = bounds.join(P.sizes_of(pixels).select("image_id", "width"), "image_id")
    ends = measured.groupBy("pair_id").agg(F.min("at").alias("depth_first"), F.max("at").alias("depth_last"))
    s = scans.join(bounds, "image_id", "left").join(ends, "pair_id", "left").withColumn("rows", F.col("bottom_px") - F.col("top_px")).withColumn("panels", panel_count(name))
    reason = lambda matched: scan_reason(hinted(name, F.lit(curve)), F.col("width"), F.col("rows"), F.col("panels"), matched, height, full_scans)
    s = P.cut(s.withColumn("reason", reason(F.lit(True))))

    some = s.where("reason is null")
    cuts = panels(some.select(F.col("image_id").alias("scan"), "width", "panels")).where(F.col("right_px") - F.col("left_px") >= LEAST_COLUMNS)
    p = some.join(cuts.withColumnRenamed("scan", "image_id"), "image_id").withColumn("key", F.format_string("%s|%d", "image_id", F.col("panel")))
    p = P.cut(p.select("key", "image_id", "source", "pair_id", "scan", "las_name", "mnemonic", "panel", "left_px", "right_px", "top_px", "bottom_px", "rows", "depth_first", "depth_last"))
    scores = panel_scores(pixels, p, measured, curve, score_rows).join(p.select("key", F.col("image_id").alias("scan"), "panel"), "key")
    best = best_panel(scores, valid, least_panel).select("key", F.col("score").alias("panel_score"))
    p = P.cut(p.join(best, "key"))

    start = F.explode(window_starts(F.col("rows"), height, stride, most))
    w = p.select("image_id", "pair_id", "scan", "left_px", "right_px", "top_px", "rows", start.alias("start_row"))
    w = w.withColumn("bottom_px", F.col("top_px") + F.least("rows", F.col("start_row") + height)).withColumn("top_px", F.col("top_px") + F.col("start_row"))
    w = P.cut(w.where(F.col("bottom_px") - F.col("top_px") >= LEAST_ROWS).withColumn("key", F.format_string("%s|%d", "image_id", F.col("start_row"))))
    roi = P.crop(pixels, w.select("image_id", "key", "left_px", "right_px", "top_px", "bottom_px")).withColumn("image_id", F.col("key"))
    found = black_traces(roi, curve).withColumnRenamed("image_id", "key").join(w.select("key", "pair_id", "scan", "start_row"), "key")
    rows = window_rows(p.drop("key", "image_id", "top_px", "bottom_px"), found.withColumnRenamed("row_idx", "row"), height, stride, most)
    done = window_examples(rows, measured, curve, saved_at, valid, least_window)
    why = s.join(p.select("image_id", F.lit(True).alias("hit")), "image_id", "left").select("source", "pair_id", "scan", reason(F.coalesce("hit", F.lit(False))).alias("reason"))
    return done, why


def pair_reason(has_las: Column, has_scan: Column, mnemonic: Column, curve: Column, samples: Column) -> Column:
    """Why a pair is left out before any scan is read, else null."""
    missing = F.when(~has_las | ~has_scan, "missing_las_or_tif").when(mnemonic.isNull(), F.concat(F.lit("curve_not_found:"), curve))
    return missing.when(samples < 50, "invalid_las_curve")


def scan_reason(allowed: Column, width: Column, rows: Column, panels_: Column, matched: Column, window: int = 1400, full_scans: bool = False) -> Column:
    """Why a scan is left out, else null: hint, unreadable image (null width), too little content, a wide scan of one panel, or no panel that matches."""
    return (
        F.when(~allowed, "curve_hint_excludes_target")
        .when(width.isNull(), "image_read_failed")
        .when(rows < max(256, window // 2), "content_too_small")
        .when((panels_ == 1) & (width > WIDEST) & F.lit(not full_scans), "full_scan_requires_allow_full_scans")
        .when(~matched, "no_panel_match")
    )


def pair_summary(pairs: DataFrame, scans: DataFrame, examples: DataFrame) -> DataFrame:
    """source, pair_id, status, reason, example_count, skipped_scans of every pair: pairs (source, pair_id, reason), scans (source, pair_id, scan, reason), examples (source, pair_id)."""
    keys = ["source", "pair_id"]
    n = examples.groupBy(*keys).agg(F.count(F.lit(1)).alias("example_count"))
    s = scans.where("reason is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("scan", "reason"))).alias("skipped_scans"))
    j = pairs.join(n, keys, "left").join(s, keys, "left").withColumn("example_count", F.coalesce("example_count", F.lit(0)).cast("long"))
    status = F.when(F.col("example_count") > 0, "ok").otherwise("skipped")
    none = F.array().cast("array<struct<scan:string,reason:string>>")
    why = F.when(F.col("example_count") == 0, F.coalesce("reason", F.lit("no_examples")))
    return j.select(*keys, status.alias("status"), why.alias("reason"), "example_count", F.coalesce("skipped_scans", none).alias("skipped_scans"))


def image_id(pair: Column, scan: Column, panel: Column, row: Column) -> Column:
    return F.format_string("%s_%s_panel%d_r%05d", pair, scan, panel.cast("int"), row.cast("int"))
