"""Selection of training rows from configs, results, captures, corrections and images, and their label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NULL_MARKER, gray, mode_name
from .pixels import area_resampled

# The schemas of saved captures, and the window round an edited row.
CAPTURE_SCHEMAS = ("bad_black_segment_v1", "bad_black_segment_v2")
CORRECTION_WINDOW = 160


def _given(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _filtered(rows: DataFrame, curve: str, modes: tuple[str, ...]) -> DataFrame:
    """Rows of one curve (any, if empty) and of the modes (any, if none)."""
    rows = rows.where(F.col("curve_name") == curve.strip().upper()) if curve.strip() else rows
    return rows.where(F.col("mode").isin(*modes)) if modes else rows


def _upper(*names: Column) -> Column:
    return F.upper(F.trim(F.coalesce(*map(_given, names), F.lit(""))))


def zipped(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Configs (ord, job struct) and results (ord, item struct) by position, as sources.lines.json_places() gives it; the shorter ends it; failures are left out.

    An item that names a source holds its result inside; another is the result itself. Where only the lengths of traces are
    asked, results may hold those (lengths()) in the traces' stead, so that no trace is moved to its config.
    """
    kinds = dict(results.dtypes)["item"]
    r = results.withColumn("result", F.when(F.col("item.source").isNotNull() & F.col("item.result").isNotNull(), F.col("item.result"))
                           .otherwise(F.struct(F.col("item.success").alias("success"), F.col("item.curve_traces").alias("curve_traces")))) if "source:" in kinds else results.withColumn("result", F.col("item"))
    return configs.join(r.select("ord", "result"), "ord").where(F.coalesce("result.success", F.lit(False)))


def lengths(item: Column) -> Column:
    """A result item (source, result, success, curve_traces) with the lengths of its traces instead of the traces."""
    of = lambda traces: F.transform_values(traces, lambda _, v: F.when(v.isNotNull(), F.size(v)))
    result = F.when(item["result"].isNotNull(), F.struct(item["result"]["success"].alias("success"), of(item["result"]["curve_traces"]).alias("curve_traces")))
    return F.struct(item["source"].alias("source"), result.alias("result"), item["success"].alias("success"), of(item["curve_traces"]).alias("curve_traces"))


def curve_items(jobs: DataFrame, curve: str = "", modes: tuple[str, ...] = ()) -> DataFrame:
    """ord, curve_name, mode, image, image_path, bounds, null_value and trace (its length, if jobs hold lengths) of each curve that has an image, a depth range, a column range and a trace under its own name (las_mnemonic, else name)."""
    j = jobs.where(F.coalesce(_given(F.col("job.image")), _given(F.col("job.image_path"))).isNotNull())
    depth = F.col("job.config.depth")
    j = j.select("ord", F.col("job.image").alias("image"), F.col("job.image_path").alias("image_path"), F.coalesce(depth["top_px"], F.lit(0)).alias("top_px"), F.coalesce(depth["bottom_px"], F.lit(0)).alias("bottom_px"),
                 F.coalesce(F.col("job.config.global_options.null"), F.lit(NULL_MARKER)).alias("null_value"), F.explode("job.config.curves").alias("c"), F.col("result.curve_traces").alias("traces")).where("bottom_px > top_px")
    key = F.coalesce(F.when(F.col("c.las_mnemonic") != "", F.col("c.las_mnemonic")), F.when(F.col("c.name") != "", F.col("c.name")))
    c = j.where(key.isNotNull()).select(
        "ord", F.upper(F.trim(key)).alias("curve_name"), mode_name(F.col("c.mode")).alias("mode"), "image", "image_path", "top_px", "bottom_px",
        F.coalesce("c.left_px", F.lit(0)).alias("left_px"), F.coalesce("c.right_px", F.lit(0)).alias("right_px"), "null_value", F.element_at("traces", key).alias("trace"))
    return _filtered(c.where("trace is not null and right_px > left_px"), curve, modes)


def examples(records: DataFrame, curve: str = "", modes: tuple[str, ...] = ()) -> DataFrame:
    """Examples with an image, inline or by path, and a trace; UNKNOWN where no curve is named."""
    r = records.withColumn("curve_name", _upper(F.col("curve_name"), F.col("name"))).withColumn("mode", mode_name(F.col("mode")))
    r = _filtered(r, curve, modes).where(F.coalesce(F.when(F.col("roi_image") != "", F.col("roi_image")), _given(F.col("roi_image_path"))).isNotNull() & F.col("trace").isNotNull())
    return r.withColumn("curve_name", F.when(F.col("curve_name") == "", "UNKNOWN").otherwise(F.col("curve_name"))).withColumn("null_value", F.coalesce("null_value", F.lit(NULL_MARKER)))


def captures(records: DataFrame, review: bool = False, curve: str = "", modes: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The chosen captures, and one row of counts: total (of a known schema), ready and unready (after the filters), used.

    Ready are those marked so, or corrected. Chosen are ready ones, and with `review` others too, that have an image and
    a trace.
    """
    r = records.where(F.col("schema").isin(*CAPTURE_SCHEMAS))
    r = r.withColumn("curve_name", _upper(F.col("curve_name"), F.col("name"))).withColumn("mode", mode_name(F.col("mode")))
    r = r.withColumn("ready", F.coalesce("training_ready", F.lit(False)) | F.coalesce(F.lower(F.trim("status")) == "corrected", F.lit(False)))
    inside = F.lit(True)
    if curve.strip():
        inside = inside & (F.col("curve_name") == curve.strip().upper())
    if modes:
        inside = inside & F.col("mode").isin(*modes)
    has = F.coalesce(_given(F.col("roi_image_path")), F.when(F.col("roi_image") != "", F.col("roi_image"))).isNotNull() & F.col("trace").isNotNull()
    used = inside & has & (F.lit(review) | F.col("ready"))
    unready = F.lit(0).cast("long") if review else F.count_if(inside & ~F.col("ready"))
    counts = r.agg(F.count(F.lit(1)).alias("total"), F.count_if(inside & F.col("ready")).alias("ready"), unready.alias("unready"), F.count_if(used).alias("used"))
    chosen = r.where(used).withColumn("curve_name", F.when(F.col("curve_name") == "", "UNKNOWN").otherwise(F.col("curve_name")))
    return chosen.withColumn("null_value", F.coalesce("null_value", F.lit(NULL_MARKER))).drop("ready"), counts


def corrections(events: DataFrame, curve: str = "", modes: tuple[str, ...] = ()) -> DataFrame:
    """Corrections with an image, finite places and a valid track, with curve_name and mode."""
    places = ("after.x", "after.y", "track.leftX", "track.rightX")
    finite = " and ".join(f"{p} is not null and not isnan({p}) and abs({p}) < double('infinity')" for p in places)
    e = events.where(finite).where("track.rightX > track.leftX and image_path <> ''")
    e = e.withColumn("curve_name", _upper(F.col("curve_id"))).withColumn("mode", mode_name(F.col("mode")))
    return _filtered(e, curve, modes).withColumn("curve_name", F.when(F.col("curve_name") == "", "UNKNOWN").otherwise(F.col("curve_name")))


def local_places(events: DataFrame, out_w: int, out_h: int, height: Column | None = None) -> DataFrame:
    """event_id, x, row: places clipped to the track and scaled to out_w columns; the row of the crop, which is its middle unless the place is nearer the top, scaled to out_h rows.

    A crop has `height` rows (by default the window round the edited row and that row).
    """
    left, right, y = F.col("track.leftX"), F.col("track.rightX"), F.col("after.y")
    h = F.lit(CORRECTION_WINDOW + 1) if height is None else height
    w = F.greatest(F.lit(1.0), right - left)
    x = F.greatest(F.lit(0.0), F.least(w - 1, F.col("after.x") - left)) / F.greatest(F.lit(1.0), w - 1) * (out_w - 1)
    middle = CORRECTION_WINDOW / 2
    row = F.when(y < middle, y).otherwise(F.least(h - 1.0, F.lit(middle)))
    row = F.greatest(F.lit(0.0), F.least(h - 1.0, row)) / F.greatest(F.lit(1.0), h - 1.0) * (out_h - 1)
    return events.select("event_id", x.alias("x"), F.least(F.lit(out_h - 1), F.greatest(F.lit(0), F.bround(row).cast("int"))).alias("row"))


def label_rows(traces: DataFrame, out_w: int, out_h: int, sigma: float = 2.5) -> DataFrame:
    """key, row, valid, centre, target from traces (key, trace array, width, null_value): the trace read linearly at out_h rows, scaled to out_w columns, with a Gaussian over them.

    A row is valid if its place is one, isn't the null marker and lies in the width; targets of others are 0.
    """
    n = F.size("trace")
    t = traces.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(out_h - 1))).alias("row"))
    at = F.col("row") * (n - 1) / max(1, out_h - 1)
    a = F.floor(at).cast("int")
    first, second = F.get("trace", a), F.get("trace", F.least(n - 1, a + 1))
    x = F.nanvl(first * (1 - (at - a)) + second * (at - a), F.lit(None).cast("double"))
    t = t.withColumn("x", x).withColumn("last", F.greatest(F.lit(1), "width") - 1)
    ok = F.coalesce(F.col("x").between(0, F.col("last")) & (F.col("x") != F.col("null_value")), F.lit(False))
    px = F.when(F.col("last") == 0, 0.0).otherwise(F.least(F.col("last").cast("double"), F.greatest(F.lit(0.0), "x")) / F.col("last") * (out_w - 1))
    t = t.select("key", "row", ok.alias("valid"), px.alias("px"))
    s = max(1.0, sigma)
    target = F.transform(F.sequence(F.lit(0), F.lit(out_w - 1)), lambda i: F.when(F.col("valid"), F.exp(-0.5 * F.pow((i - F.col("px")) / s, F.lit(2.0)))).otherwise(0.0))
    return t.select("key", "row", "valid", (F.col("px") / max(1, out_w - 1)).alias("centre"), target.alias("target"))


def input_rows(pixels: DataFrame, width, height, out_w, out_h) -> DataFrame:
    """image_id, y, row: grey values of 0 to 1, one array for each output row."""
    g = area_resampled(pixels.withColumn("value", gray(F.col("b"), F.col("g"), F.col("r"))), width, height, out_w, out_h)
    return g.groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "value"))), lambda p: (p["value"] / 255).cast("float")).alias("row"))


def modes(items: DataFrame) -> DataFrame:
    return items.agg(F.array_sort(F.collect_set("mode")).alias("modes"), F.count(F.lit(1)).alias("items"))
