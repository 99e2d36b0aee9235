"""Depth and curve warnings, snapping to labels, and depth lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PHYSICAL


def depth_warnings(top_px: Column, bottom_px: Column, top: Column, bottom: Column, height: Column, most_per_px: float = 10.0) -> Column:
    flags = F.array(F.when(bottom <= top, F.lit("bottom_not_below_top")), F.when(F.abs(bottom - top) / F.greatest(F.lit(1), bottom_px - top_px) > most_per_px, F.lit("extreme_depth_per_pixel")), F.when((top_px < 0) | (bottom_px > height), F.lit("outside_image")))
    return F.filter(flags, lambda x: x.isNotNull())


def curve_warnings(features: DataFrame, flat: float = 1e-3, missing: float = 30.0) -> DataFrame:
    t = features.sparkSession.createDataFrame([(k, *v) for k, v in PHYSICAL.items()], "type string, lo double, hi double")
    f = features.join(F.broadcast(t), "type", "left")
    flags = F.array(F.when((F.col("min") < F.col("lo")) | (F.col("max") > F.col("hi")), F.lit("out_of_range")), F.when(F.col("std") < flat, F.lit("flat")), F.when(F.col("pct_missing") > missing, F.lit("many_nulls")))
    return f.withColumn("warnings", F.filter(flags, lambda x: x.isNotNull())).drop("lo", "hi")


def snapped(clicks: DataFrame, labels: DataFrame, tolerance: int) -> DataFrame:
    """click, label: each click's (image_id, click, y) nearest depth label (image_id, label, y) within the tolerance, by buckets of its size."""
    b = clicks.withColumn("bucket", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> cast(floor(y / {tolerance}) as long) + d)")))
    l = labels.select("image_id", "label", F.col("y").alias("ly"), F.floor(F.col("y") / tolerance).cast("long").alias("bucket"))
    hit = b.join(l, ["image_id", "bucket"]).withColumn("d", F.abs(F.col("y") - F.col("ly"))).where(F.col("d") <= tolerance)
    w = Window.partitionBy("image_id", "click").orderBy("d", "ly", "label")
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select("image_id", "click", "label")


def nice_step(span: Column, lines: Column | int = 8) -> Column:
    """The least of 1, 2 and 5 times a power of ten that cuts a span into at most so many intervals; null for an empty span."""
    lines = lines if isinstance(lines, Column) else F.lit(lines)
    raw = F.abs(span) / F.greatest(F.lit(1), lines)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw) + 1e-9))
    share = raw / power
    times = F.when(share <= 1 + 1e-9, 1.0).when(share <= 2 + 1e-9, 2.0).when(share <= 5 + 1e-9, 5.0).otherwise(10.0)
    return F.when(raw > 0, times * power)


def depth_lines(jobs: DataFrame, step: Column | float | None = None, lines: Column | int = 8) -> DataFrame:
    """image_id, depth, y of the lines at multiples of the step between top and bottom (jobs: image_id, top_px, bottom_px, top, bottom).

    Without a step each job has its own: nice_step() of its span for so many intervals at most. Jobs of an empty span, or
    whose bottom is above their top, have no lines.
    """
    own = nice_step(F.col("bottom") - F.col("top"), lines) if step is None else step if isinstance(step, Column) else F.lit(float(step))
    d = jobs.where("bottom > top").withColumn("_step", own)
    d = d.withColumn("_i", F.ceil(F.col("top") / F.col("_step"))).withColumn("_j", F.floor(F.col("bottom") / F.col("_step"))).where("_i <= _j")
    d = d.withColumn("_i", F.explode(F.sequence("_i", "_j"))).withColumn("depth", F.col("_i") * F.col("_step"))
    return d.select("image_id", "depth", (F.col("top_px") + (F.col("depth") - F.col("top")) / (F.col("bottom") - F.col("top")) * (F.col("bottom_px") - F.col("top_px"))).alias("y"))


def vertical_damped(runs: DataFrame, length: int = 40, factor: float = 0.05) -> DataFrame:
    """p times the factor where a column run (length) is over the length."""
    return runs.withColumn("p", F.when(F.col("length") > length, F.col("p") * factor).otherwise(F.col("p")))
