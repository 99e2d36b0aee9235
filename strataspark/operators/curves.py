"""Curve-table analytics over long samples: well, curve, idx, depth, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ALIASES, curve_labels, curve_type, quality_flags, valid_or_null
from .selection import MOST, percentiles


#: Rows of a curve that one task orders, about.
SPAN = 10_000


def features(samples: DataFrame, keys: tuple[str, ...] = ("well", "curve"), span: int = SPAN, most: int = MOST) -> DataFrame:
    """Counts, extremes, mean, population deviation, exact percentiles, share of missing values and of spikes, per curve.

    Spikes are steps between neighbouring valid samples of over five deviations; they need over ten valid samples and a
    deviation of over 1e-6, else the share is 0.
    """
    s = samples.select(*keys, "idx", valid_or_null(F.col("value")).alias("v"), F.floor(F.col("idx") / span).alias("bucket"))
    part = Window.partitionBy(*keys, "bucket").orderBy("idx")
    s = s.withColumn("before", F.last("v", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, -1)))
    # A bucket's first valid value follows the last one of the buckets before it.
    has = F.when(F.col("v").isNotNull(), F.col("idx"))
    ends = s.groupBy(*keys, "bucket").agg(F.max_by("v", has).alias("last"))
    ends = ends.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    on = lambda *ks: F.expr(" and ".join(f"r.{k} <=> e.{k}" for k in ks))
    s = s.alias("r").join(ends.alias("e"), on(*keys, "bucket")).select("r.*", F.abs(F.col("v") - F.coalesce("before", "carried")).alias("step"))
    sds = s.groupBy(*keys).agg(F.stddev_pop("step").alias("sd"))
    s = s.alias("r").join(sds.alias("e"), on(*keys)).select("r.*", "sd")
    p = percentiles(s, keys, "v", (0.05, 0.5, 0.95), most)
    out = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"), F.count("v").alias("num_valid"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.sum(F.when((F.col("sd") > 1e-6) & (F.col("step") > 5 * F.col("sd")), 1).otherwise(0)).alias("spikes"))
    out = out.alias("r").join(p.alias("e"), on(*keys)).select("r.*", "p")
    return out.select(
        *keys, "num_samples", "num_valid", "min", "max", "mean", "std", F.get("p", F.lit(0)).alias("p05"), F.get("p", F.lit(1)).alias("p50"), F.get("p", F.lit(2)).alias("p95"),
        ((1 - F.col("num_valid") / F.greatest(F.lit(1), F.col("num_samples"))) * 100).alias("pct_missing"),
        F.when(F.col("num_valid") > 10, F.col("spikes") / F.col("num_valid") * 100).otherwise(0.0).alias("pct_spikes"))


def well_info(samples: DataFrame) -> DataFrame:
    return samples.groupBy("well").agg(F.min_by("depth", "idx").alias("first_depth"), F.max_by("depth", "idx").alias("last_depth"), F.count(F.lit(1)).alias("num_samples"))


def label_mapping(labels: DataFrame, curves: DataFrame) -> DataFrame:
    """For each label of labels(well, label) the mnemonic of curves(well, pos, mnemonic): the last that is equal in upper case, else the first that holds the label, else null."""
    up = F.upper(F.col("c.mnemonic"))
    hit = labels.alias("l").join(curves.alias("c"), (F.col("l.well") == F.col("c.well")) & up.contains(F.upper("l.label")), "left")
    loose = up != F.upper("l.label")
    rank = F.struct(loose.alias("loose"), F.when(loose, F.col("c.pos")).otherwise(-F.col("c.pos")).alias("pos"))
    return hit.groupBy(F.col("l.well").alias("well"), F.col("l.label").alias("label")).agg(F.min_by(F.col("c.mnemonic"), F.when(F.col("c.mnemonic").isNotNull(), rank)).alias("mnemonic"))


def aliases(curves: DataFrame, targets: tuple[str, ...] = tuple(ALIASES)) -> DataFrame:
    """well, target, mnemonic: the first alias of each target among the well's curves; a target without a list stands for itself. Of equal names the last curve counts."""
    wanted = [t.strip().upper() for t in targets]
    rows = [(t, i, a) for t in wanted for i, a in enumerate(ALIASES.get(t, (t,)))]
    table = curves.sparkSession.createDataFrame(rows, "target string, place int, alias string")
    hit = curves.join(F.broadcast(table), F.upper(F.trim("mnemonic")) == F.col("alias"))
    return hit.groupBy("well", "target").agg(F.min_by("mnemonic", F.struct("place", -F.col("pos"))).alias("mnemonic"))


def around(rows: DataFrame, keys: tuple[str, ...], order: Column, own: Column, names: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """The rows with the last `own` that isn't null at or before each row, and the first at or after it, by `order`.

    Rows have a column `bucket`, which cuts a curve into ranges of the order. A task orders a bucket; what it lacks is
    carried over its borders: each bucket's first and last value are a row of a small table, whose running last and next
    values are joined back by curve and bucket, where the rows already lie.
    """
    a, b = names
    held = rows.withColumn("_o", order).withColumn("_v", own)
    part = Window.partitionBy(*keys, "bucket").orderBy("_o")
    near = held.withColumn(a, F.last("_v", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    # From the end, for a frame up to the end is read anew for every row.
    back = Window.partitionBy(*keys, "bucket").orderBy(F.desc("_o"))
    near = near.withColumn(b, F.last("_v", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    has = F.when(F.col("_v").isNotNull(), F.col("_o"))
    ends = held.groupBy(*keys, "bucket").agg(F.min_by("_v", has).alias("_first"), F.max_by("_v", has).alias("_last"))
    up = Window.partitionBy(*keys).orderBy("bucket")
    ends = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_after", F.last("_first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)))
    same = F.expr(" and ".join(f"r.{k} <=> e.{k}" for k in (*keys, "bucket")))
    out = near.alias("r").join(ends.alias("e"), same)
    new = {a: F.coalesce(F.col(f"r.{a}"), F.col("e._before")), b: F.coalesce(F.col(f"r.{b}"), F.col("e._after"))}
    return out.select(*(F.col(f"r.{c}") for c in rows.columns), *(v.alias(k) for k, v in new.items()))


def resampled(samples: DataFrame, grid: DataFrame, keys: tuple[str, ...], least_valid: int = 10, span: int = SPAN) -> DataFrame:
    """keys, at, value: each curve read linearly at the grid's places (rows of keys and at); ends clamp, curves of fewer valid samples give nulls.

    Samples (keys, at, value) and grid rows are one ordered sequence per curve, cut into ranges of depth of about `span`
    rows; a place's neighbours are the last and first samples round it, in its range or carried into it.
    """
    s = samples.where(F.col("value").isNotNull() & F.col("at").isNotNull()).select(*keys, "at", "value", F.lit(0).alias("asks"))
    both = s.unionByName(grid.select(*keys, "at", F.lit(None).cast("double").alias("value"), F.lit(1).alias("asks")))
    size = both.groupBy(*keys).agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"), F.count(F.lit(1)).alias("_rows"), F.sum(1 - F.col("asks")).alias("_n"))
    both = both.alias("r").join(size.alias("s"), F.expr(" and ".join(f"r.{k} <=> s.{k}" for k in keys))).select("r.*", "_lo", "_hi", "_rows", "_n")
    cuts = F.ceil(F.col("_rows") / span)
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("at") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cuts)).otherwise(0)
    both = both.withColumn("bucket", bucket.cast("long")).drop("_lo", "_hi", "_rows")
    x = around(both, keys, F.struct("at", "asks"), F.when(F.col("asks") == 0, F.struct("at", "value")), ("a", "b")).where("asks = 1")
    mid = F.col("a.value") + (F.col("at") - F.col("a.at")) / (F.col("b.at") - F.col("a.at")) * (F.col("b.value") - F.col("a.value"))
    v = F.when(F.col("_n") < least_valid, None).when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a.at") == F.col("at")), F.col("a.value")).otherwise(mid)
    return x.select(*keys, "at", v.alias("value"))


def regular_depth(samples: DataFrame, keys: tuple[str, ...], step: float = 0.5, least_valid: int = 1) -> DataFrame:
    """Curves resampled to a regular depth step from their first to their last depth."""
    s = samples.select(*keys, F.col("depth").alias("at"), valid_or_null(F.col("value")).alias("value"))
    grid = s.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).select(*keys, F.explode(F.expr(f"transform(sequence(0L, cast(floor((hi - lo) / {step}) as bigint)), i -> lo + i * {step}D)")).alias("at"))
    return resampled(s, grid, keys, least_valid).withColumnRenamed("at", "depth")


def interpolated(trace: DataFrame, keys: tuple[str, ...], limit: int, order: str = "row_idx", value: str = "x", span: int = SPAN) -> DataFrame:
    """Fills nulls linearly where a value stands within `limit` rows on either side; ends carry the nearest value; the middle of long gaps stays null.

    A trace is cut into ranges of `span` rows; the values round a range are carried into it.
    """
    i = F.col(order)
    at = F.when(F.col(value).isNotNull(), F.struct(i.alias("i"), F.col(value).alias("v")))
    t = around(trace.withColumn("bucket", F.floor(i / span)), keys, i, at).drop("bucket")
    near = F.least(i - F.col("_a.i"), F.col("_b.i") - i) <= limit
    mid = F.col("_a.v") + (i - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i")) * (F.col("_b.v") - F.col("_a.v"))
    v = F.when(F.col(value).isNotNull(), F.col(value)).when(~near, None).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(mid)
    return t.withColumn(value, v).drop("_a", "_b")


def rolling_median(trace: DataFrame, keys: tuple[str, ...], window: int, order: str = "row_idx", value: str = "x") -> DataFrame:
    """Centred, nulls ignored; an even window is widened by one."""
    k = (window + (window + 1) % 2) // 2
    return trace.withColumn(value, F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k)))


def user_curves(configs: DataFrame) -> DataFrame:
    """well, user_curves, user_curve_type_by_mnemonic from configs (well, curves: array of type, las_mnemonic, name, las_unit, unit, display_name, display_unit)."""
    name = lambda c: F.upper(F.coalesce(F.when(c["las_mnemonic"] != "", c["las_mnemonic"]), c["name"], F.lit("")))
    unit = lambda c: F.coalesce(F.when(c["las_unit"] != "", c["las_unit"]), c["unit"], F.lit(""))
    entry = lambda c, i: F.struct(
        (i + 1).alias("index"), c["type"].alias("selected_type"), name(c).alias("las_mnemonic"), unit(c).alias("las_unit"), c["display_name"].alias("display_name"), c["display_unit"].alias("display_unit"))
    held = configs.select("well", F.transform("curves", entry).alias("user_curves"))
    # A later curve of the same mnemonic takes its place.
    named = F.filter("user_curves", lambda e: e["las_mnemonic"] != "")
    last = F.filter(named, lambda e: ~F.exists(named, lambda o: (o["las_mnemonic"] == e["las_mnemonic"]) & (o["index"] > e["index"])))
    types = F.map_from_entries(F.transform(last, lambda e: F.struct(e["las_mnemonic"], e["selected_type"])))
    return held.select("well", "user_curves", types.alias("user_curve_type_by_mnemonic"))


def payload(features_: DataFrame, wells: DataFrame, texts: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """well, payload: recognised text, its labels, their mnemonics, well info, curve features with flags, and the user's curves, as one JSON text.

    features_ has a row a curve (well, curve, pos, unit, description and features()), wells the depths of well_info(),
    texts the recognised text (well, text), configs the user's curves. A well's payload is one value.
    """
    f = features_.withColumn("mnemonic", F.col("curve")).withColumn("rule_type_guess", curve_type(F.col("curve"), F.col("unit"), F.col("description")))
    f = f.withColumn("flags", quality_flags(F.col("pct_missing"), F.col("pct_spikes")))
    cols = [c for c in f.columns if c not in ("well", "pos")]
    per = f.groupBy("well").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*cols).alias("f")))).alias("c"))
    found = texts.select("well", "text", curve_labels(F.coalesce("text", F.lit(""))).alias("labels"))
    asked = found.select("well", F.explode("labels").alias("label"))
    pairs = label_mapping(asked, f.select("well", "pos", F.col("curve").alias("mnemonic")))
    maps = pairs.groupBy("well").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "mnemonic")))).alias("mapping"))
    info = wells.select("well", F.struct(F.col("first_depth").alias("start_depth"), F.col("last_depth").alias("end_depth"), "num_samples").alias("well_info"))
    held = found.join(per, "well").join(info, "well").join(maps, "well", "left")
    out = [
        F.coalesce("text", F.lit("")).alias("ocr_text"),
        F.col("labels").alias("vision_curve_labels"),
        F.coalesce("mapping", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))).alias("vision_to_las_mapping"),
        F.struct("well_info", F.transform("c", lambda x: x["f"]).alias("curve_features")).alias("las_summary"),
    ]
    if configs is not None:
        held = held.join(user_curves(configs), "well", "left")
        out += [F.col("user_curves"), F.col("user_curve_type_by_mnemonic")]
    return held.select("well", F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("payload"))
