"""Row picks, traces and path operators: image_id, row_idx, x, conf; probability tables are dense: image_id, y, x, p.

A path is one ordered pass over all rows of its image; paths.py runs it in blocks of rows. What differs by image (curve type, scale, hot side, steps and weights) comes as a settings table, one row an image.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import PHYSICAL, depth_at, scaled_value
from . import paths
from . import pixels as P
from .curves import interpolated, rolling_median

#: A settings row: what a tracer may know of its image.
SETTINGS = {"curve_type": "GR", "scale_min": 0.0, "scale_max": 150.0, "hot_side": None, "step": 3, "smooth": 0.5, "bend": 0.0}
# Fixed values of the cost table: least score, rail weight, grid rows' probability, and the scales by kind of image.
LEAST_SCORE, RAIL_COST, GRID_P = 1e-6, 15.0, 1e-3
JAGGED, BALANCED, SMOOTH = (1.0, 0.8, 0.6, 0.4, 0.2), (1.0, 0.75, 0.5, 0.33, 0.25), (1.0, 0.67, 0.33, 0.17)


def settings(images: DataFrame, **known) -> DataFrame:
    """A settings row for each image_id, with the defaults where nothing is given."""
    held = {**SETTINGS, **known}
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    kinds = {"hot_side": "string", "step": "int", "smooth": "double", "bend": "double"}
    return images.select("image_id", *(col(v).cast(kinds[k]).alias(k) if k in kinds else col(v).alias(k) for k, v in held.items()))


def row_picks(mask: DataFrame, rows: DataFrame, min_run: int = 2) -> DataFrame:
    """image_id, row_idx, x: the median on-pixel of each row of rows(image_id, row_idx), null under min_run pixels."""
    got = mask.where("on").groupBy("image_id", F.col("y").alias("row_idx")).agg(F.count(F.lit(1)).alias("n"), F.percentile("x", F.lit(0.5)).alias("x")).where(F.col("n") >= min_run)
    return rows.join(got.drop("n"), ["image_id", "row_idx"], "left")


def middles(rows: DataFrame, min_run: int = 2) -> DataFrame:
    """The same from a mask's raster rows (image_id, y, on array)."""
    at = F.filter(F.transform("on", lambda o, x: F.when(o, x)), lambda x: x.isNotNull())
    held = rows.select("image_id", F.col("y").alias("row_idx"), at.alias("at"))
    n = F.size("at")
    middle = (F.get("at", F.floor((n - 1) / 2).cast("int")) + F.get("at", F.floor(n / 2).cast("int"))) / 2
    return held.select("image_id", "row_idx", F.when(n >= min_run, middle).alias("x"))


def smoothed(trace: DataFrame, keys: tuple[str, ...] = ("image_id",), window: int = 5, limit: int = 50) -> DataFrame:
    return interpolated(rolling_median(trace, keys, window), keys, limit)


def digitized(trace: DataFrame, width: Column | int, left, right, top, bottom, null: float = -999.25) -> DataFrame:
    """image_id, row_idx, depth, value: the trace scaled to its curve's values and the rows to depths. Bounds are numbers or columns."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    n = F.count(F.lit(1)).over(Window.partitionBy("image_id"))
    value = F.coalesce(scaled_value(F.col("x"), col(width), col(left), col(right)), F.lit(null))
    return trace.select("image_id", "row_idx", depth_at(F.col("row_idx"), n, col(top), col(bottom)).alias("depth"), value.alias("value"))


def overlay(trace: DataFrame, left_px: int = 0, top_px: int = 0) -> DataFrame:
    p = trace.where("x is not null").select("image_id", F.struct((F.col("row_idx") + top_px).alias("y"), (F.col("x") + left_px).alias("x")).alias("p"))
    return p.groupBy("image_id").agg(F.array_sort(F.collect_list("p")).alias("points"))


def span_centroid(prob: DataFrame) -> DataFrame:
    """Rows whose maximum reaches 1e-4: weighted centroid between the first and last place of support, confidence their maximum."""
    row = Window.partitionBy("image_id", "y")
    p = prob.withColumn("m", F.max("p").over(row)).where("m >= 1e-4")
    yes = F.when(F.col("p") >= F.greatest(F.lit(0.12), 0.55 * F.col("m")), F.col("x"))
    p = p.withColumn("a", F.min(yes).over(row)).withColumn("b", F.max(yes).over(row)).where("x between a and b")
    return p.groupBy("image_id", F.col("y").alias("row_idx")).agg((F.sum(F.col("x") * F.col("p")) / F.sum("p")).alias("x"), F.first("m").alias("conf"))


def max_centroid(prob: DataFrame) -> DataFrame:
    """Weighted centroid of the run round each row's maximum in which p reaches max(0.6 of it, 0.01)."""
    row = Window.partitionBy("image_id", "y")
    p = prob.withColumn("m", F.max("p").over(row)).withColumn("at", F.min_by("x", F.struct(-F.col("p"), F.col("x"))).over(row))
    p = p.where("p >= greatest(0.6 * m, 0.01)").withColumn("g", F.col("x") - F.row_number().over(row.orderBy("x")))
    p = p.withColumn("has", F.max(F.col("x") == F.col("at")).over(Window.partitionBy("image_id", "y", "g"))).where("has")
    return p.groupBy("image_id", F.col("y").alias("row_idx")).agg((F.sum(F.col("x") * F.col("p")) / F.sum("p")).alias("x"), F.first("m").alias("conf"))


def peaks(prob: DataFrame, least: float = 0.012) -> DataFrame:
    """image_id, y, x, p: local maxima of each row, plateaus by their middle, edges left out."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    start = F.when((F.lag("p").over(row) != F.col("p")) | F.lag("p").over(row).isNull(), 1).otherwise(0)
    s = prob.withColumn("st", start).withColumn("g", F.sum("st").over(row)).groupBy("image_id", "y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.first("p").alias("p"))
    g = Window.partitionBy("image_id", "y").orderBy("g")
    s = s.withColumn("before", F.lag("p").over(g)).withColumn("after", F.lead("p").over(g))
    return s.where(f"p > before and p > after and p >= {least}").select("image_id", "y", F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("x"), "p")


def subpixel(prob: DataFrame, at: DataFrame) -> DataFrame:
    """image_id, y, x: peaks moved by the parabola through them and their neighbours."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    p = prob.withColumn("a", F.lag("p").over(row)).withColumn("c", F.lead("p").over(row))
    d = F.col("a") - 2 * F.col("p") + F.col("c")
    return p.join(at.select("image_id", "y", "x"), ["image_id", "y", "x"]).select("image_id", "y", (F.col("x") + F.coalesce(F.when(F.abs(d) > 1e-12, 0.5 * (F.col("a") - F.col("c")) / d), F.lit(0.0))).alias("x"))


def stretched(trace: DataFrame, heights: DataFrame) -> DataFrame:
    """A trace of n rows read linearly at each row of heights(image_id, height): image_id, row_idx, x."""
    n = trace.groupBy("image_id").agg((F.max("row_idx") + 1).alias("n"))
    rows = heights.join(n, "image_id").select("image_id", "n", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row_idx"))
    rows = rows.withColumn("at", F.col("row_idx") * (F.col("n") - 1) / F.greatest(F.lit(1), F.col("height") - 1))
    rows = rows.withColumn("a", F.floor("at").cast("int")).withColumn("b", F.least(F.col("n") - 1, F.floor("at").cast("int") + 1))
    side = lambda i, v: trace.select("image_id", F.col("row_idx").alias(i), F.col("x").alias(v))
    both = rows.join(side("a", "xa"), ["image_id", "a"], "left").join(side("b", "xb"), ["image_id", "b"], "left")
    return both.select("image_id", "row_idx", (F.col("xa") + (F.col("at") - F.col("a")) * (F.col("xb") - F.col("xa"))).alias("x"))


def to_probability(trace: DataFrame, width: int, sigma: float = 2.0, heights: DataFrame | None = None) -> DataFrame:
    """image_id, y, x, p: a Gaussian round each row's place, after the trace is stretched to its image's height if that is given."""
    s = min(6.0, max(1.25, sigma))
    t = trace if heights is None else stretched(trace, heights)
    held = t.where("x is not null").select("image_id", F.col("row_idx").alias("y"), F.col("x").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return held.select("image_id", "y", "x", F.exp(-(F.col("x") - F.col("c")) * (F.col("x") - F.col("c")) / (2 * s * s)).alias("p"))


def gated_fusion(direct: DataFrame, followed: DataFrame, gain: float = 1.1, near: float = 50.0) -> DataFrame:
    """The followed trace, but the direct one where it is stronger by the gain and near; distances count to the ninth digit, so that the order of sums doesn't decide."""
    j = followed.alias("f").join(direct.alias("d"), ["image_id", "row_idx"], "full")
    better = (F.col("d.conf") > gain * F.col("f.conf")) & (F.round(F.abs(F.col("d.x") - F.col("f.x")), 9) < near)
    take = F.col("d.x").isNotNull() & (F.col("f.x").isNull() | better)
    return j.select("image_id", "row_idx", *(F.when(take, F.col(f"d.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("x", "conf")))


def fused(trace: DataFrame, other: DataFrame, prob: DataFrame) -> DataFrame:
    """The trace's rows, but the other's place where the probability at its rounded column is greater; conf stays the trace's.

    Only the places asked for meet the probability table, in one join.
    """
    size = P.sizes_of(prob).select("image_id", "width")
    both = trace.select("image_id", "row_idx", "x", "conf").join(other.select("image_id", "row_idx", F.col("x").alias("ox")), ["image_id", "row_idx"], "left")
    spot = lambda c: F.bround(F.least(F.col("width") - 1.0, F.greatest(F.lit(0.0), F.col(c)))).cast("int")
    # Stored, for its places and its rows are read apart: a row of the trace, not a pixel.
    both = P.cut(both.join(size, "image_id").withColumn("at", F.array(spot("x"), spot("ox"))).drop("width"))
    asked = both.select("image_id", F.col("row_idx").alias("y"), F.posexplode("at").alias("side", "x")).where("x is not null")
    found = prob.select("image_id", "y", "x", "p").join(P.apart(asked), ["image_id", "y", "x"])
    found = found.groupBy("image_id", F.col("y").alias("row_idx")).agg(F.max(F.when(F.col("side") == 0, F.col("p"))).alias("pa"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("pb"))
    held = both.join(P.apart(found), ["image_id", "row_idx"], "left")
    return held.select("image_id", "row_idx", F.when(F.col("pb") > F.coalesce("pa", F.lit(-1.0)), F.col("ox")).otherwise(F.col("x")).alias("x"), "conf")


# --- the cost table of the path tracers ------------------------------------------------------------------------------


def live_scores(prob: DataFrame) -> DataFrame:
    """image_id, y, x, on (p over 0.10), p: the score that probability, centre of the stroke and ridge give, 1e-6 to 1."""
    d = P.cut(prob.select("image_id", "y", "x", "p", (F.col("p") > 0.10).alias("on")))
    centre = P.centre_score(d).select("image_id", "y", "x", "d", F.col("p").alias("centre"), "mid")
    held = d.join(P.apart(centre), ["image_id", "y", "x"], "left").fillna(0.0, ["d", "centre"]).fillna(False, ["mid"])
    held = P.ridge_score(held)
    some = d.groupBy("image_id").agg(F.bool_or("on").alias("some"))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(LEAST_SCORE), c))
    live = clip(F.greatest(F.pow("p", F.lit(0.7)) * (0.15 + 0.85 * F.col("centre")), 0.55 * F.col("ridge") + 0.05 * F.col("on").cast("double")))
    held = held.withColumn("live", live).join(some, "image_id")
    held = held.withColumn("live", F.when(F.col("some"), clip(F.col("live") * (0.7 + 0.3 * F.col("d")))).otherwise(F.col("live")))
    return held.select("image_id", "y", "x", "on", F.col("live").alias("p"))


def rail_columns(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, x of columns that, like both neighbours, are on in over 60 % of rows; edge columns never."""
    share = scores.where("on").groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("n")).join(sizes, "image_id")
    share = share.where("height >= 4 and width >= 2 and n / height > 0.6")
    w = Window.partitionBy("image_id").orderBy("x").rangeBetween(-1, 1)
    return share.withColumn("k", F.count(F.lit(1)).over(w)).where("k = 3").select("image_id", "x")


def grid_rows(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, y of rows of which over 30 % outlives an opening by max(5, w/4)."""
    r = P.runs(scores.where("on").select("image_id", "y", "x", "on").join(sizes, "image_id"), "x")
    r = r.where(P._survives(F.greatest(F.lit(5), F.floor(F.col("width") / 4)), F.col("width")))
    n = r.groupBy("image_id", "y", "width", "height").agg(F.count(F.lit(1)).alias("n"))
    return n.where("height >= 4 and width >= 8 and n / width > 0.30").select("image_id", "y")


def implausible(kind: Column, value: Column, low: Column, high: Column) -> Column:
    """1 for values outside the type's physical range where the scale (low to high) meets that range, else 0."""
    out = F.lit(0.0)
    for name, (a, b) in PHYSICAL.items():
        outside = (F.upper(kind) == name) & (low <= b) & (high >= a) & ((value < a) | (value > b))
        out = F.when(outside, 1.0).otherwise(out)
    return out


def trace_costs(prob: DataFrame, setting: DataFrame) -> DataFrame:
    """image_id, y, x, p (the live score), cost, step, smooth, bend: -log of the score, with rails, the side off the hot one, implausible values and grid rows made dear."""
    # Stored, as what follows reads the scores four times.
    live = P.cut(live_scores(prob))
    sizes = P.sizes_of(live)
    # Stored, for a row an image: as a join Spark would take it for the larger side, and send all scores through the driver.
    held = live.join(P.cut(setting.join(sizes, "image_id")), "image_id")
    held = held.join(rail_columns(live, sizes).withColumn("rail", F.lit(RAIL_COST)), ["image_id", "x"], "left")
    held = held.join(grid_rows(live, sizes).withColumn("grid", F.lit(True)), ["image_id", "y"], "left")
    ramp = F.col("x") / F.greatest(F.lit(1), F.col("width") - 1)
    side = F.when(F.col("width") < 2, 0.0).when(F.col("hot_side") == "left", ramp).when(F.col("hot_side") == "right", 1 - ramp).otherwise(0.0)
    lo, hi = F.least("scale_min", "scale_max"), F.greatest("scale_min", "scale_max")
    value = scaled_value(F.col("x"), F.col("width"), F.col("scale_min"), F.col("scale_max"))
    cost = -F.log("p") + F.coalesce("rail", F.lit(0.0)) + side + implausible(F.col("curve_type"), value, lo, hi)
    flat = F.col("grid").isNotNull()
    return held.select("image_id", "y", "x", F.when(flat, GRID_P).otherwise(F.col("p")).alias("p"), F.when(flat, -F.log(F.lit(GRID_P))).otherwise(cost).alias("cost"), "step", "smooth", "bend")


# --- path jobs -------------------------------------------------------------------------------------------------------


def _rated(path: DataFrame, rows: DataFrame, whole: bool) -> DataFrame:
    """image_id, row_idx, x, conf of a path of whole columns over packed rows.

    conf is p at the place; for a path that may end early (not whole) it is less the second highest p within the step,
    and rows under 0.01 have no place.
    """
    held = path.join(P.apart(rows.select("image_id", F.col("y").alias("row_idx"), "p", *(() if whole else ("step",)))), ["image_id", "row_idx"])
    own = F.get("p", F.col("x"))
    if whole:
        return held.select("image_id", "row_idx", F.col("x").cast("double").alias("x"), own.alias("conf"))
    low = F.greatest(F.lit(0), F.col("x") - F.col("step"))
    near = F.sort_array(F.slice("p", low + 1, F.col("x") + F.col("step") + 1 - low), asc=False)
    second = F.greatest(F.lit(0.0), F.coalesce(F.get(near, F.lit(1)), F.lit(0.0)))
    return held.select("image_id", "row_idx", F.when(own >= 0.01, F.col("x")).cast("double").alias("x"), (own - second).alias("conf"))


def seam(prob: DataFrame, block: int = paths.BLOCK) -> DataFrame:
    """The path of least 1 - p with steps of at most one column; ties keep the column, then go left."""
    rows = P.stored(paths.packed(prob.select("image_id", "y", "x", "p"), block, cost=1 - F.col("p"), p=F.col("p")), "rows", "block")
    return _rated(paths.least_path(rows, True, block), rows, True)


def viterbi(costs: DataFrame, block: int = paths.BLOCK) -> DataFrame:
    """The path of least cost + smooth dx^2 + bend (second difference)^2 of each image of a cost table, downwards."""
    rows = P.stored(paths.packed(costs, block, cost=F.col("cost"), p=F.col("p")), "rows", "block")
    return _rated(paths.least_path(rows, False, block), rows, False)


def dp_tracer(prob: DataFrame, setting: DataFrame, block: int = paths.BLOCK) -> DataFrame:
    """The paths of the cost table down and up: their mean, or the likelier one where they are over 5 columns apart; the one that has a place. Images of one row or column have none."""
    costs = P.cut(trace_costs(prob, setting))
    sizes = P.cut(P.sizes_of(costs))
    some = costs.join(sizes.where("width >= 2 and height >= 2"), "image_id")
    flip = F.col("height") - 1
    down = viterbi(some, block).select("image_id", "row_idx", F.col("x").alias("a"), F.col("conf").alias("ca"))
    up = viterbi(some.withColumn("y", flip - F.col("y")), block).join(sizes, "image_id").select("image_id", (flip - F.col("row_idx")).alias("row_idx"), F.col("x").alias("b"), F.col("conf").alias("cb"))
    both = down.join(P.apart(up), ["image_id", "row_idx"])
    spots = both.select("image_id", F.col("row_idx").alias("y"), F.posexplode(F.array(*(F.coalesce(c, F.lit(0.0)).cast("int") for c in "ab"))).alias("side", "x"))
    found = costs.select("image_id", "y", "x", "p").join(P.apart(spots), ["image_id", "y", "x"]).groupBy("image_id", F.col("y").alias("row_idx"))
    found = found.agg(F.max(F.when(F.col("side") == 0, F.col("p"))).alias("pa"), F.max(F.when(F.col("side") == 1, F.col("p"))).alias("pb"))
    a, b = F.col("a"), F.col("b")
    apart = F.when(F.col("pa") > F.col("pb"), a).otherwise(b)
    x = F.when(a.isNotNull() & b.isNotNull(), F.when(F.abs(a - b) > 5, apart).otherwise((a + b) / 2)).otherwise(F.coalesce(a, b))
    conf = F.when(a.isNotNull() & b.isNotNull(), (F.col("ca") + F.col("cb")) / 2).when(a.isNotNull(), F.col("ca")).when(b.isNotNull(), F.col("cb")).otherwise(0.0)
    done = both.join(P.apart(found), ["image_id", "row_idx"]).select("image_id", "row_idx", x.alias("x"), conf.alias("conf"))
    thin = costs.join(sizes.where("width < 2 or height < 2"), "image_id").select("image_id", F.col("y").alias("row_idx")).distinct()
    return done.union(thin.select("image_id", "row_idx", F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("conf")))


def _run_round(row: np.ndarray, i: int, least: float) -> tuple[int, int]:
    """The run round place i whose values reach the least: first place, and one past the last."""
    low = np.flatnonzero(row < least)
    k = np.searchsorted(low, i)
    return (low[k - 1] + 1 if k else 0), (low[k] if k < len(low) else len(row))


def _next_place(ridge: np.ndarray, raw: np.ndarray, before: float, crest: bool, reach: int) -> tuple[float, float]:
    """Place and strength of the best peak of a row within the reach of the place before: its strength less what its distance costs; without a peak, the strongest place."""
    first = max(0, round(before) - reach)
    row = ridge[first : round(before) + reach + 1]
    least = 0.005 if crest else 0.012
    if not len(row) or row.max() < least:
        return np.nan, 0.0
    start = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    v = row[start]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= least)) + 1
    if len(top):
        at = (start[top] + start[top + 1] - 1) // 2
        off, strength = np.abs(first + at - before) / reach, row[at]
        dear = 0.15 * off**2 * (1 - 0.5 * strength) if crest else 0.020 * off * (1 - strength)
        i = int(at[(strength - dear).argmax()])
    else:
        i = int(row.argmax())
    peak, held = row[i], row
    if crest and raw[first + i] > 0.001:
        held = raw[first : first + len(row)]
        peak = held[i]
    a, b = _run_round(held, i, max(0.70 * peak, 0.0025) if crest else max(0.40 * peak, 0.003))
    weight = held[a:b]
    if not weight.sum() > 1e-6:
        return float(first + i), float(peak)
    return float((np.arange(first + a, first + b) * weight).sum() / weight.sum()), float(peak)


def followed(prob: DataFrame, crest: bool = False, reach: int = 80, block: int = paths.BLOCK) -> DataFrame:
    """Follows peaks down and up from the strongest place of the row of most ink; rows without a peak in reach have no place.

    Crest mode follows the column `ridge` of the table, reaches further where a row is strong, and looks three times as
    far where nothing was found.
    """

    def next_place(ridge: np.ndarray, p: np.ndarray, before: float) -> tuple[float, float]:
        far = reach + int(6 * ridge.max()) if crest else reach
        x, conf = _next_place(ridge, p, before, crest, far)
        return _next_place(ridge, p, before, crest, 3 * far) if crest and np.isnan(x) else (x, conf)

    rows = paths.packed(prob, block, p=F.col("p"), ridge=F.col("ridge" if crest else "p"))
    return paths.followed_path(P.stored(rows, "rows", "block"), block, next_place)


# --- tracers ---------------------------------------------------------------------------------------------------------


def dot_print_prob(mask: DataFrame, hues: DataFrame | None = None, crest: bool = False) -> DataFrame:
    """image_id, y, x, p, and in crest mode ridge, from a mask's grey values: ink of the curve's hue, dots joined by a closing, blurred unless in crest mode, times 1.25."""
    p = mask.select("image_id", "y", "x", (F.col("value") / 255.0).alias("p"))
    if hues is not None:
        p = p.join(P.hue_weight(hues), ["image_id", "y", "x"]).select("image_id", "y", "x", (F.col("p") * F.col("weight")).alias("p"))
    p = P.closed(p.withColumn("own", F.col("p")), "p", *((3, 11) if crest else (4, 6)))
    p = p.select("image_id", "y", "x", F.greatest("own", "p").alias("p"))
    if not crest:
        p = P.blur(p, "p", whole=False)
    p = p.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") * 1.25)))
    if not crest:
        return p
    r = P.box_mean_down(p.withColumn("ridge", F.col("p")), "ridge", 15).withColumn("ridge", F.greatest("p", "ridge"))
    r = P.gradient(r, "p", replicate=False).withColumn("steep", F.abs("gy"))
    top = r.groupBy("image_id").agg(F.max("steep").alias("top"))
    steep = F.when(F.col("top") > 1e-6, F.col("steep") / (F.col("top") + 1e-6)).otherwise(0.0)
    r = r.join(top, "image_id").withColumn("ridge", F.col("ridge") * (1.0 + 0.6 * steep))
    return r.select("image_id", "y", "x", "p", F.max("ridge").over(P.along_col().rowsBetween(-1, 1)).alias("ridge"))


def dot_print_tracer(mask: DataFrame, hues: DataFrame | None = None, crest: bool = False, limit: int = 25) -> DataFrame:
    """Peak following with gaps of up to 25 rows filled, the row's own maximum where stronger, then (not in crest mode) the seam where stronger."""
    # Stored, as the followed trace, the rows' own maxima, the seam and both fusions read it.
    p = P.cut(dot_print_prob(mask, hues, crest))
    trace = interpolated(followed(p, crest), ("image_id",), limit)
    trace = fused(trace, max_centroid(p), p.withColumn("p", F.col("ridge")) if crest else p)
    return trace if crest else fused(trace, seam(p), p)


def ridge_tracer(mask: DataFrame) -> DataFrame:
    """The cheapest seam along the ridge of the largest component of what is left of a mask without rails; conf 1. Images without any have no places and conf 0.

    The component is the stroke's, for the middles of its rows may lie apart where it is steep.
    """
    mask = P.cut(mask.select("image_id", "y", "x", "value"))
    left = P.without_rails(mask, P.sizes_of(mask))
    stroke = P.largest_component(left).withColumn("on", F.lit(True))
    kept = P.cut(P.centre_score(stroke).where("mid").select("image_id", "y", "x").withColumn("p", F.lit(1.0)))
    some = kept.select("image_id").distinct().withColumn("some", F.lit(True))
    prob = mask.select("image_id", "y", "x").join(P.apart(kept), ["image_id", "y", "x"], "left").fillna(0.0, ["p"])
    got = seam(prob).join(some, "image_id", "left")
    return got.select("image_id", "row_idx", F.when(F.col("some"), F.col("x")).alias("x"), F.coalesce(F.col("some").cast("double"), F.lit(0.0)).alias("conf"))


def scale_sets(mask: DataFrame, setting: DataFrame) -> DataFrame:
    """image_id, width, height, jagged (0.5 to 2), scales: for GR by the density of edges and the variance of the mask, else fixed; images under 4 rows or columns have one."""
    size = P.sizes_of(mask)
    edge = P.edges(mask.select("image_id", "y", "x", F.col("value").cast("double").alias("value")), 30.0, 100.0).groupBy("image_id").agg(F.count(F.lit(1)).alias("edge"))
    spread = mask.groupBy("image_id").agg(F.var_pop(F.col("value") / 255.0).alias("spread"))
    held = setting.select("image_id", "curve_type").join(size, "image_id").join(spread, "image_id").join(edge, "image_id", "left")
    density = F.coalesce("edge", F.lit(0)) / (F.col("width") * F.col("height"))
    fixed = lambda scales: F.array(*map(F.lit, scales))
    gr = F.when((density > 0.15) | (F.col("spread") > 0.1), fixed(JAGGED)).when((density > 0.08) | (F.col("spread") > 0.05), fixed(BALANCED)).otherwise(fixed(SMOOTH))
    scales = F.when((F.col("width") < 4) | (F.col("height") < 4), fixed((1.0,))).when(F.upper("curve_type") == "GR", gr).otherwise(fixed(SMOOTH))
    return held.select("image_id", "width", "height", F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1.0 + 5 * density)).alias("jagged"), scales.alias("scales"))


def multiscale_tracer(mask: DataFrame, setting: DataFrame) -> DataFrame:
    """Traces of the mask (grey values) at several scales of both axes, read back at every row and averaged by confidence; conf is their highest.

    A scale over 0.5 is read linearly, a smaller one by area. Each scale has its own step and weights.
    """
    mask = P.cut(mask.select("image_id", "y", "x", "value"))
    sets = P.cut(scale_sets(mask, setting)).select("*", F.explode("scales").alias("scale")).drop("scales")
    key = F.format_string("%s|%s", F.col("scale").cast("string"), F.col("image_id"))
    side = lambda c: F.greatest(F.lit(4), F.floor(F.col(c) * F.col("scale"))).cast("int")
    sets = sets.select("image_id", "width", "height", "jagged", "scale", key.alias("key"), side("width").alias("out_w"), side("height").alias("out_h"))
    held = mask.select("image_id", "y", "x", F.col("value").cast("double").alias("value")).join(sets, "image_id")
    held = held.withColumn("image_id", F.col("key"))
    args = F.col("width"), F.col("height"), F.col("out_w"), F.col("out_h")
    scaled = held.where("scale = 1").select("image_id", "y", "x", "value")
    scaled = scaled.union(P.bilinear_resampled(held.where("scale < 1 and scale > 0.5"), *args).select("image_id", "y", "x", "value"))
    scaled = scaled.union(P.area_resampled(held.where("scale <= 0.5"), *args).select("image_id", "y", "x", "value"))
    prob = scaled.select("image_id", "y", "x", (F.round("value") / 255.0).alias("p"))

    gr = F.upper("curve_type") == "GR"
    smooth = F.when(gr & (F.col("smooth") > 0.01), 0.001).otherwise(F.col("smooth"))
    least = lambda c: F.when(gr, F.greatest(F.lit(1e-6), c * F.col("jagged"))).otherwise(c)
    own = setting.join(sets, "image_id").withColumn("image_id", F.col("key"))
    own = own.withColumn("smooth", least(smooth * F.col("scale"))).withColumn("bend", least(F.col("bend") * F.col("scale")))
    own = own.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("step") * F.col("scale") * F.when(gr, 1.2).otherwise(1.0))).cast("int"))
    got = dp_tracer(prob, own.select("image_id", *SETTINGS)).select(F.col("image_id").alias("key"), "row_idx", "x", "conf")

    rows = sets.select("image_id", "key", "scale", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    rows = rows.withColumn("at", F.col("row") * F.col("scale")).withColumn("a", F.floor("at").cast("int")).withColumn("b", F.floor("at").cast("int") + 1)
    part = lambda i, n: got.select("key", F.col("row_idx").alias(i), F.col("x").alias(f"x{n}"), F.col("conf").alias(f"c{n}"))
    j = rows.join(part("a", 0), ["key", "a"]).where("x0 is not null").join(part("b", 1), ["key", "b"], "left")
    f = F.when(F.col("x1").isNotNull(), F.col("at") - F.col("a")).otherwise(0.0)
    lerp = lambda u, v: u * (1 - f) + F.coalesce(v, F.lit(0.0)) * f
    j = j.select("image_id", "row", "scale", (lerp(F.col("x0"), F.col("x1")) / F.col("scale")).alias("x"), lerp(F.col("c0"), F.col("c1")).alias("c"))
    total = F.sum("c")
    mean = F.when(total > 0, F.sum(F.col("x") * F.col("c")) / total).otherwise(F.max_by("x", "scale"))
    done = j.groupBy("image_id", F.col("row").alias("row_idx")).agg(mean.alias("x"), F.when(total > 0, F.max("c")).otherwise(0.0).alias("conf"))
    every = sets.select("image_id", "height").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row_idx"))
    return every.join(done, ["image_id", "row_idx"], "left").select("image_id", "row_idx", "x", F.coalesce("conf", F.lit(0.0)).alias("conf"))


# --- the digitize job ------------------------------------------------------------------------------------------------


def digitize(pixels: DataFrame, jobs: DataFrame, blur: int = 3, min_run: int = 2, window: int = 5, null: float = -999.25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From pixels (image_id, y, x, b, g, r) and one job row a curve to curve values, traces and LAS text.

    Jobs: image_id, pos, name, unit, mode, left_px, right_px, top_px, bottom_px, left_value, right_value, top_depth,
    bottom_depth, depth_unit, metadata (map). Gives values (file, idx, depth, mnemonic, value, null marker in place),
    points of the traces (image_id, name, points) and texts (file, text, name).
    """
    from ..functions.columns import first_metadata, las_file_name, mode_test
    from ..sources.las import las_text

    key = F.format_string("%s|%s", F.col("image_id"), F.col("pos").cast("string"))
    size = P.sizes_of(pixels)
    held = jobs.join(size, "image_id").withColumn("key", key)
    held = held.withColumn("top_px", F.greatest(F.lit(0), "top_px")).withColumn("bottom_px", F.least("bottom_px", "height")).withColumn("right_px", F.least("right_px", "width"))
    held = P.cut(held.drop("width", "height"))
    roi = P.crop(pixels, held.select("image_id", "key", "mode", "left_px", "right_px", "top_px", "bottom_px", (F.col("right_px") - F.greatest(F.lit(0), "left_px")).alias("width"), (F.col("bottom_px") - F.col("top_px")).alias("height")))
    roi = roi.select(F.col("key").alias("image_id"), "mode", "width", "height", "y", "x", *(F.col(c).cast("double").alias(c) for c in "bgr"))
    mask = P.curve_rows(roi, mode_test, blur)
    trace = P.cut(smoothed(middles(mask, min_run), window=window))

    named = trace.withColumnRenamed("image_id", "key").join(held, "key")
    n = F.col("bottom_px") - F.col("top_px")
    value = F.coalesce(scaled_value(F.col("x"), F.col("right_px") - F.greatest(F.lit(0), "left_px"), F.col("left_value"), F.col("right_value")), F.lit(null))
    values = named.select(F.col("image_id").alias("file"), F.col("row_idx").alias("idx"), depth_at(F.col("row_idx"), n, F.col("top_depth"), F.col("bottom_depth")).alias("depth"), F.col("name").alias("mnemonic"), value.alias("value"))
    point = F.struct((F.col("row_idx") + F.col("top_px")).alias("y"), (F.col("x") + F.col("left_px")).alias("x"))
    points = named.where("x is not null").groupBy("image_id", "name").agg(F.array_sort(F.collect_list(point)).alias("points"))
    wells = held.groupBy(F.col("image_id").alias("file")).agg(
        F.first("depth_unit").alias("unit"), F.first("metadata").alias("metadata"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "unit"))), lambda c: F.struct(c["name"].alias("name"), c["unit"].alias("unit"))).alias("curves"))
    texts = las_text(values, wells).join(wells, "file")
    md = F.col("metadata")
    name = las_file_name(first_metadata(md, "COMP"), first_metadata(md, "WELL"))
    return values, points, texts.select("file", "text", name.alias("name"))
