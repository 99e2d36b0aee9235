"""Pixel tables: image_id, y, x, and either b, g, r or a value. Neighbourhoods are windows over rows or columns; line openings are run lengths.

Images differ in size, so operators that need it take sizes(image_id, width, height) or find it by sizes_of().
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import rasters as R
from .graph import components, cut, stored

BLUR = {3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625)}
#: Rows that the digitize job's chain reaches: a blur (up to 2), a line (15), the gap fill's blur (1).
HALO = 18
#: Tangents of 22.5 and 67.5 degrees, between which a gradient counts as diagonal.
TAN_LOW, TAN_HIGH = math.tan(math.pi / 8), math.tan(3 * math.pi / 8)


def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_col() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def apart(table: DataFrame) -> DataFrame:
    """A table of pixels or rows as a side of a join on these: both sides are dealt out by the keys.

    Stored masks are files of so few bytes that Spark would take them for small tables and send them whole through the driver.
    """
    return table.hint("merge")


def sizes_of(pixels: DataFrame) -> DataFrame:
    """image_id, width, height of a dense table."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def crop(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels inside their image's region (left_px, right_px, top_px, bottom_px; clamped, half open), rebased to it; empty regions give none.

    A region may carry further columns (a curve's name, say), and an image may have several regions.
    """
    low = lambda c: F.greatest(F.lit(0), c)
    held = pixels.join(regions, "image_id")
    held = held.where((F.col("x") >= low("left_px")) & (F.col("x") < F.col("right_px")) & (F.col("y") >= low("top_px")) & (F.col("y") < F.col("bottom_px")))
    held = held.withColumn("x", F.col("x") - low("left_px")).withColumn("y", F.col("y") - low("top_px"))
    return held.drop("left_px", "right_px", "top_px", "bottom_px")


def _weighted(value: str, weights: tuple[float, ...], w: WindowSpec, replicate: bool = False) -> Column:
    """Weighted sum of neighbours; beyond an edge the image mirrored at its edge pixel counts, or the edge itself."""
    half, total = len(weights) // 2, F.lit(0.0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(w)
    near = lambda d: F.col(value) if d == 0 else F.lag(value, -d).over(w) if d < 0 else F.lead(value, d).over(w)
    for i, weight in enumerate(weights):
        d = i - half
        if d == 0:
            v = F.col(value)
        elif replicate:
            v = F.coalesce(near(d), (F.first if d < 0 else F.last)(value).over(whole))
        else:
            sign, v = (-1, near(d)) if d < 0 else (1, near(d))
            away = place - 1 if d < 0 else F.count(F.lit(1)).over(whole) - place
            for k in range(abs(d)):  # the edge is k places away
                v = F.coalesce(v, F.when(away == k, near(sign * (2 * k - abs(d)))))
            v = F.coalesce(v, F.col(value))
        total = total + v * weight
    return total


def blur(pixels: DataFrame, value: str = "value", size: int = 3, whole: bool = True) -> DataFrame:
    """Separable Gaussian blur; an even size is widened by one; grey levels are rounded, probabilities (whole=False) aren't."""
    weights = BLUR[size + (size + 1) % 2]
    out = pixels.withColumn(value, _weighted(value, weights, along_row())).withColumn(value, _weighted(value, weights, along_col()))
    return out.withColumn(value, F.round(value)) if whole else out


def adaptive_mask(pixels: DataFrame, value: str = "value", size: int = 51, offset: float = 10.0) -> DataFrame:
    """image_id, y, x, value, on: whether a value is the offset or more under the Gaussian-weighted mean round it, itself rounded; edges are repeated outwards."""
    half, sigma = size // 2, 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    weights = tuple(w / sum(weights) for w in weights)

    def run(b: R.Block) -> dict:
        return {"value": b.of[value], "on": b.of[value] - R.halved(b.weighted(b.of[value], weights, True)) <= -math.floor(offset)}

    rows = R.packed(pixels.join(sizes_of(pixels), "image_id"), half, value, also=("height",))
    return R.pixels_of(R.blocks(rows, (value,), run, "value array<double>, on array<boolean>"), "value", "on").withColumnRenamed("value", value)


# --- runs, lines and rails -----------------------------------------------------------------------------------------


def runs(mask: DataFrame, along: str) -> DataFrame:
    """The mask's on-pixels with run (first place) and length of their run along rows ("x") or columns ("y")."""
    across = "y" if along == "x" else "x"
    on = mask.where("on").withColumn("_g", F.col(along) - F.row_number().over(Window.partitionBy("image_id", across).orderBy(along)))
    by = Window.partitionBy("image_id", across, "_g")
    return on.withColumn("run", F.min(along).over(by)).withColumn("length", F.count(F.lit(1)).over(by)).drop("_g")


def _survives(length: Column, size: Column) -> Column:
    """Whether a run outlives an opening by `length`; beyond a border nothing is taken away."""
    need = F.when(F.col("run") == 0, length - F.floor(length / 2)).when(F.col("run") + F.col("length") == size, F.floor(length / 2) + 1).otherwise(length)
    return F.col("length") >= need


def without_lines(mask: DataFrame, along: str, length: int | Column, size: int | Column) -> DataFrame:
    """On-pixels left when lines of at least `length` along an axis are taken away; a run at a border counts as an opening's border rule has it."""
    length, size = (c if isinstance(c, Column) else F.lit(c) for c in (length, size))
    return runs(mask, along).where(~_survives(length, size)).drop("run", "length")


def without_gridlines(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """On-pixels left without vertical lines of at least min(15, h/3), then without horizontal ones of min(15, w/3); images of up to 15 rows or columns keep theirs."""
    m = mask.where("on").select("image_id", "y", "x", "on").join(sizes, "image_id")
    third = lambda c: F.least(F.lit(15), F.floor(F.col(c) / 3))
    r = runs(m, "y").where(~(_survives(third("height"), F.col("height")) & (F.col("height") > 15))).drop("run", "length")
    r = runs(r, "x").where(~(_survives(third("width"), F.col("width")) & (F.col("width") > 15)))
    return r.select("image_id", "y", "x", "on")


def without_spines(mask: DataFrame, sizes: DataFrame, share: float = 0.9, least: tuple[int, int] = (40, 4)) -> DataFrame:
    """On-pixels without the columns that are on in over the share of rows; images under 40 rows or 4 columns keep theirs."""
    full = mask.where("on").groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("n")).join(sizes, "image_id")
    full = full.where((F.col("n") / F.col("height") > share) & (F.col("height") >= least[0]) & (F.col("width") >= least[1]))
    return mask.where("on").join(full.select("image_id", "x"), ["image_id", "x"], "left_anti")


def otsu(pixels: DataFrame, value: str = "value") -> DataFrame:
    """image_id, threshold: the level of greatest between-class variance, the lowest on ties; none for an image of one level."""
    return otsu_of(pixels.groupBy("image_id", F.col(value).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")))


def otsu_of(hist: DataFrame) -> DataFrame:
    """The same from counts (image_id, level, n)."""
    up, all_ = Window.partitionBy("image_id").orderBy("level"), Window.partitionBy("image_id")
    h = hist.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("level")).over(up))
    h = h.withColumn("w", F.sum("n").over(all_)).withColumn("s", F.sum(F.col("n") * F.col("level")).over(all_))
    w1 = F.col("w") - F.col("w0")
    d = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    h = h.where("w > w0").withColumn("between", F.round(F.col("w0") * w1 * d * d, 6))
    return h.groupBy("image_id").agg(F.min_by("level", F.struct(-F.col("between"), F.col("level"))).alias("threshold"))


def gap_filled(mask: DataFrame) -> DataFrame:
    """A dense mask (image_id, y, x, on), blurred 3 x 3 and cut again at its Otsu threshold: image_id, y, x, value, on."""
    b = blur(mask.withColumn("value", F.when(F.col("on"), 255.0).otherwise(0.0)))
    cuts = otsu(b)
    return b.join(cuts, "image_id", "left").withColumn("on", F.col("value") > F.coalesce("threshold", F.lit(0))).drop("threshold")


def curve_rows(pixels: DataFrame, on, size: int = 3, block: int = R.BLOCK) -> DataFrame:
    """image_id, y, on (an array by x): the cleaned mask of curve tracks from dense pixels (image_id, y, x, b, g, r, mode, width, height): blurred, tested by on(mode, b, g, r), without gridlines, gaps filled, without spines.

    The pixels are shuffled once, into blocks of rows; what is known of a whole image (its levels' counts by column) is
    summed and joined back.
    """
    weights = BLUR[size + (size + 1) % 2] if size > 0 else (1.0,)

    def run(b: R.Block) -> dict:
        mask = on(b.args["mode"], *(R.halved(b.weighted(b.of[c], weights)) for c in "bgr"))
        for axis, n in ((0, b.height), (1, mask.shape[1])):
            if n > 15:
                mask = mask & ~b.lines(mask, min(15, n // 3), axis)
        return {"level": R.halved(b.weighted(np.where(mask, 255.0, 0.0), BLUR[3])).astype(np.int32)}

    rows = R.packed(pixels, HALO, "b", "g", "r", also=("mode", "width", "height"), block=block)
    rows = stored(R.blocks(rows, ("b", "g", "r"), run, "level array<int>", ("width", "height"), block), "levels")

    counts = rows.select("image_id", "height", "width", F.posexplode("level").alias("x", "level")).groupBy("image_id", "height", "width", "x", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "counts")
    cuts = otsu_of(counts.groupBy("image_id", "level").agg(F.sum("n").alias("n")))
    images = counts.select("image_id").distinct().join(cuts, "image_id", "left").select("image_id", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    full = counts.join(images, "image_id").where("level > threshold and height >= 40 and width >= 4").groupBy("image_id", "height", "x").agg(F.sum("n").alias("n"))
    full = full.where("n / height > 0.9").groupBy("image_id").agg(F.collect_list("x").alias("spines"))  # columns of one image
    images = images.join(full, "image_id", "left").select("image_id", "threshold", F.coalesce("spines", F.array().cast("array<int>")).alias("spines"))
    lit = F.transform("level", lambda v, x: (v > F.col("threshold")) & ~F.array_contains("spines", x))
    return rows.join(images, "image_id").select("image_id", "y", lit.alias("on"))


def without_rails(mask: DataFrame, sizes: DataFrame, value: str = "value", strong: int = 25, dark: int = 40) -> DataFrame:
    """on, dense: values over 25 that no vertical or horizontal run of values under 40 of max(12, h/24 or w/24) covers."""
    m = mask.join(sizes, "image_id")
    low = m.withColumn("on", F.col(value) < dark)
    least = lambda c: F.greatest(F.lit(12), F.floor(F.col(c) / 24))
    rails = [runs(low, a).where(_survives(least(c), F.col(c))).select("image_id", "y", "x") for a, c in (("y", "height"), ("x", "width"))]
    rail = rails[0].union(rails[1]).distinct().withColumn("rail", F.lit(True))
    held = m.join(rail, ["image_id", "y", "x"], "left")
    return held.select("image_id", "y", "x", ((F.col(value) > strong) & F.col("rail").isNull()).alias("on"))


def fallback_mask(pixels: DataFrame) -> DataFrame:
    """image_id, y, x, on from grey values: 5 x 5 blur, values up to 205, 3 x 3 opening."""
    rows = R.packed(pixels.join(sizes_of(pixels), "image_id"), 4, "value", also=("height",))
    run = lambda b: {"on": b.opened(R.halved(b.weighted(b.of["value"], BLUR[5])) <= 205)}
    return R.pixels_of(R.blocks(rows, ("value",), run, "on array<boolean>"), "on")


# --- hues ----------------------------------------------------------------------------------------------------------


def dominant_hue(hues: DataFrame, least: int = 50, share: float = 0.3) -> DataFrame:
    """image_id, colour from rows of image_id, y, x, h, s, v: the strongest of 18 hue bins of saturated pixels in the middle 30 % of columns; null under 10 rows or columns."""
    size = sizes_of(hues).where("width >= 10 and height >= 10")
    mid = (F.col("x") >= F.floor(F.col("width") * 0.35)) & (F.col("x") < F.floor(F.col("width") * 0.65))
    ink = hues.join(size, "image_id").where(mid & (F.col("s") > 60) & (F.col("v") > 50) & (F.col("v") < 230))
    bins = ink.groupBy("image_id", F.floor(F.col("h") / 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    top = bins.groupBy("image_id").agg(F.sum("n").alias("total"), F.max("n").alias("peak"), F.min_by("bin", F.struct(-F.col("n"), F.col("bin"))).alias("bin"))
    top = top.where((F.col("total") >= least) & (F.col("peak") >= share * F.col("total")))
    h = F.col("bin") * 10 + 5
    colour = F.when((h < 15) | (h > 165), "red").when((h > 35) & (h < 95), "green").when((h > 85) & (h < 145), "blue")
    return hues.select("image_id").distinct().join(top, "image_id", "left").select("image_id", colour.alias("colour"))


def hue_weight(hues: DataFrame, sigma: float = 12.0, least: int = 20) -> DataFrame:
    """image_id, y, x, weight from image_id, y, x, h, ink: nearness to the mean hue of ink over its 70th percentile, 0.15 to 1; 1 where over 20 pixels aren't that strong.

    The mean is an angle of 0 to 360 while hues end at 179; the distance is taken between the two as they are.
    """
    cuts = hues.groupBy("image_id").agg(F.percentile("ink", F.lit(0.7)).alias("cut"))
    turn = F.radians(F.col("h") * 2.0)
    strong = hues.join(cuts, "image_id").where("ink > cut").groupBy("image_id")
    mean = strong.agg(F.degrees(F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn)))).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    m = F.when(F.col("m") < 0, F.col("m") + 360).otherwise(F.col("m"))
    off = F.abs(F.pmod(F.col("h") - m + 90, F.lit(180.0)) - 90)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.15), F.exp(-off * off / (2 * sigma * sigma))))
    return hues.join(mean, "image_id", "left").select("image_id", "y", "x", F.coalesce(weight, F.lit(1.0)).alias("weight"))


# --- edges, tracks, bounds -----------------------------------------------------------------------------------------


def gradient(pixels: DataFrame, value: str = "value", replicate: bool = True) -> DataFrame:
    """gx, gy and their absolute sum, by 3 x 3 differences; edges are repeated outwards, or mirrored."""
    smooth, diff = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)
    across = lambda c, weights, w: _weighted(c, weights, w, replicate)
    p = pixels.withColumn("_dx", across(value, diff, along_row())).withColumn("_sx", across(value, smooth, along_row()))
    p = p.withColumn("gx", across("_dx", smooth, along_col())).withColumn("gy", across("_sx", diff, along_col()))
    return p.withColumn("mag", F.abs("gx") + F.abs("gy")).drop("_dx", "_sx")


def edges(pixels: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    """image_id, y, x of edge pixels: gradients over `low` that no neighbour across the edge exceeds, in an 8-connected group with one over `high`."""
    row, col = along_row(), along_col()
    g = gradient(pixels, value)
    near = lambda f, c, w: F.coalesce(f(c).over(w), F.lit(0.0))
    g = g.withColumn("l", near(F.lag, "mag", row)).withColumn("r", near(F.lead, "mag", row))
    g = g.withColumn("u", near(F.lag, "mag", col)).withColumn("d", near(F.lead, "mag", col))
    for name, side, across in (("ul", "l", F.lag), ("ur", "r", F.lag), ("dl", "l", F.lead), ("dr", "r", F.lead)):
        g = g.withColumn(name, near(across, side, col))
    ax, ay = F.abs("gx"), F.abs("gy")
    falling = (F.col("gx") < 0) != (F.col("gy") < 0)
    m = F.col("mag")
    peak = (
        F.when(ay < ax * TAN_LOW, (m > F.col("l")) & (m >= F.col("r")))
        .when(ay > ax * TAN_HIGH, (m > F.col("u")) & (m >= F.col("d")))
        .when(falling, (m > F.col("ur")) & (m > F.col("dl")))
        .otherwise((m > F.col("ul")) & (m > F.col("dr")))
    )
    weak = cut(g.where((m > low) & peak).select("image_id", "y", "x", F.lit(True).alias("on"), (m > high).alias("strong")))
    named = component_labels(weak)
    sure = named.where("strong").select("image_id", "label").distinct()
    return named.join(sure, ["image_id", "label"], "left_semi").select("image_id", "y", "x")


def tracks(edge: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, left_px, right_px: between neighbouring peaks of the columns' numbers of edge pixels, over 0.3 of the highest and 5 % of the width apart; equal thirds where fewer than two peaks stand out.

    An image's peaks are at most its columns, which is what the fold over them holds.
    """
    columns = sizes.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    sums = columns.join(edge.groupBy("image_id", "x").agg(F.count(F.lit(1)).alias("e")), ["image_id", "x"], "left").withColumn("e", F.coalesce("e", F.lit(0)))
    w = Window.partitionBy("image_id").orderBy("x")
    top = sums.groupBy("image_id").agg(F.max("e").alias("top"))
    peak = sums.withColumn("a", F.lag("e").over(w)).withColumn("b", F.lead("e").over(w)).join(top, "image_id").where("e > a and e > b and e > 0.3 * top")
    start = F.array().cast("array<int>")
    step = lambda k, p: F.when((F.size(k) == 0) | (p - F.element_at(k, -1) >= F.col("width") * 0.05), F.concat(k, F.array(p))).otherwise(k)
    spaced = peak.groupBy("image_id", "width").agg(F.array_sort(F.collect_list(F.col("x").cast("int"))).alias("at"))
    spaced = spaced.select("image_id", F.aggregate("at", start, step).alias("at"))
    third = F.floor(F.col("width") / 3).cast("int")
    found = sizes.join(spaced, "image_id", "left")
    bounds = F.when(F.coalesce(F.size("at"), F.lit(0)) >= 2, F.col("at")).otherwise(F.array(*(third * i for i in range(4))))
    pair = F.explode(F.arrays_zip(F.slice(bounds, 1, F.size(bounds) - 1).alias("l"), F.slice(bounds, 2, F.size(bounds) - 1).alias("r")))
    return found.select("image_id", pair.alias("t")).select("image_id", F.col("t.l").alias("left_px"), F.col("t.r").alias("right_px"))


def content_bounds(pixels: DataFrame, value: str = "value") -> DataFrame:
    """image_id, top_px, bottom_px of the rows whose dark share exceeds max(0.03, a fifth of the highest), with a margin of 8; the whole image where there is none."""
    share = pixels.groupBy("image_id", "y").agg(F.avg(F.when(F.col(value) < 210, 1.0).otherwise(0.0)).alias("f"))
    top = share.groupBy("image_id").agg(F.greatest(F.lit(0.03), 0.2 * F.max("f")).alias("cut"), (F.max("y") + 1).alias("height"))
    kept = F.when(F.col("f") > F.col("cut"), F.col("y"))
    out = share.join(top, "image_id").groupBy("image_id", "height").agg(F.min(kept).alias("a"), F.max(kept).alias("b"))
    return out.select("image_id", F.greatest(F.lit(0), F.coalesce(F.col("a") - 8, F.lit(0))).alias("top_px"), F.least("height", F.coalesce(F.col("b") + 9, "height")).alias("bottom_px"))


# --- morphology ----------------------------------------------------------------------------------------------------


def opened(mask: DataFrame) -> DataFrame:
    """image_id, y, x, on: 3 x 3 erosion, then dilation of a dense on column; beyond the border nothing erodes or dilates."""
    rows = R.packed(mask.join(sizes_of(mask), "image_id"), 2, "on", also=("height",))
    return R.pixels_of(R.blocks(rows, ("on",), lambda b: {"on": b.opened(b.of["on"] > 0)}, "on array<boolean>"), "on")


def closed(pixels: DataFrame, value: str, width: int, height: int) -> DataFrame:
    """Dilation, then erosion of a dense value by a rectangle; an even side reaches one further back, then one further on, so that nothing shifts."""
    for f, turn in ((F.max, False), (F.min, True)):
        for w, n in ((along_row(), width), (along_col(), height)):
            back, on = n // 2, n - 1 - n // 2
            back, on = (on, back) if turn else (back, on)
            pixels = pixels.withColumn(value, f(value).over(w.rowsBetween(-back, on)))
    return pixels


def _tile_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's on-pixels with the first pixel (y * 2^32 + x) of their 8-connected component in the block: runs of a row are joined to those they touch in the row before."""
    pdf = pdf.sort_values(["y", "x"])
    y, x = pdf["y"].to_numpy().astype(np.int64), pdf["x"].to_numpy().astype(np.int64)
    new = np.ones(len(y), dtype=bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    at = np.flatnonzero(new)
    row, start, stop = y[at], x[at], x[np.append(at[1:], len(y)) - 1]
    root = list(range(len(at)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    j = 0
    for i in range(len(at)):
        while j < i and (row[j] < row[i] - 1 or (row[j] == row[i] - 1 and stop[j] < start[i] - 1)):
            j += 1
        k = j
        while k < i and row[k] == row[i] - 1 and start[k] <= stop[i] + 1:
            a, b = find(k), find(i)
            root[max(a, b)] = min(a, b)
            k += 1
    first = np.array([find(i) for i in range(len(at))], dtype=np.int64)
    return pdf.assign(label=((row << 32) + start)[first][np.cumsum(new) - 1])


def component_labels(mask: DataFrame, block: int = R.BLOCK) -> DataFrame:
    """On-pixels with label, the first pixel (y * 2^32 + x) of their 8-connected component.

    Blocks of rows are labelled apart, by union-find inside a task; only labels that meet at a border between blocks are
    edges of the components that join them.
    """
    on = mask.where("on").withColumn("block", F.floor(F.col("y") / block).cast("int"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in on.dtypes), "label long"])
    named = stored(on.groupBy("image_id", "block").applyInPandas(_tile_labels, schema), "tiles").drop("block")
    low = named.where((F.col("y") + 1) % block == 0).select("image_id", (F.col("y") + 1).alias("y"), F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("x"), F.col("label").alias("a"))
    high = named.where((F.col("y") % block == 0) & (F.col("y") > 0)).select("image_id", "y", "x", F.col("label").alias("b"))
    touch = stored(low.join(high, ["image_id", "y", "x"]).select(F.struct("image_id", F.col("a").alias("label")).alias("a"), F.struct("image_id", F.col("b").alias("label")).alias("b")).distinct(), "borders")
    if touch.isEmpty():
        return named
    joined = components(touch).select("node.image_id", "node.label", F.col("component.label").alias("_first"))
    return named.join(joined, ["image_id", "label"], "left").withColumn("label", F.coalesce("_first", "label")).drop("_first")


def largest_component(mask: DataFrame) -> DataFrame:
    """On-pixels of each image's largest 8-connected component, the first on ties."""
    named = cut(component_labels(mask))
    best = named.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"))
    best = best.groupBy("image_id").agg(F.min_by("label", F.struct(-F.col("area"), F.col("label"))).alias("label"))
    return named.join(best, ["image_id", "label"], "left_semi").select("image_id", "y", "x")


# --- resampling ----------------------------------------------------------------------------------------------------


_CELLS = "array<struct<c:int,w:double>>"


def _area_cells(at: Column, size: Column, out: Column) -> Column:
    """(cell, overlap) of a source place when `size` places shrink to `out`."""
    a, b = at * out / size, (at + 1) * out / size
    cell = lambda c: F.struct(c.alias("c"), (F.least(b, c + 1.0) - F.greatest(a, c.cast("double"))).alias("w"))
    last = F.least(out.cast("int") - 1, F.floor(b - 1e-9).cast("int"))
    return F.filter(F.transform(F.sequence(F.floor(a).cast("int"), last), cell).cast(_CELLS), lambda e: e["w"] > 1e-9)


def _linear_cells(at: Column, size: Column, out: Column) -> Column:
    """(cell, weight) of a source place for the cells that lie between it and its neighbours; edges are repeated outwards."""
    ratio = size / out
    place = lambda c: F.least(size - 1.0, F.greatest(F.lit(0.0), (c + 0.5) * ratio - 0.5))
    cell = lambda c: F.struct(c.alias("c"), (1.0 - F.abs(place(c) - at)).alias("w"))
    first = F.greatest(F.lit(0), F.when(at == 0, 0).otherwise(F.floor((at - 0.5) / ratio - 0.5).cast("int")))
    last = F.least(out.cast("int") - 1, F.when(at == size - 1, out.cast("int") - 1).otherwise(F.ceil((at + 1.5) / ratio - 0.5).cast("int")))
    return F.filter(F.transform(F.sequence(first, F.greatest(first, last)), cell).cast(_CELLS), lambda e: e["w"] > 1e-9)


def _resampled(pixels: DataFrame, cells, width, height, out_w, out_h, value: str | tuple[str, ...]) -> DataFrame:
    values = (value,) if isinstance(value, str) else value
    col = lambda c: c if isinstance(c, Column) else F.lit(c)
    width, height, out_w, out_h = map(col, (width, height, out_w, out_h))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    held = pixels.select("image_id", *(F.col(v).alias(f"_{v}") for v in values), F.explode(cells(x, width, out_w)).alias("cx"), cells(y, height, out_h).alias("cys"))
    held = held.select("image_id", *(f"_{v}" for v in values), "cx", F.explode("cys").alias("cy"))
    w = F.col("cx.w") * F.col("cy.w")
    return held.groupBy("image_id", F.col("cy.c").alias("y"), F.col("cx.c").alias("x")).agg(*((F.sum(w * F.col(f"_{v}")) / F.sum(w)).alias(v) for v in values))


def area_resampled(pixels: DataFrame, width, height, out_w, out_h, value: str | tuple[str, ...] = "value") -> DataFrame:
    """Down-scaling by area: each source pixel gives its overlap to the cells it meets. Sizes are numbers or columns, values one column or several."""
    return _resampled(pixels, _area_cells, width, height, out_w, out_h, value)


def bilinear_resampled(pixels: DataFrame, width, height, out_w, out_h, value: str | tuple[str, ...] = "value") -> DataFrame:
    """Each cell's value is read linearly between the four pixels round its middle."""
    return _resampled(pixels, _linear_cells, width, height, out_w, out_h, value)


def box_mean_down(pixels: DataFrame, value: str, rows: int) -> DataFrame:
    """The mean of so many rows round each pixel; beyond an edge the mirrored row counts."""
    return pixels.withColumn(value, _weighted(value, (1 / rows,) * rows, along_col()))


def ocr_scaled(pixels: DataFrame, sizes: DataFrame, most: int = 2000) -> DataFrame:
    """Grey images of over 2000 rows, brought to 2000 by area, the width in proportion; others as they are."""
    held = pixels.join(sizes, "image_id")
    tall = held.where(F.col("height") > most)
    out_w = F.greatest(F.lit(1), F.floor(F.col("width") * most / F.col("height")))
    cells = area_resampled(tall, F.col("width"), F.col("height"), out_w, F.lit(most))
    return held.where(F.col("height") <= most).select("image_id", "y", "x", "value").unionByName(cells.select("image_id", "y", "x", F.round("value").alias("value")))


# --- scores --------------------------------------------------------------------------------------------------------


def centre_score(mask: DataFrame) -> DataFrame:
    """On-pixels with d (distance to the nearer end of their row or column run, over the image's greatest), p (d to the power 0.9) and mid (whether it is the middle of its row run)."""
    r = runs(mask, "x").withColumn("dx", F.least(F.col("x") - F.col("run"), F.col("run") + F.col("length") - 1 - F.col("x")) + 1)
    r = r.withColumn("mid", F.col("x") == F.col("run") + F.floor((F.col("length") - 1) / 2)).select("image_id", "y", "x", "dx", "mid", "on")
    c = runs(r, "y").withColumn("d", F.least("dx", F.least(F.col("y") - F.col("run"), F.col("run") + F.col("length") - 1 - F.col("y")) + 1))
    # Stored, for the runs are read for an image's greatest distance and again for each pixel's.
    c = cut(c.select("image_id", "y", "x", "d", "mid"))
    top = c.groupBy("image_id").agg(F.max("d").alias("top"))
    c = c.join(top, "image_id").withColumn("d", F.col("d") / F.col("top"))
    return c.select("image_id", "y", "x", "d", F.pow("d", F.lit(0.9)).alias("p"), "mid")


def ridge_score(dense: DataFrame) -> DataFrame:
    """ridge, 0 to 1: the middles of row runs (mid), feathered 3 x 3, over the image's highest."""
    f = cut(blur(dense.withColumn("ridge", F.when(F.col("mid"), 1.0).otherwise(0.0)), "ridge", whole=False))
    top = f.groupBy("image_id").agg(F.max("ridge").alias("top"))
    return f.join(top, "image_id").withColumn("ridge", F.when(F.col("top") > 0, F.col("ridge") / F.col("top")).otherwise(0.0)).drop("top")
