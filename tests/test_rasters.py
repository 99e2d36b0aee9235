"""Raster rows in blocks: results don't depend on where blocks are cut, and borders are mirrored or repeated as NumPy pads them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions.columns import mode_test
from strataspark.operators import pixels as P
from strataspark.operators import rasters as R
from strataspark.operators import traces


def table(spark, a, **more):
    rows = [("i", y, x, float(v)) for y, row in enumerate(a) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, value double").withColumns({k: F.lit(v) for k, v in more.items()})


def grid(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


@pytest.mark.parametrize("size", [3, 5])
def test_blur_mirrors_at_the_edge_pixel(spark, size):
    a = np.random.default_rng(1).integers(0, 256, (9, 7)).astype(float)
    k, w = size // 2, np.array(P.BLUR[size])
    padded = np.pad(a, k, mode="reflect")
    want = np.floor(sum(w[i] * w[j] * padded[i : i + 9, j : j + 7] for i in range(size) for j in range(size)) + 0.5)
    assert (grid(P.blur(table(spark, a), size=size), "value", a.shape) == want).all()
    block = R.blocks(R.packed(table(spark, a, height=9), 2, "value", also=("height",), block=4), ("value",), lambda b: {"v": R.halved(b.weighted(b.of["value"], P.BLUR[size]))}, "v array<double>", block=4)
    assert (grid(R.pixels_of(block, "v"), "v", a.shape) == want).all()


def test_lines_and_openings_of_any_block(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((60, 20)) < 0.6).astype(float)
    a[:, 3], a[5:40, 9], a[30, :], a[:4, 12] = 1, 1, 1, 1
    held = table(spark, a, height=60)
    got = {}
    for block in (7, 512):
        rows = R.packed(held, 18, "value", also=("height",), block=block)
        run = lambda b: {"v": b.lines(b.of["value"] > 0, 15, 0), "h": b.lines(b.of["value"] > 0, 6, 1), "o": b.opened(b.of["value"] > 0)}
        df = R.pixels_of(R.blocks(rows, ("value",), run, "v array<boolean>, h array<boolean>, o array<boolean>", block=block), "v", "h", "o")
        got[block] = [grid(df, c, a.shape) for c in "vho"]
    for x, y in zip(got[7], got[512]):
        assert (x == y).all()
    on = held.select("image_id", "y", "x", (F.col("value") > 0).alias("on"))
    for along, length, lines in (("y", 15, got[7][0]), ("x", 6, got[7][1])):
        left = {(r.y, r.x) for r in P.without_lines(on, along, length, 60 if along == "y" else 20).collect()}
        assert left == {(y, x) for y, x in zip(*np.nonzero((a > 0) & (lines == 0)))}


def test_curve_rows_of_any_block(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (70, 24))
    held = table(spark, a, mode="black", width=24, height=70).withColumns({"b": F.col("value"), "g": F.col("value") * 0.5, "r": (F.col("value") * 3) % 256})
    lit = lambda block: {r.y: r.on for r in P.curve_rows(held, mode_test, block=block).collect()}
    small, one = lit(8), lit(512)
    assert small == one and len(one) == 70 and any(map(any, one.values()))


def test_adaptive_mask_repeats_edges(spark):
    a = np.random.default_rng(4).integers(0, 256, (12, 60)).astype(float)
    w = np.exp(-((np.arange(-25, 26)) ** 2) / (2 * (0.3 * 24 + 0.8 + 0.0) ** 2))
    w /= w.sum()
    padded = np.pad(a, 25, mode="edge")
    mean = sum(w[i] * padded[i : i + 12] for i in range(51))
    mean = np.floor(sum(w[j] * mean[:, j : j + 60] for j in range(51)) + 0.5)
    got = grid(P.adaptive_mask(table(spark, a)), "on", a.shape)
    assert (got == (a - mean <= -10)).mean() > 0.999


def test_the_digitize_job_shuffles_pixels_once(spark):
    held = table(spark, np.zeros((20, 5)), mode="black", width=5, height=20)
    plan = R.packed(held, 18, "value", also=("mode", "width", "height"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_components_across_blocks(spark):
    rng = np.random.default_rng(6)
    a = (rng.random((40, 30)) < 0.42).astype(float)
    seen, want = np.zeros(a.shape, int), {}
    for y, x in zip(*np.nonzero(a)):  # flood fill, first pixel first
        if not seen[y, x]:
            todo = [(y, x)]
            seen[y, x] = 1
            while todo:
                p, q = todo.pop()
                want[p, q] = (int(y) << 32) + int(x)
                for u in range(max(0, p - 1), min(40, p + 2)):
                    for v in range(max(0, q - 1), min(30, q + 2)):
                        if a[u, v] and not seen[u, v]:
                            seen[u, v] = 1
                            todo.append((u, v))
    on = table(spark, a).select("image_id", "y", "x", (F.col("value") > 0).alias("on"))
    for block in (1, 7, 512):
        assert {(r.y, r.x): r.label for r in P.component_labels(on, block).collect()} == {(int(y), int(x)): v for (y, x), v in want.items()}


def test_scores_stay_off_the_driver(spark):
    """Stored masks of a thin stroke are files of few bytes; their pixels are no broadcast side of a join."""
    pixels = spark.range(8 * 500 * 64).select((F.col("id") % 8).cast("string").alias("image_id"), (F.floor(F.col("id") / 8) % 500).cast("int").alias("y"), F.floor(F.col("id") / 4000).cast("int").alias("x"))
    prob = P.cut(pixels.withColumn("p", F.when(F.col("x") == 9, 1.0).otherwise(0.0)))
    costs = traces.trace_costs(prob, traces.settings(prob.select("image_id").distinct(), curve_type="GR"))
    assert costs.count() == 8 * 500 * 64
    assert "BuildLeft" not in costs._jdf.queryExecution().executedPlan().toString()


def test_a_rasters_rows_are_numbered_in_ranges(spark, sf, monkeypatch):
    """Rows count on over the borders of ranges of ids, and no task orders a whole label."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from strataspark.plans import standins

    monkeypatch.setattr(standins, "RANGE", 7)
    got = standins.raster(spark, sf)
    assert "_within" in got._jdf.queryExecution().optimizedPlan().toString()
    e = standins.t(spark, sf, "embeddings").withColumn("y", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    want = {(str(r.label), r.y, min(255, int(abs(r.embedding[0]) * 600))) for r in e.collect()}
    assert {(r.image_id, r.y, r.value) for r in got.where("x = 0").collect()} == want
