"""Paths in blocks of rows against the same paths in one task, and against whole-image arrays."""

import numpy as np
import pytest

from strataspark.operators import paths, traces


def table(spark, images):
    rows = [(k, y, x, float(v)) for k, a in images.items() for y, row in enumerate(a) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, p double")


def images(seed=0):
    rng = np.random.default_rng(seed)
    tall = rng.random((31, 9))
    for y in range(31):  # a stroke that swings, with a gap
        if not 12 <= y < 15:
            tall[y, int(4 + 3 * np.sin(y / 4))] = 1.0
    return {"tall": tall, "seven": rng.random((7, 5)), "eight": rng.random((8, 6)), "one": rng.random((1, 4)), "ties": np.round(rng.random((22, 6)) * 2) / 2, "narrow": rng.random((15, 1)), "blank": np.zeros((9, 4))}


def got(df):
    return sorted((r.image_id, r.row_idx, r.x, r.conf) for r in df.collect())


def close(a, b):
    assert [r[:2] for r in a] == [r[:2] for r in b]
    for r, s in zip(a, b):
        assert r[2:] == pytest.approx(s[2:], abs=1e-9, nan_ok=True) if None not in (r[2], s[2]) else r[2] == s[2], (r, s)


def seam_of(p):
    """Least sum of 1 - p by a plain recursion over all columns; ties keep the column, then go left."""
    cost, n, w = 1 - p, *p.shape
    total, back = cost[0].copy(), np.zeros((n, w), int)
    for y in range(1, n):
        now = np.empty(w)
        for x in range(w):
            ways = [(total[x + d], k, x + d) for k, d in enumerate((0, -1, 1)) if 0 <= x + d < w]
            best = min(ways)
            now[x], back[y, x] = cost[y, x] + best[0], best[2]
        total = now
    x = [int(total.argmin())]
    for y in range(n - 1, 0, -1):
        x.append(int(back[y, x[-1]]))
    return x[::-1]


@pytest.mark.parametrize("block", [7, 2048])
def test_seam_in_blocks(spark, block):
    held = images()
    want = [(k, y, float(x), float(p[y, x])) for k, p in held.items() for y, x in enumerate(seam_of(p))]
    close(got(traces.seam(table(spark, held), block)), sorted(want))


@pytest.mark.parametrize("bend", [0.0, 0.3])
def test_least_path_in_blocks(spark, bend):
    held = images(3)
    costs = table(spark, held).selectExpr("*", "-ln(greatest(p, 1e-6)) as cost", "if(image_id = 'tall', 3, 1) as step", "0.2D as smooth", f"{bend}D as bend")
    close(got(traces.viterbi(costs, 7)), got(traces.viterbi(costs)))


def test_tracer_in_blocks(spark):
    prob = table(spark, images(5)).selectExpr("image_id", "y", "x", "p")
    setting = traces.settings(prob.select("image_id").distinct(), curve_type="RHOB", scale_min=1.0, scale_max=3.0, bend=0.1)
    close(got(traces.dp_tracer(prob, setting, 7)), got(traces.dp_tracer(prob, setting)))


@pytest.mark.parametrize("crest", [False, True])
def test_following_in_blocks(spark, crest):
    prob = table(spark, images(7)).selectExpr("*", "least(1D, p * 1.1) as ridge")
    close(got(traces.followed(prob, crest, 4, 7)), got(traces.followed(prob, crest, 4)))


def test_no_images(spark):
    none = table(spark, {"a": np.zeros((1, 1))}).limit(0)
    assert got(traces.seam(none)) == [] and got(traces.followed(none)) == []


def test_a_task_holds_a_block(spark):
    rows = paths.packed(table(spark, {"a": np.zeros((50, 3))}), 8, p=__import__("pyspark").sql.functions.col("p"))
    assert sorted((r.block, r["count"]) for r in rows.groupBy("block").count().collect()) == [(i, 8) for i in range(6)] + [(6, 2)]
    assert rows.first().p == [0.0, 0.0, 0.0]
