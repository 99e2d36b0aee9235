"""Curves cut into buckets against whole ones, NumPy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataspark.operators import curves


def test_interpolation_of_any_span(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for k in range(6):
        x = rng.random(60)
        x[rng.random(60) < (0.5, 0.9, 1.0, 0.0, 0.97, 0.7)[k]] = np.nan
        if k == 5:
            x[:20] = x[45:] = np.nan
        rows += [(k if k else None, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
        want[k if k else None] = pd.Series(x).interpolate(limit=4, limit_direction="both").to_numpy()
    t = spark.createDataFrame(rows, "image_id int, row_idx int, x double")
    for span in (3, 7, 10_000):
        got = {k: np.full(60, np.nan) for k in want}
        for r in curves.interpolated(t, ("image_id",), 4, span=span).collect():
            got[r.image_id][r.row_idx] = np.nan if r.x is None else r.x
        for k in want:
            assert got[k] == pytest.approx(want[k], nan_ok=True), (span, k)


def test_resampling_of_any_span(spark):
    rng = np.random.default_rng(2)
    rows, asked, want = [], [], {}
    for k in range(4):
        at = np.sort(np.concatenate([rng.random(20) * 0.01, rng.random(40) * 100])) if k < 3 else np.array([5.0])
        v = rng.random(len(at))
        grid = np.concatenate([np.linspace(-3, 110, 47), at[:5]])
        rows += [(k, float(a), float(b)) for a, b in zip(at, v)] + [(k, 50.0, None), (k, None, 1.0)]
        asked += [(k, float(g)) for g in grid]
        want |= {(k, float(g)): float(y) for g, y in zip(grid, np.interp(grid, at, v))}
    s, g = spark.createDataFrame(rows, "k int, at double, value double"), spark.createDataFrame(asked, "k int, at double")
    for span in (5, 16, 10_000):
        got = {(r.k, r.at): r.value for r in curves.resampled(s, g, ("k",), 1, span).collect()}
        assert got == pytest.approx(want)
    assert {r.value for r in curves.resampled(s, g, ("k",), 10, 5).where("k = 3").collect()} == {None}


def test_features_of_any_span(spark):
    rng = np.random.default_rng(3)
    rows = [("w", c, i, float(v)) for c in "ab" for i, v in enumerate(np.where(rng.random(90) < 0.2, -999.25, np.where(rng.random(90) < 0.05, 50, 1) * rng.random(90)))]
    rows += [("w", "none", i, -999.25) for i in range(20)] + [("w", "few", i, float(i)) for i in range(3)]
    s = spark.createDataFrame(rows, "well string, curve string, idx int, value double")
    a, b = ({r.curve: r.asDict() for r in curves.features(s, span=span).collect()} for span in (7, 10_000))
    assert a == {k: pytest.approx(v, nan_ok=True) for k, v in b.items()}
    v = np.array([r[3] for r in rows if r[1] == "a" and r[3] != -999.25])
    step = np.abs(np.diff(v))
    assert a["a"]["pct_spikes"] == pytest.approx((step > 5 * step.std()).sum() / len(v) * 100)


def test_a_long_curve_is_many_tasks(spark):
    s = spark.range(200_000).select(F.lit("c").alias("k"), (F.col("id") * 0.1).alias("at"), F.sin("id").alias("value"))
    g = spark.range(1000).select(F.lit("c").alias("k"), (F.col("id") * 17.0).alias("at"))
    got = {r.at: r.value for r in curves.resampled(s, g, ("k",)).collect()}
    at = np.arange(200_000) * 0.1
    assert [got[x] for x in sorted(got)] == pytest.approx(np.interp(sorted(got), at, np.sin(np.arange(200_000))).tolist())


@pytest.mark.parametrize("kind", ["even", "few", "wide"])
def test_percentiles_of_large_groups(spark, kind):
    from strataspark.operators.selection import percentiles

    rng = np.random.default_rng(5)
    of = {"even": lambda n: rng.random(n), "few": lambda n: rng.integers(0, 3, n).astype(float), "wide": lambda n: np.exp(rng.normal(0, 40, n))}[kind]
    groups = {"a": of(3000), None: of(501), "one": of(1)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.05, 0.5, 0.953, 1.0)
    got = {r.k: r.p for r in percentiles(df, ("k",), "v", shares, most=40).collect()}
    assert got == {r.k: pytest.approx(r.p, rel=1e-12) if r.p else None for r in percentiles(df, ("k",), "v", shares).collect()}
    assert got["a"] == pytest.approx(np.quantile(groups["a"], shares).tolist())


def test_following_values_are_read_from_the_end(spark):
    """The next value of a row comes from a frame that grows by a row, not from one that is read anew for every row."""
    from strataspark.operators.curves import around

    rows = [("a", i // 40, i, float(i) if i % 7 == 3 else None) for i in range(100)] + [("b", 0, 0, None)]
    got = around(spark.createDataFrame(rows, "well string, bucket int, idx int, v double"), ("well",), F.col("idx"), F.col("v"))
    at = [i for i in range(100) if i % 7 == 3]
    want = {("a", i, max((float(a) for a in at if a <= i), default=None), min((float(a) for a in at if a >= i), default=None)) for i in range(100)} | {("b", 0, None, None)}
    assert {(r.well, r.idx, r._a, r._b) for r in got.collect()} == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
