"""Kernels, symbols, factorisations, generators, panels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import generators, layout, series
from tidewright.operators import als, bound, control, factor, kernels


@given(st.lists(st.integers(0, 2), max_size=300))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip(symbols):
    assert bound.decompress(bound.compress(symbols, 3), 3) == symbols


def test_entropy_and_fano():
    assert bound.entropy(np.array([0.5, 0.5])) == pytest.approx(1)
    assert bound.fano_error(0.0, 3) == pytest.approx(0, abs=1e-9)
    assert bound.fano_error(np.log2(3), 3) == pytest.approx(2 / 3)
    assert bound.markov_entropy_rate(np.array([[0.5, 0.5], [0.5, 0.5]])) == pytest.approx(1)


def test_incremental_factors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 3)) @ rng.normal(size=(3, 40))
    u, s, v, _ = kernels.truncated(x[:, :30], 3)
    u2, s2, v2 = kernels.append_columns(u, s, v, x[:, 30:], 3)
    assert np.allclose((u2 * s2) @ v2.T, x)
    u3, s3, v3 = kernels.fold_in(u, s, v, x[:, 30:])
    assert np.allclose((u3 * s3) @ v3.T, x)


def test_rank_threshold():
    rng = np.random.default_rng(0)
    x = 50 * rng.normal(size=(20, 2)) @ rng.normal(size=(2, 200)) + rng.normal(size=(20, 200))
    assert kernels.truncated(x, None)[0].shape[1] == 2


@pytest.mark.parametrize("entries,series,want", [(2_500_000, 1, (500, 5000, 2_500_000)), (10_000, 1, (31, 310, 9_610)), (2_500_000, 3, (500, 5004, 2_502_000))])
def test_dimensions(entries, series, want):
    d = layout.dimensions(entries, 10.0, series)
    assert (d.rows, d.columns, d.entries) == want


@pytest.mark.parametrize("n,want", [(720, (8, 90)), (1000, (10, 100)), (10_000, (31, 322)), (100_000, (100, 1000))])
def test_single_shape(n, want):
    (shape,) = layout.shapes(n, layout.dimensions(n * 2, 10.0))
    assert (shape.rows, shape.segments) == want


def test_masks(spark):
    df = generators.steps(spark, 20_000).withColumn("value", generators.mask(F.col("t").cast("double"), 0.7, 3))
    share = df.agg(F.avg(F.col("value").isNotNull().cast("int"))).first()[0]
    assert 0.68 < share < 0.72
    full = generators.steps(spark, 5000).withColumn("value", F.col("t").cast("double"))
    hidden = generators.mask_runs(full, 0.01, 20, 5).where("value is null").count()
    assert 0 < hidden < 2500


def test_arma(spark):
    rows = generators.arma(spark, 4000, [0.8], [], 1.0, 3).orderBy("t").collect()
    x = np.array([r["value"] for r in rows])
    assert np.corrcoef(x[1:], x[:-1])[0, 1] == pytest.approx(0.8, abs=0.05)


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def test_components_and_inverse(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    h = np.array([r["h"] for r in factor.pca(vectors(spark, x), 2).orderBy("id").collect()])
    c = x - x.mean(axis=0)
    _, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.linalg.norm(h, axis=0), s[:2])
    assert np.allclose(factor.pseudo_inverse(vectors(spark, x)) @ x.T, np.linalg.pinv(x))


def test_nonnegative_factors(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(80, 2)) @ rng.uniform(size=(2, 6))
    w, rows = factor.nmf(vectors(spark, x), 2, 30)
    h = np.array([r["h"] for r in rows.orderBy("id").collect()])
    assert (w >= 0).all() and (h >= 0).all()
    assert np.linalg.norm(h @ w - x) < 0.1 * np.linalg.norm(x)
    found = factor.errors(rows, w).first()
    assert np.isclose(found["frobenius"], np.linalg.norm(h @ w - x)) and np.isclose(found["residual"], 100 * np.abs(h @ w - x).sum() / np.abs(x).sum())


def test_simplex_rows_are_corners(spark):
    rng = np.random.default_rng(5)
    corners = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 9.0]])
    inner = rng.dirichlet([5, 5, 5], size=40) @ corners
    x = np.concatenate([inner[:20], corners, inner[20:], corners])
    assert set(factor.simplex_rows(vectors(spark, x), 3)) == {20, 21, 22}
    assert factor.simplex_rows(vectors(spark, x).limit(0), 3) == []


def test_settled_on_the_error_of_the_factors():
    rng = np.random.default_rng(3)
    x, h, w = rng.normal(size=(30, 5)), rng.normal(size=(30, 2)), rng.normal(size=(2, 5))
    course = []
    assert not factor._settled(course, w, factor._products(x, h))
    assert np.isclose(course[0], np.linalg.norm(x - h @ w))
    assert factor._settled(course, w, factor._products(x, h))
    assert not factor._settled([], w, factor._products(x, h))


def test_completion(spark):
    rng = np.random.default_rng(4)
    x = np.outer(rng.uniform(1, 2, 20), rng.uniform(1, 2, 30))
    cells = [(i, j, float(x[i, j]) if rng.uniform() < 0.7 else None) for i in range(20) for j in range(30)]
    out = als.complete(spark.createDataFrame(cells, "row int, col int, value double"), 2).collect()
    assert len(out) == 600
    missing = [(r["estimate"], x[r["row"], r["col"]]) for r in out if r["value"] is None]
    assert np.sqrt(np.mean([(a - b) ** 2 for a, b in missing])) < 0.2


def test_planted_control(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2, 60)).cumsum(axis=1) + 20
    donors = {str(i): rng.uniform(0.2, 1, 2) @ base for i in range(1, 8)}
    target = 0.4 * donors["1"] + 0.6 * donors["2"]
    rows = [(u, t, float(v)) for u, x in ({"0": target} | donors).items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "unit string, time long, value double")
    out = control.synthetic_control(df, "unit", "time", "0", {"value": 1.0}, 39, 2).where("time > 39").collect()
    assert len(out) == 20
    assert max(abs(r["actual"] - r["synthetic"]) for r in out) < 1e-6


def test_lower_bound(spark):
    steady = spark.range(600).select(F.col("id").alias("t"), (F.col("id") % 2).cast("double").alias("v"))
    noisy = spark.range(600).select(F.col("id").alias("t"), F.rand(3).alias("v"))
    low = bound.lower_bound(steady, "t", "v", 500).first()[0]
    high = bound.lower_bound(noisy, "t", "v", 500).first()[0]
    assert 0 <= low < high < 2 / 3
    gap = noisy.withColumn("v", F.when(F.col("t") != 599, F.col("v")))
    assert bound.lower_bound(gap, "t", "v", 500).first()[0] is None


def test_projected_lags():
    """Every lag vector with an observed value is projected, none after it."""
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.normal(size=(4, 2)))[0]
    p, w, x = u @ u.T, rng.normal(size=4) / 4, list(rng.normal(size=4))
    got = kernels.recurse(np.array(x), w, 0.5, 7, p, 4)
    for i in range(7):
        lag = np.array(x[-4:])
        x.append(0.5 + w @ (p @ lag if i < 4 else lag))
    assert np.allclose(got, x[4:])


def test_long_series_fill(spark):
    values = [None, None, 3.0, None, None, None, None, None, 8.0, None, None, None]
    df = spark.createDataFrame(list(enumerate(values)), "t long, value double")
    for ahead, behind, want in (
        (True, False, [None, None, 3, 3, 3, 3, 3, 3, 8, 8, 8, 8]),
        (False, True, [3, 3, 3, 8, 8, 8, 8, 8, 8, None, None, None]),
        (True, True, [3, 3, 3, 3, 3, 3, 3, 3, 8, 8, 8, 8]),
    ):
        got = series.fill_series(df.withColumn("seen", F.lit(1)), ahead, behind, slab=2).orderBy("t")
        assert [r["filled"] for r in got.collect()] == want and got.columns == ["t", "value", "seen", "filled"]
