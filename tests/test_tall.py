"""Linear algebra of tall tables against dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.operators import adapt, ridge, tall


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 5, 1200)
    x = rng.normal(size=(1200, 30)) @ np.diag(np.linspace(3, 0.2, 30)) + np.eye(30)[y] * 2
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id int, y int, features array<double>")
    return df.repartition(7).cache(), x, y


def angle(a, b):
    """The sine of the greatest angle between two spaces."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.linalg.norm(qa - qb @ (qb.T @ qa), 2)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_triangle(rows, fan_in):
    df, x, _ = rows
    r = tall.triangle(df, "features", fan_in)
    assert r.shape == (30, 30) and np.allclose(r.T @ r, x.T @ x)
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(x)[1], rtol=1e-12)
    assert tall.triangle(df.limit(0), "features") is None
    few = tall.triangle(df.where("id < 3"), "features")
    assert np.allclose(few.T @ few, x[:3].T @ x[:3])


@pytest.mark.parametrize("by_accuracy", [False, True])
def test_ridge_leaves_every_row_out(rows, by_accuracy):
    df, x, y = rows
    for some, keep in ((df, slice(None)), (df.where("id < 25"), slice(0, 25))):
        a = ridge.fit_rows(some, alphas=ridge.FINE_ALPHAS, by_accuracy=by_accuracy)
        b = ridge.fit(x[keep], y[keep], ridge.FINE_ALPHAS, by_accuracy)
        assert a.alpha == b.alpha and (a.classes == b.classes).all()
        assert np.allclose(a.decide(x), b.decide(x), rtol=1e-8, atol=1e-8)


def test_principal_axes(rows):
    df, x, _ = rows
    mean, values, axes = tall.principal(df, "features", 6)
    dense, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(values, dense[::-1][:6], rtol=1e-9)
    assert angle(axes, vectors[:, ::-1][:, :6]) < 1e-6 and np.allclose(axes.T @ axes, np.eye(6), atol=1e-9)


def test_axes_beyond_the_rank_are_left_out(spark):
    base = np.random.default_rng(1).normal(size=(40, 3)) @ np.random.default_rng(2).normal(size=(3, 12))
    df = spark.createDataFrame([(v.tolist(),) for v in base], "features array<double>").repartition(3)
    _, values, axes = tall.principal(df, "features", 8)
    assert len(values) == axes.shape[1] and (values[3:] < 1e-9).all() and angle(axes[:, :3], np.linalg.svd(base - base.mean(axis=0))[2][:3].T) < 1e-6


def test_transfer_components_without_a_kernel(rows):
    """Equal to the dense answer: the same space, each axis up to its sign."""
    df, x, _ = rows
    source, target = df.where("id < 800"), df.where("id >= 800").withColumn("features", F.transform("features", lambda v: v + 1))
    moved = x[800:] + 1
    mean, sd, w = adapt.transfer_components(x[:800], moved, 6, 1.0)
    for dense in (1024, 10):
        m, s, found = adapt.transfer_axes(source, target, "features", 6, 1.0, dense=dense)
        assert np.allclose(mean, m) and np.allclose(sd, s) and angle(found, w) < 1e-6
        a, b = ((x[:800] - mean) / sd @ v for v in (w, found))
        assert np.allclose(np.abs((a * b).sum(axis=0)), np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=0), rtol=1e-6)
    top = adapt._leading(np.eye(4), np.diag([3.0, 1.0, 4.0, 2.0]), 2)
    assert np.allclose(top, np.eye(4)[:, [0, 2]])  # the two greatest, ascending


def test_axes_of_either_way_agree(rows):
    df, _, _ = rows
    (_, a), (_, b) = (adapt.principal_axes(df, "features", 5, dense) for dense in (1024, 10))
    assert np.allclose(a, b, atol=1e-6)


def test_gaussian_kernel_without_the_kernel(spark):
    """Median and weights without any matrix of all pairs equal the dense solution."""
    rng = np.random.default_rng(5)
    source, target = rng.normal(size=(431, 6)) * [5, 4, 3, 2, 1.5, 1], rng.normal(size=(240, 6)) + 1
    source[7] = source[6]  # a distance of zero counts not
    dense = adapt.gaussian_components(source, target, 5, 1.0)
    tiled = adapt.kernel_axes(spark, source, target, 5, 1.0, tile=100)
    assert abs(tiled[3] - dense[3]) < 1e-12 * dense[3]
    assert np.abs(tiled[4] - dense[4]).max() < 1e-6 * np.abs(dense[4]).max()
