"""Image kernels against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from tabulon.operators import arrays as X


def stack(spark, x):
    return spark.createDataFrame([(i, v.shape[0], v.shape[1], [float(p) for p in v.ravel()], i % 2) for i, v in enumerate(x)], X.IMAGE + ", grp int")


def test_kernels(spark):
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(8, 8)).astype(np.float32) for _ in range(6)]
    df = stack(spark, x)
    power = {(r.id, r.shell): r.power for r in X.power_spectra(df).collect()}
    r = X.radii(8, 8)
    assert all(abs(power[i, s] - (np.abs(np.fft.fft2(x[i].astype(float))) ** 2)[r == s].mean()) < 1e-6 * (1 + power[i, s]) for i in range(6) for s in range(r.max() + 1))
    same = {v.id: np.array(v.pixels) for v in X.filtered(df, X.low_pass(100)).collect()}
    assert all(np.allclose(same[i], x[i].ravel(), atol=1e-5) for i in range(6))
    flat = {v.id: np.array(v.pixels) for v in X.filtered(df, X.low_pass(0.4, 0.2)).collect()}
    assert all(np.allclose(flat[i], x[i].mean(), atol=1e-5) for i in range(6))
    mean = {v.grp: np.array(v.pixels) for v in X.averages(df, "grp").collect()}
    assert np.allclose(mean[1], np.mean(x[1::2], axis=0).ravel(), atol=1e-6)
    got = {v.id: v.r for v in X.pearson_to(df, x[0].ravel().tolist()).collect()}
    assert all(abs(got[i] - np.corrcoef(x[0].ravel(), x[i].ravel())[0, 1]) < 1e-6 for i in range(6))


def test_sizes_may_differ(spark):
    df = stack(spark, [np.ones((4, 4)), np.ones((6, 2)), np.zeros((4, 4))])
    assert X.filtered(df, X.low_pass(3)).count() == 3
    assert X.pearson_to(df.where("id = 2"), [0.0] * 16).first().r == 0.0
    assert X.power_spectra(df).where((F.col("shell") > 0) & (F.abs("power") > 1e-9)).count() == 0


def test_shell_correlation():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(16, 16))
    assert np.allclose(X.shell_correlation(a, a), 1) and np.allclose(X.shell_correlation(a, -a), -1)
    assert abs(X.shell_correlation(a, rng.normal(size=(16, 16)))[3:9]).mean() < 0.5
