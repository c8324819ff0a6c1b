import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions import kernels, special

CASES = [(c, k) for c, kinds in kernels.TYPES.items() if c != "nugget" for k in kinds]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    up = rng.uniform(0, 2000, (60, 2))
    connected = rng.random(60) < 0.5
    a = np.where(connected, np.abs(up[:, 0] - up[:, 1]), up.max(axis=1))
    b = np.where(connected, 0.0, up.min(axis=1))
    a[0] = b[0] = 0.0
    w = np.where(b == 0, rng.uniform(0.1, 1, 60), 0.0)
    w[0] = 1.0
    e = rng.uniform(0, 1500, 60)
    e[0] = 0.0
    arrays = {"h": a + b, "a": a, "b": b, "w": w, "mask": np.ones(60), "e": e}
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(*arrays.values(), strict=True)], ", ".join(f"{k} double" for k in arrays)).cache()
    return arrays, rows


@pytest.mark.parametrize(("component", "kind"), CASES)
def test_columns_and_arrays_agree(pairs, component, kind):
    arrays, rows = pairs
    r = 0.01 if kind == "jbessel" else 900.0
    array = kernels.covariance(component, kind, kernels.Pair(**arrays), 2.0, r, kernels.InArrays)
    column = kernels.covariance(component, kind, kernels.Pair(**{k: F.col(k) for k in arrays}), 2.0, r)
    found = np.array([x[0] for x in rows.select(column).collect()])
    assert np.allclose(found, array, atol=1e-12)
    assert array[0] == pytest.approx(0.0 if kind == "none" else 2.0)


def test_special_functions():
    assert special.bessel_j0(np.array([0.0, 1.0, 2.404825557695773, 50.0])) == pytest.approx([1, 0.7651976865579666, 0, 0.05581232766925181], abs=1e-12)
    assert special.digamma(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -1.9635100260214235])
    assert special.trigamma(np.array([1.0, 0.5])) == pytest.approx([np.pi**2 / 6, np.pi**2 / 2])
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)
    assert special.norm_cdf(1.959963984540054) == pytest.approx(0.975)
