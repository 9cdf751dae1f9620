"""Exact quantiles against numpy: brackets that meet, repeated values, groups, few rows."""

import numpy as np
import pytest

from cohortium.operators import quantiles


@pytest.mark.parametrize("values", [
    lambda rng: rng.normal(size=60_000), lambda rng: rng.integers(0, 4, 60_000).astype(float), lambda rng: np.full(500, 2.5),
    lambda rng: np.where(rng.random(60_000) < 0.4, 7.0, rng.normal(size=60_000) * 1e6), lambda rng: np.array([3.0, 1.0]),
    lambda rng: np.array([-4.0])], ids=["spread", "few values", "constant", "hot value", "two", "one"])
def test_quantiles_as_numpy_has_them(spark, monkeypatch, values):
    monkeypatch.setattr(quantiles, "ACCURACY", 400)  # wide brackets, of which neighbours overlap
    data = values(np.random.default_rng(6))
    probs = [0.0, 0.499, 0.5, 0.25, 0.75, 0.5025, 1.0, 0.99]
    df = spark.createDataFrame([(float(v), None if i % 7 == 0 else float(v) * 2) for i, v in enumerate(data)], "a double, b double")
    second = np.array([v * 2 for i, v in enumerate(data) if i % 7])
    for interpolate, method in ((True, "linear"), (False, "inverted_cdf")):
        got = {(r["column"], r["prob"]): r["quantile"] for r in quantiles.exact_quantiles(df, ["a", "b"], probs, interpolate=interpolate).collect()}
        for c, x in (("a", data), ("b", second)):
            for p in probs:
                if len(x):
                    assert got[c, p] == pytest.approx(np.quantile(x, p, method=method), rel=1e-12, abs=1e-12), (c, p)


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else int(g), float(v)) for g, v in zip(rng.integers(0, 4, 5000), rng.normal(size=5000))]
    df = spark.createDataFrame([*rows, (0, None), (9, None), (1, float("nan"))], "g int, a double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in quantiles.exact_quantiles(df, ["a"], [0.1, 0.5], by=["g"]).collect()}
    for g in (0, 1, 2, None):
        x = [v for h, v in rows if h == g]
        for p in (0.1, 0.5):
            assert got[g, p] == pytest.approx(np.quantile(x, p))
    assert all(g != 9 for g, _ in got)
