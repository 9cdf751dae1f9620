"""Grouped moments, the chained fill from moments by missing pattern, and out-of-fold lines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortium.operators import fill, models, moments


def frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.normal(1000, 3, n)
    data = pd.DataFrame({"id": range(n), "a": a, "b": 2 * a + rng.normal(size=n), "c": rng.normal(size=n) - a, "d": rng.normal(size=n), "g": rng.integers(0, 3, n)})
    for i, c in enumerate("abc"):
        data.loc[rng.random(n) < 0.1 + 0.1 * i, c] = np.nan
    return data, spark.createDataFrame(data).replace(float("nan"), None).select(
        "id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcd"), "g").repartition(7)


def test_moments_by_group_equal_numpy(spark):
    data, df = frame(spark)
    whole = data.dropna()
    made = moments.moment_groups(df.dropna(), F.array(*"abcd"), [1000, 2000, -1000, 0], [F.col("g")])
    for (g,), matrix in made.items():
        z = np.column_stack([np.ones((whole.g == g).sum()), whole[whole.g == g][list("abcd")] - [1000, 2000, -1000, 0]])
        assert np.allclose(matrix, z.T @ z)
    n, mean, spread = moments.centred(sum(made.values()), np.array([1000, 2000, -1000, 0]))
    assert n == len(whole) and np.allclose(mean, whole[list("abcd")].mean()) and np.allclose(spread / (n - 1), whole[list("abcd")].cov())
    assert moments.moment_groups(df.limit(0), F.array("d"), [0.0]) == {}


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_chained_lines_equal_the_rounds(spark, alpha, monkeypatch):
    _, df = frame(spark)
    fast = fill.fill_chained(df, list("abcd"), rounds=4, learner="ridge", alpha=alpha, tol=1e-7).toPandas().set_index("id").sort_index()
    monkeypatch.setattr(fill, "MAX_MAP_VALUES", 0)
    slow = fill.fill_chained(df, list("abcd"), rounds=4, learner="ridge", alpha=alpha, tol=1e-7).toPandas().set_index("id").sort_index()
    assert np.allclose(fast, slow, rtol=1e-9, atol=1e-6) and not fast.isna().any().any()


def test_chained_lines_stop_where_the_rounds_do(spark, monkeypatch):
    _, df = frame(spark, 200)
    made = [fill.fill_chained(df, list("abcd"), rounds=9, learner="ridge", tol=1e-4).toPandas().set_index("id").sort_index()]
    monkeypatch.setattr(fill, "MAX_MAP_VALUES", 0)
    made.append(fill.fill_chained(df, list("abcd"), rounds=9, learner="ridge", tol=1e-4).toPandas().set_index("id").sort_index())
    assert np.allclose(*made, rtol=1e-9, atol=1e-6)


def test_lines_of_all_folds_equal_fits_on_the_rest(spark):
    _, df = frame(spark)
    ready = df.dropna().withColumn("features", models.as_vector(["a", "d"])).withColumn("label", F.col("b"))
    bases = {"ridge": models.LinearFamily("ridge", 1.0), "lasso": models.LinearFamily("lasso", 0.01), "bayes": models.BayesianLine()}
    oof = models.out_of_fold(ready, bases, "id", 4)
    assert oof.count() == ready.count()
    for f in range(4):
        held = oof.where(F.col("fold") == f)
        for name, base in bases.items():
            alone = base.fit(oof.where(F.col("fold") != f).select("features", "label"))
            far = alone.transform(held.drop("prediction")).agg(F.max(F.abs(F.col("prediction") - F.col(f"base_{name}")))).first()[0]
            assert far < 1e-6
