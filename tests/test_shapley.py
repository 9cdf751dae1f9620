"""The Shapley kernel against all subsets of features, one by one."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortium.operators import explain, models


def expected(tree, x, known, at=0):
    """Prediction when only the features ``known`` are asked; others go both ways, by the share of training rows."""
    left, right, value, count, feature, cut, arity = tree[at]
    if left < 0:
        return value
    if feature in known:
        goes_left = x[feature] <= cut[0] if arity < 0 else x[feature] in cut
        return expected(tree, x, known, left if goes_left else right)
    return sum(expected(tree, x, known, c) * tree[c][3] / count for c in (left, right))


def by_subsets(trees, weights, x):
    n = len(x)
    value = {s: sum(w * expected(t, x, set(s)) for t, w in zip(trees, weights))
             for k in range(n + 1) for s in combinations(range(n), k)}
    return [sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)
                * (value[tuple(sorted({*s, i}))] - value[s]) for s in value if i not in s) for i in range(n)]


def random_tree(draw, features, depth):
    """Node table of a tree whose paths ask features again; feature 0 has categories."""
    tree = {}

    def grow(count, left_over):
        at = len(tree)
        tree[at] = None
        if left_over == 0 or count < 2 or draw.random() < 0.1:
            tree[at] = (-1, -1, float(draw.normal()), float(count), -1, [], -1)
            return at
        feature = int(draw.integers(features))
        cut, arity = ([0.0, 2.0], 4) if feature == 0 else ([float(draw.normal())], -1)
        first = int(draw.integers(1, count))
        left, right = grow(first, left_over - 1), grow(count - first, left_over - 1)
        tree[at] = (left, right, 0.0, float(count), feature, cut, arity)
        return at
    grow(10_000_000, depth)
    return tree


@pytest.mark.parametrize("features, depth", [(1, 3), (2, 5), (4, 4), (5, 9), (7, 6)])
def test_kernel_equals_all_subsets(features, depth):
    draw = np.random.default_rng(features * 10 + depth)
    trees, weights = [random_tree(draw, features, depth) for _ in range(3)], [0.5, 1.0, -0.25]
    x = draw.normal(size=(12, features))
    x[:, 0] = draw.integers(0, 4, size=12)
    found = explain.shapley_values(x, trees, weights)
    for row, phi in zip(x, found):
        assert phi == pytest.approx(by_subsets(trees, weights, row), abs=1e-9)


def test_a_single_leaf_and_no_rows():
    leaf = {0: (-1, -1, 3.0, 7.0, -1, [], -1)}
    assert explain.shapley_values(np.ones((2, 3)), [leaf], [1.0]).tolist() == [[0.0] * 3] * 2
    assert explain.shapley_values(np.ones((0, 3)), [leaf], [1.0]).shape == (0, 3)


@pytest.mark.parametrize("make", [lambda: models.forest(trees=5, depth=8), lambda: models.boosted(trees=5, depth=6, rate=0.3)])
def test_four_features_of_a_trained_model(spark, make):
    k = F.col("id")
    names = ["a", "b", "c", "d"]
    df = spark.range(400).select("id", *[(F.pmod(k * m, F.lit(97)) / 97.0).alias(n) for n, m in zip(names, (7, 31, 53, 89))])
    df = df.withColumn("label", 2 * F.col("a") * F.col("b") - F.col("c") + F.sin(6 * F.col("d")))
    df = df.withColumn("features", models.as_vector(names))
    model = make().fit(df)
    out = explain.contributions_trees(model.transform(df), model, names)
    total = F.col("base") + F.aggregate("factors", F.lit(0.0), lambda s, f: s + f["phi"])
    assert out.select(F.max(F.abs(total - F.col("prediction")))).first()[0] < 1e-9
    tables, weights = explain.tree_table(model)
    for r in out.where(k % 67 == 0).collect():
        phi = by_subsets(tables, weights, r["features"].toArray())
        assert [f["phi"] for f in r["factors"]] == pytest.approx(phi, abs=1e-9)
    assert out.where("id < 0").count() == 0
