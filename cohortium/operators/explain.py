"""Additive contributions and everything that is read from them.

A record keeps its contributions in one array column ``factors`` of (feature, source, value, phi).
The array is as long as the feature list, so per-record work (top factors, waterfall, guardrail)
is narrow: array functions, no shuffle. Only statistics over records explode it.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules
from ..functions import interpretation, readable_name
from ..session import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def source_columns(features: list[str], columns: list[str]) -> dict[str, str | None]:
    """Input column of each encoded feature: the longest column name the feature starts with."""
    return {f: max((c for c in columns if f.startswith(c)), key=len, default=None) for f in features}


def contributions_linear(df: DataFrame, coefficients: dict[str, float], means: dict[str, float],
                         intercept: float) -> DataFrame:
    """Adds ``base`` and ``factors``: phi = beta * (x - mean), base = prediction at the means."""
    base = intercept + sum(b * means[f] for f, b in coefficients.items())
    factors = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(f).alias("source"), F.col(f).cast("double").alias("value"),
                 (F.lit(float(b)) * (F.col(f) - F.lit(float(means[f])))).alias("phi"))
        for f, b in coefficients.items()])
    return df.withColumn("base", F.lit(float(base))).withColumn("factors", factors)


def tree_table(model) -> tuple[list, list[float]]:
    """Nodes and weights of a saved Spark tree ensemble. As large as the model, not as the data."""
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict] = {}
    for r in rows:
        split = r["split"]
        trees.setdefault(r["treeID"], {})[r["id"]] = (
            r["leftChild"], r["rightChild"], float(r["prediction"]), float(r["rawCount"]), split["featureIndex"],
            list(split["leftCategoriesOrThreshold"]), split["numCategories"])
    weights = [float(w) for w in model.treeWeights]
    if "Forest" in type(model).__name__:
        weights = [w / len(weights) for w in weights]
    return [trees[i] for i in sorted(trees)], weights


def _expected(tree: dict) -> float:
    """Mean prediction of a tree over the rows it was trained on."""
    total, pending = 0.0, [(0, 1.0)]
    while pending:
        at, share = pending.pop()
        left, right, value, count, *_ = tree[at]
        if left < 0:
            total += share * value
        else:
            pending += [(child, share * tree[child][3] / count) for child in (left, right)]
    return total


@cache
def _gauss(points: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights on [0, 1], as columns."""
    at, weight = np.polynomial.legendre.leggauss(points)
    return (at[:, None] + 1) / 2, weight[:, None] / 2


def _leaf_terms(shares: list[float], codes: np.ndarray) -> list[np.ndarray]:
    """What a leaf of value 1 adds to each feature of its path, for each code; bit j says that a row meets the j-th feature's tests.

    A subset of k of the other d - 1 features weighs k! (d-1-k)! / d!, the integral of t^k (1-t)^(d-1-k) over [0, 1]. So the
    sum over subsets is the integral of the product over the others of share (1-t) + met t, which half as many Gauss points
    give exactly. The product of all features is made once; each feature's own factor is divided out again.
    """
    t, portions = _gauss(max(1, -(-len(shares) // 2)))
    bits = [(codes >> j) & 1 for j in range(len(shares))]
    factors = [np.hstack([share * (1 - t), share * (1 - t) + t]) for share in shares]
    product = np.repeat(portions, len(codes), axis=1)
    for factor, bit in zip(factors, bits):
        product *= factor.take(bit, axis=1)
    met = np.array([0.0, 1.0])
    return [(((met - share) / factor).take(bit, axis=1) * product).sum(axis=0) for share, factor, bit in zip(shares, factors, bits)]


def shapley_values(x: np.ndarray, trees: list[dict], weights: list[float]) -> np.ndarray:
    """Path-dependent Shapley values of weighted trees, one row per row of ``x``.

    The walk goes down node by node with one code per row (see ``_leaf_terms``). Rows of one code get the same terms from a
    leaf, so terms are made for all codes, or for the rows where those are fewer: depth^2 per code, depth per row. Memory
    is the depth times the rows, whatever the number of nodes.
    """
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros_like(columns)

    def walk(tree: dict, at: int, weight: float, path: dict[int, float], code: np.ndarray) -> None:
        left, right, value, count, feature, cut, arity = tree[at]
        if left < 0:
            listed = np.arange(1 << len(path)) if 1 << len(path) < len(code) else None
            terms = _leaf_terms(list(path.values()), code if listed is None else listed)
            for f, term in zip(path, terms):
                term *= value * weight
                phi[f] += term if listed is None else term.take(code)
            return
        v = columns[feature]
        goes_left = v <= cut[0] if arity < 0 else np.isin(v, cut)
        bit = list(path).index(feature) if feature in path else len(path)
        # a feature that is new to the path counts as met so far
        code, share = (code, path[feature]) if feature in path else (code | (1 << bit), 1.0)
        for child, goes in ((left, goes_left), (right, ~goes_left)):
            walk(tree, child, weight, {**path, feature: share * tree[child][3] / count}, np.where(goes, code, code & ~(1 << bit)))

    for tree, weight in zip(trees, weights):
        walk(tree, 0, weight, {}, np.zeros(len(x), np.intp))
    return phi.T


def contributions_trees(df: DataFrame, model, names: list[str], columns: list[str] | None = None,
                        features: str = "features") -> DataFrame:
    """Adds ``base`` and ``factors`` for a forest or boosted model: base + sum of phi = prediction."""
    tables, weights = tree_table(model)
    base = sum(w * _expected(t) for t, w in zip(tables, weights))
    shared = df.sparkSession.sparkContext.broadcast((tables, weights))

    @F.pandas_udf("array<double>")
    def phis(x: pd.Series) -> pd.Series:
        rows = np.array(x.tolist(), dtype=float).reshape(len(x), len(names))
        return pd.Series(list(shapley_values(rows, *shared.value)))

    source = source_columns(names, columns or names)
    labels = F.array(*[F.lit(n) for n in names])
    origins = F.array(*[F.lit(source[n]) for n in names])
    made = df.withColumn("_v", vector_to_array(features)).withColumn("_p", phis("_v"))
    known = [c for c in (columns or []) if c in df.columns]
    kinds = dict(df.dtypes)
    originals = {c: F.col(c).try_cast("double") if kinds[c] == "string" else F.col(c).cast("double") for c in known}
    values = F.array(*[originals.get(source[n], F.col("_v")[i]) for i, n in enumerate(names)])
    factors = F.transform("_p", lambda p, i: F.struct(
        F.get(labels, i).alias("feature"), F.get(origins, i).alias("source"), F.get(values, i).alias("value"),
        p.alias("phi")))
    return made.withColumn("base", F.lit(float(base))).withColumn("factors", factors).drop("_v", "_p")


def explainable(models: dict):
    """(name, model) to explain: the first that is a single tree model, not an ensemble of ensembles."""
    for name, model in models.items():
        if hasattr(model, "treeWeights"):
            return name, model
    raise ValueError("no tree model to explain")


def spread_array(df: DataFrame, keep: list[str], array: str | Column) -> DataFrame:
    """One row per array element. The outer form with a test on the element itself: for the inner form the
    optimizer adds a test on the array, which would compute the whole array once more."""
    return df.select(*keep, F.inline_outer(array)).where(F.col("feature").isNotNull())


def long_factors(df: DataFrame, keep: list[str]) -> DataFrame:
    return spread_array(df, keep, "factors")


def importance(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by…, feature, mean_abs, rank). The window runs over one row per feature."""
    mean = long_factors(df, list(by)).groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    order = Window.partitionBy(*by).orderBy(F.desc("mean_abs"), "feature")
    return mean.withColumn("rank", F.row_number().over(order))


def by_size(factors: str | Column = "factors") -> Column:
    """Factors by descending size; equal ones by feature name."""
    keyed = F.transform(factors, lambda f: F.struct((-F.abs(f["phi"])).alias("o"), f["feature"].alias("n"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def waterfall(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, step, feature, phi, running): total after each factor, starting from the base value."""
    ordered = df.withColumn("_o", by_size())
    steps = F.transform("_o", lambda f, i: F.struct(
        (i + 1).alias("step"), f["feature"].alias("feature"), f["phi"].alias("phi"),
        F.aggregate(F.slice("_o", 1, i + 1), F.col("base"), lambda a, g: a + g["phi"]).alias("running")))
    return spread_array(ordered, keep, steps)


def hidden(f: Column, table: list[tuple] = rules.GUARDRAIL_RULES) -> Column:
    """Whether a factor may not be shown: no effect, no value, or a direction its rule forbids."""
    feature, value, phi = f["feature"], f["value"], f["phi"]
    up, down = phi > 0, phi < 0
    result = F.when((phi == 0) | phi.isNull() | value.isNull() | F.isnan(value), True)
    for prefix, test, threshold, forbidden in table:
        if test == "always":
            bad = F.lit(True)
        elif test == "yes_no":
            bad = ((value == 0) & up) | ((value == 1) & down)
        else:
            beyond = value > threshold if test == ">" else value >= threshold
            bad = beyond & (down if forbidden == "decrease" else up)
        result = result.when(feature.startswith(prefix), bad)
    return result.otherwise(False)


def guardrail(df: DataFrame, table: list[tuple] = rules.GUARDRAIL_RULES) -> DataFrame:
    """Drops forbidden factors from ``factors``."""
    return df.withColumn("factors", F.filter("factors", lambda f: ~hidden(f, table)))


def top_factors(df: DataFrame, k: int = 10, pin: str | None = None, pin_at: int = 3,
                names: dict = rules.READABLE_NAMES) -> DataFrame:
    """Adds ``top``: the k largest factors with place, direction, sentence and share of the largest.

    A factor whose feature starts with ``pin`` and that ranks below place ``pin_at`` moves up to it.
    """
    # sorted once; the largest is the first before anything moves
    out = df.withColumn("_t", F.slice(by_size(), 1, k)).withColumn("_big", F.abs(F.get("_t", F.lit(0))["phi"]))
    if pin:
        at = F.array_position(F.transform("_t", lambda f: f["feature"].startswith(pin)), True)
        moved = F.concat(F.slice("_t", 1, pin_at - 1), F.slice("_t", F.col("_at"), F.lit(1)),
                         F.slice("_t", F.lit(pin_at), F.greatest(F.col("_at") - pin_at, F.lit(0))),
                         F.slice("_t", F.col("_at") + 1, F.lit(k)))
        out = out.withColumn("_at", at.cast("int"))
        out = out.withColumn("_t", F.when(F.col("_at") > pin_at, moved).otherwise(F.col("_t"))).drop("_at")
    told = F.transform("_t", lambda f, i: F.struct(
        (i + 1).alias("place"), f["feature"].alias("feature"), F.round(f["phi"], 4).alias("impact"),
        F.when(f["phi"] > 0, "Increases HbA1c").otherwise("Reduces HbA1c").alias("direction"),
        interpretation(readable_name(f["feature"], names), f["phi"]).alias("interpretation"),
        F.try_divide(F.abs(f["phi"]) * 100, F.col("_big")).alias("share")))
    return out.withColumn("top", told).drop("_t", "_big")


def dependence(df: DataFrame, ranked: list[str], keep: list[str], top: int = 3) -> DataFrame:
    """(keep…, feature, value, phi, colour_feature, colour_value) for the leading features.

    The colour is the next one of the leading features; the last has none.
    """
    names = ranked[:top]
    colour = {n: names[i + 1] if i + 1 < len(names) else None for i, n in enumerate(names)}

    def value_of(name):
        return F.get(F.filter("factors", lambda f: f["feature"] == name), F.lit(0))
    points = [F.struct(F.lit(n).alias("feature"), value_of(n)["value"].alias("value"), value_of(n)["phi"].alias("phi"),
                       F.lit(c).cast("string").alias("colour_feature"),
                       (value_of(c)["value"] if c else F.lit(None).cast("double")).alias("colour_value"))
              for n, c in colour.items()]
    return df.select(*keep, F.inline(F.array(*points)))


def beeswarm(df: DataFrame, keep: list[str], top: int = 20) -> DataFrame:
    """(keep…, feature, value, scaled, phi): values scaled to 0–1 within each of the leading features."""
    long = long_factors(df, keep)
    facts = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                                        F.avg(F.abs("phi")).alias("size"))
    place = F.row_number().over(Window.orderBy(F.desc("size"), "feature"))
    leading = facts.withColumn("place", place).where(F.col("place") <= top)
    # one row per feature, at most ``top``
    met = long.join(F.broadcast(leading), "feature")
    scaled = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    return met.select(*keep, "feature", "value", F.coalesce(scaled, F.lit(0.5)).alias("scaled"), "phi")


def run_summary(explained: dict[str, DataFrame]) -> DataFrame:
    """One row per explained model: records, features, expected value."""
    from functools import reduce
    rows = [df.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("records"),
                   F.max(F.size("factors")).alias("features"), F.avg("base").alias("expected_value"))
            for name, df in explained.items()]
    return reduce(DataFrame.unionByName, rows)
