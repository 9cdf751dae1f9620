"""Regressors, stacking and model search on Spark ML."""

from __future__ import annotations

import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Estimator
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .moments import centred, moment_groups
from .neighbours import NeighbourRegressor
from .transform import add_fold
from .trees import Boosted, Forest

FITS_AT_ONCE = 4

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def moments(df: DataFrame, features: str, label: str, by: list[str] = ()) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Per group of the columns ``by``: (moment matrix of (features…, label), its shift), in one distributed pass.

    All are shifted by one row of the data, so that large means cost no digits.
    """
    ready = df.where(F.col(label).isNotNull())
    values = F.concat(vector_to_array(features), F.array(F.col(label).cast("double")))
    first = ready.select(values.alias("v")).head()
    if first is None:
        raise ValueError("no row has a label to fit to")
    shift = np.array(first["v"])
    return {group: (matrix, shift) for group, matrix in moment_groups(ready, values, shift, [F.col(c) for c in by]).items()}


def moments_of_all(df: DataFrame, features: str, label: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred products) of (features…, label) over all rows."""
    return centred(*moments(df, features, label)[()])


class FixedLine:
    """A line with given coefficients; ``transform`` adds ``prediction`` without leaving the JVM."""

    def __init__(self, coefficients, intercept, features="features"):
        self.coefficients, self.intercept, self.features = [float(c) for c in coefficients], float(intercept), features

    def transform(self, df: DataFrame) -> DataFrame:
        terms = F.zip_with(vector_to_array(self.features), F.array(*[F.lit(c) for c in self.coefficients]),
                           lambda a, b: a * b)
        return df.withColumn("prediction", F.aggregate(terms, F.lit(self.intercept), lambda a, b: a + b))

    def save(self, spark, path: str) -> None:
        row = spark.createDataFrame([(self.coefficients, self.intercept, self.features)],
                                    "coefficients array<double>, intercept double, features string")
        row.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "FixedLine":
        return FixedLine(*spark.read.parquet(path).select("coefficients", "intercept", "features").first())


class LinearFamily:
    """Ridge, lasso or elastic net with the usual penalties, on standardised features.

    The data is read once, for its moment matrix; the small system that is left is solved on the
    driver (ridge directly, the others by cycling over the coefficients).
    """

    def __init__(self, kind: str = "ridge", alpha: float = 1.0, l1_ratio: float = 0.5,
                 features: str = "features", label: str = "label", rounds: int = 1000, tol: float = 1e-10):
        self.kind, self.alpha, self.l1_ratio = kind, alpha, l1_ratio
        self.features, self.label, self.rounds, self.tol = features, label, rounds, tol

    def fit(self, df: DataFrame) -> FixedLine:
        return self.solve(*moments_of_all(df, self.features, self.label))

    def solve(self, n: int, mean: np.ndarray, spread: np.ndarray) -> FixedLine:
        """The line for given rows, means and centred products."""
        scale = np.sqrt(np.diag(spread)[:-1] / n)
        scale[scale == 0] = 1.0
        xx, xy = spread[:-1, :-1] / np.outer(scale, scale), spread[:-1, -1] / scale
        if self.kind == "ridge":
            beta = np.linalg.lstsq(xx + self.alpha * np.eye(len(xy)), xy, rcond=None)[0]
        else:
            share = 1.0 if self.kind == "lasso" else self.l1_ratio
            first, second = n * self.alpha * share, n * self.alpha * (1 - share)
            beta = np.zeros(len(xy))
            for _ in range(self.rounds):
                before = beta.copy()
                for j in np.flatnonzero(np.diag(xx) > 0):
                    pull = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
                    beta[j] = np.sign(pull) * max(abs(pull) - first, 0.0) / (xx[j, j] + second)
                if np.abs(beta - before).max() < self.tol:
                    break
        beta = beta / scale
        return FixedLine(beta, mean[-1] - beta @ mean[:-1], self.features)


class BayesianLine:
    """Bayesian ridge: both precisions by evidence iteration on the moment matrix, which is one distributed pass."""

    def __init__(self, features="features", label="label", rounds: int = 300, tol: float = 1e-3):
        self.features, self.label, self.rounds, self.tol = features, label, rounds, tol

    def fit(self, df: DataFrame) -> FixedLine:
        return self.solve(*moments_of_all(df, self.features, self.label))

    def solve(self, n: int, mean: np.ndarray, spread: np.ndarray) -> FixedLine:
        """The line for given rows, means and centred products."""
        xx, xy, yy = spread[:-1, :-1], spread[:-1, -1], spread[-1, -1]
        values, vectors = np.linalg.eigh(xx)
        values = np.clip(values, 0, None)
        turned = vectors.T @ xy
        tiny = 1e-6
        noise, weight = n / (yy + 1e-12), 1.0
        beta = np.zeros(len(xy))
        for _ in range(self.rounds):
            new = vectors @ (turned / (values + weight / noise))
            error = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
            known = np.sum(noise * values / (weight + noise * values))
            weight = (known + 2 * tiny) / (new @ new + 2 * tiny)
            noise = (n - known + 2 * tiny) / (error + 2 * tiny)
            moved = np.abs(new - beta).sum()
            beta = new
            if moved < self.tol:
                break
        return FixedLine(beta, mean[-1] - beta @ mean[:-1], self.features)


def forest(trees: int = 200, depth: int = 15, features="features", label="label", seed=42) -> Forest:
    """Spark bounds tree depth at 30; the default is lower because node tables grow as 2^depth."""
    return Forest(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def boosted(trees: int = 200, depth: int = 4, rate: float = 0.05, features="features", label="label", seed=42):
    return Boosted(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)


def boosted_sampled(trees: int = 300, depth: int = 6, rate: float = 0.05, features="features", label="label", seed=42):
    """Row and column sampling per tree. Leaf penalties have no counterpart in Spark ML."""
    return Boosted(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate,
                   subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=seed)


def default_bases(label: str = "label", key: str | None = None) -> dict:
    """The usual base models; with a key also the nearest rows."""
    nearest = {"nearest": NeighbourRegressor("features", label, key)} if key else {}
    return {
        "ridge": LinearFamily("ridge", 1.0, label=label),
        "lasso": LinearFamily("lasso", 0.01, label=label),
        "elastic": LinearFamily("elastic", 0.01, 0.5, label=label),
        "bayesian": BayesianLine(label=label),
        "forest": forest(label=label),
        "boosted": boosted(label=label),
        "boosted_sampled": boosted_sampled(label=label),
        **nearest,
    }


def _predict(model, df: DataFrame, name: str) -> DataFrame:
    """Adds the model's prediction as ``name`` and nothing else."""
    keep = [c for c in df.columns if c != "prediction"]
    return model.transform(df.select(*keep)).select(*keep, F.col("prediction").cast("double").alias(name))


class Stack:
    """Base models, their meta model, and the out-of-fold frame the meta model was trained on."""

    def __init__(self, bases: dict, meta, oof: DataFrame | None = None):
        self.bases, self.meta, self.oof = bases, meta, oof

    def base_predictions(self, df: DataFrame) -> DataFrame:
        for name, model in self.bases.items():
            df = _predict(model, df, f"base_{name}")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != "prediction"]
        made = VectorAssembler(inputCols=[f"base_{n}" for n in self.bases], outputCol="_meta").transform(
            self.base_predictions(df.select(*keep)))
        return self.meta.transform(made).select(*keep, *[f"base_{n}" for n in self.bases], "prediction")


def out_of_fold(df: DataFrame, bases: dict, key: str, folds: int = 5, hashed: bool = True) -> DataFrame:
    """Each row once, with one prediction per base from models that never saw its fold.

    All folds of all linear bases come from one pass: a fold's training moments are those of all rows less its own.
    """
    folded = stage(add_fold(df, key, folds, hashed), "folds")
    return fold_predictions(folded, bases, fold_models(folded, bases, folds), folds)


def fold_models(folded: DataFrame, bases: dict, folds: int) -> dict:
    """Models by (base, fold) that never saw the fold; linear ones also by (base, None), from all rows."""
    rest = [folded.where(F.col("fold") != f) for f in range(folds)]
    fitted = fit_lines(folded, bases, folds)
    work = [(name, f) for f in range(folds) for name in bases if (name, f) not in fitted]
    return fitted | dict(zip(work, fit_all([(bases[name], rest[f]) for name, f in work])))


def fold_predictions(folded: DataFrame, names, fitted: dict, folds: int) -> DataFrame:
    """Each row once, with ``base_<name>`` by the model that never saw its fold."""
    parts = []
    for f in range(folds):
        held = folded.where(F.col("fold") == f)
        for name in names:
            held = _predict(fitted[name, f], held, f"base_{name}")
        parts.append(held)
    return reduce(DataFrame.unionByName, parts)


def fit_lines(folded: DataFrame, bases: dict, folds: int) -> dict:
    """Lines by (base, fold) that never saw the fold, and by (base, None) from all rows; one pass for bases of equal columns."""
    fitted, read = {}, {}
    for name, base in bases.items():
        if not hasattr(base, "solve"):
            continue
        columns = base.features, base.label
        if columns not in read:
            read[columns] = moments(folded, *columns, by=["fold"])
        groups = read[columns]
        shift = next(iter(groups.values()))[1]
        whole = sum(matrix for matrix, _ in groups.values())
        for f in [None, *range(folds)]:
            rest = whole - groups[f,][0] if (f,) in groups and f is not None else whole
            if round(rest[0, 0]) < 1:
                raise ValueError("a fold has all rows that have a label")
            fitted[name, f] = base.solve(*centred(rest, shift))
    return fitted


def fit_all(work: list[tuple]) -> list:
    """Models of (estimator, frame) pairs, a few fits at a time: each alone seldom keeps a cluster busy."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda pair: pair[0].fit(pair[1]), work))


def fit_stack(df: DataFrame, bases: dict, meta=None, folds: int = 5, key: str = "key", label: str = "label",
              hashed: bool = True) -> Stack:
    """Out-of-fold predictions train the meta model; the bases are then fitted again on all rows."""
    oof = out_of_fold(df, bases, key, folds, hashed)
    made = VectorAssembler(inputCols=[f"base_{n}" for n in bases], outputCol="_meta").transform(oof)
    made = stage(made, "oof")
    meta = meta or LinearFamily("ridge", 1.0, features="_meta", label=label)
    fitted = meta.fit(made)
    return Stack(dict(zip(bases, fit_all([(base, df) for base in bases.values()]))), fitted, made)


def search(df: DataFrame, estimator: Estimator, grid: dict, key: str, folds: int = 10, metric: str = "mae",
           label: str = "label", parallelism: int = 4, hashed: bool = True):
    """(best model, leaderboard): cross-validated grid search, leaderboard sorted by the metric."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, numFolds=folds, foldCol="fold",
                        evaluator=RegressionEvaluator(labelCol=label, metricName=metric), parallelism=parallelism)
    fitted = cv.fit(add_fold(df, key, folds, hashed))
    rows = [(", ".join(f"{p.name}={v}" for p, v in m.items()), float(score))
            for m, score in zip(maps, fitted.avgMetrics)]
    board = df.sparkSession.createDataFrame(rows, f"model string, cv_{metric} double").orderBy(f"cv_{metric}", "model")
    return fitted.bestModel, board


@dataclass
class Race:
    """The board (best first), the winner's name and its model, fitted to all rows."""
    board: DataFrame
    winner: str
    model: object


def race(df: DataFrame, families: dict[str, list], key: str, folds: int = 5, rounds: int = 5, tolerance: float = 0.001,
         stack_of: int = 10, meta=None, label: str = "label", hashed: bool = True) -> Race:
    """Families of estimators searched side by side by cross-validated mean absolute error, their stack on the same board.

    ``families`` lists each family's estimators in the order to try. A round fits the next one of every family that is still
    in the race, all folds at once; a family leaves it when its last ``rounds`` estimators did not lower its error by the
    share ``tolerance``. The best of each family, ``stack_of`` at most, are stacked on the predictions that they made out of
    fold; the stack wins only if it is strictly better. Lines are named family_number (from 1). A family without estimators
    has no line; rows without a label take no part; folds and the table with them are written once.
    """
    folded = stage(add_fold(df.where(F.col(label).isNotNull()), key, folds, hashed), "folds")
    tried: dict[str, list[float]] = {family: [] for family in families}
    fitted, estimators = {}, {}

    def errors(frame: DataFrame, columns: dict[str, str]) -> dict[str, float]:
        """Mean over folds of each column's error, all of them in one pass."""
        found = frame.groupBy("fold").agg(*[F.avg(F.abs(F.col(label) - F.col(c))).alias(c) for c in columns.values()]).collect()
        return {name: sum(r[c] for r in found) / len(found) for name, c in columns.items()}

    def in_race(family: str) -> bool:
        past = tried[family]
        stuck = len(past) > rounds and min(past[-rounds:]) > min(past[:-rounds]) * (1 - tolerance)
        return len(past) < len(families[family]) and not stuck

    while running := [family for family in families if in_race(family)]:
        now = {f"{family}_{len(tried[family]) + 1}": families[family][len(tried[family])] for family in running}
        made = fold_models(folded, now, folds)
        found = errors(fold_predictions(folded, now, made, folds), {name: f"base_{name}" for name in now})
        for family, (name, error) in zip(running, found.items()):
            best_before = min(tried[family], default=float("inf"))
            tried[family].append(error)
            if error < best_before:  # only the best of a family is needed again
                fitted = {at: model for at, model in fitted.items() if at[0].rpartition("_")[0] != family}
                fitted |= {at: model for at, model in made.items() if at[0] == name}
        estimators |= now
    lines = [(family, f"{family}_{i + 1}", error) for family, past in tried.items() for i, error in enumerate(past)]
    if not lines:
        raise ValueError("no family has an estimator")
    lead = {family: f"{family}_{past.index(min(past)) + 1}" for family, past in tried.items() if past}
    bases = [lead[family] for family in sorted(lead, key=lambda f: min(tried[f]))][:stack_of]
    if len(bases) > 1:
        meta = meta or LinearFamily("ridge", 1.0, features="_meta", label=label)
        oof = VectorAssembler(inputCols=[f"base_{n}" for n in bases], outputCol="_meta").transform(
            fold_predictions(folded, bases, fitted, folds))
        oof = stage(oof, "oof")
        stacked = fold_predictions(oof, ["stack"], fold_models(oof, {"stack": meta}, folds), folds)
        lines.append(("stack", "stack", errors(stacked, {"stack": "base_stack"})["stack"]))
    places = sorted(range(len(lines)), key=lambda i: (lines[i][2], i))
    rows = [(place + 1, *lines[i]) for place, i in enumerate(places)]
    winner = rows[0][2]
    if winner == "stack":
        whole = dict(zip(bases, fit_all([(estimators[n], folded) for n in bases])))
        model = Stack(whole, meta.fit(oof))
        unstage(oof)
    else:
        model = estimators[winner].fit(folded)
    unstage(folded)
    board = df.sparkSession.createDataFrame(rows, "place int, family string, model string, cv_mae double")
    return Race(board.orderBy("place"), winner, model)


def best_bases(board: DataFrame, k: int = 10, score: str = "cv_mae") -> DataFrame:
    """Leading base models, ensembles left out."""
    return board.where(~F.lower("model").contains("stack")).orderBy(score, "model").limit(k)


def importances(model, names: list[str], spark, top: int | None = None) -> DataFrame:
    """(feature, importance) of a tree model, largest first."""
    rows = [(n, float(model.featureImportances[i])) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


def as_vector(cols: list[str]):
    return array_to_vector(F.array(*[F.col(c).cast("double") for c in cols]))
