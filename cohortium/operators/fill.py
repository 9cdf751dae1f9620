"""Constant, mean, median and mode fills, and chained-equation fills."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .moments import centred, moment_groups
from .frequency import category_index, most_frequent, restore_labels
from .quality import completion, missing_total
from .quantiles import exact_quantiles
from .trees import Forest

MAX_MAP_VALUES = 2_000_000  # numbers in the maps of all missing patterns and rounds, 16 MB


def fit_fill(df: DataFrame, cols: list[str], strategy: str, constant=0.0) -> dict:
    """Fill value per column: ``mean``, ``median``, ``mode`` or ``constant``. One or two passes for all columns."""
    if strategy == "mean":
        return df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    if strategy == "median":
        return {r["column"]: r["quantile"] for r in exact_quantiles(df, cols, [0.5]).collect()}
    if strategy == "mode":
        return {r["column"]: r["value"] for r in most_frequent(df, cols).collect()}
    if strategy == "constant":
        return {c: constant for c in cols}
    raise ValueError(f"unknown strategy {strategy}")


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    """Replaces nulls only. A mean or median turns an integer column into a double one."""
    out = {}
    for c, value in values.items():
        if value is not None:
            kind = df.schema[c].dataType.simpleString()
            target = "double" if isinstance(value, float) else kind
            out[c] = F.coalesce(F.col(c).cast(target), F.lit(value).cast(target))
    return df.withColumns(out)


def fill(df: DataFrame, cols: list[str], strategy: str, constant=0.0) -> tuple[dict, DataFrame]:
    values = fit_fill(df, cols, strategy, constant)
    return values, apply_fill(df, values)


def _line(total: np.ndarray, at: int, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge coefficients (0 at ``at``) and constant of column ``at`` on all others, from a moment matrix."""
    n, mean, spread = centred(total, 0.0)
    others = [i for i in range(len(mean)) if i != at]
    beta = np.zeros(len(mean))
    beta[others] = np.linalg.lstsq(spread[np.ix_(others, others)] + alpha * np.eye(len(others)), spread[others, at], rcond=None)[0]
    return beta, float(mean[at] - beta @ mean)


def _ridge(df: DataFrame, target: str, predictors: list[str], miss: str, centre: dict, alpha: float) -> tuple:
    """Coefficients of target on predictors from one pass of sums over the rows that have the target."""
    names = [*predictors, target]
    shift = np.array([centre[c] for c in names])
    total = moment_groups(df.where(~F.col(miss)), F.array(*names), shift)[()]
    beta, constant = _line(total, len(predictors), alpha)
    return beta[:-1], float(constant + shift[-1] - beta @ shift)


def _dot(row, z):
    return F.aggregate(F.zip_with(row, z, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def chained_lines(work: DataFrame, usable: list[str], incomplete: list[str], now: dict, miss: dict, mean: dict, rounds: int,
                  alpha: float, tol: float, largest: float) -> DataFrame | None:
    """All rounds of the linear chained fill from one pass of moments by missing pattern; none if the patterns are too many.

    A cell that is filled is an affine function of its row's observed cells, the same for all rows with the same gaps. So a
    round needs no data: with ``T`` the step that replaces a column, the moments ``M`` of a pattern become ``T M T'``. One more
    pass takes the largest move of each round, to stop where the rounds would, and one fills.
    """
    k, at = len(usable), {c: i + 1 for i, c in enumerate(usable)}
    pattern = F.concat(*(F.col(miss[c]).cast("int").cast("string") for c in incomplete))
    most = MAX_MAP_VALUES // (rounds * len(incomplete) * (k + 1))
    if work.select(pattern).distinct().limit(most + 1).count() > most:
        return None
    shift = np.array([float(mean[c]) for c in usable])
    values = F.array(*(F.col(now[c]) for c in usable))
    groups = {key[0]: m for key, m in moment_groups(work, values, shift, [pattern]).items()}
    gone = {key: {c for c, mark in zip(incomplete, key) if mark == "1"} for key in groups}
    maps = {key: [np.eye(k + 1)] for key in groups}  # after each round
    for _ in range(rounds):
        for key in maps:
            maps[key].append(maps[key][-1])
        for c in incomplete:
            beta, constant = _line(sum(m for key, m in groups.items() if c not in gone[key]), at[c] - 1, alpha)
            step = np.eye(k + 1)
            step[at[c]] = [constant, *beta]
            for key in groups:
                if c in gone[key]:
                    groups[key] = step @ groups[key] @ step.T
                    maps[key][-1] = step @ maps[key][-1]
    rows = [at[c] for c in incomplete]
    z = F.concat(F.array(F.lit(1.0)), F.zip_with(values, F.array(*(F.lit(s) for s in shift.tolist())), lambda a, b: a - b))
    marked = work.withColumns({"_pattern": pattern, "_z": z})

    def table(of, kind: str) -> DataFrame:
        return F.broadcast(work.sparkSession.createDataFrame([(key, of(own)) for key, own in maps.items()], f"_pattern string, _map {kind}"))

    moves = table(lambda own: [(b - a)[rows].tolist() for a, b in zip(own, own[1:])], "array<array<array<double>>>")
    moved = marked.join(moves, "_pattern").select(F.transform("_map", lambda r: F.array_max(F.transform(
        r, lambda row: F.abs(_dot(row, F.col("_z")))))).alias("moved"))
    steps = moved.agg(*(F.max(F.col("moved")[r]).alias(f"r{r}") for r in range(rounds))).first()
    last = next((r for r in range(rounds) if (steps[r] or 0.0) < tol * largest), rounds - 1) + 1
    filled = marked.join(table(lambda own: own[last][rows].tolist(), "array<array<double>>"), "_pattern")
    return filled.withColumns({now[c]: F.when(F.col(miss[c]), F.lit(float(mean[c])) + _dot(F.col("_map")[i], F.col("_z"))).otherwise(F.col(now[c]))
                               for i, c in enumerate(incomplete)}).drop("_map", "_z", "_pattern")


def fill_chained(df: DataFrame, cols: list[str], rounds: int = 10, learner: str = "forest",
                 categorical: list[str] = (), trees: int = 10, depth: int = 5, alpha: float = 0.0,
                 seed: int = 42, tol: float = 1e-3) -> DataFrame:
    """Chained-equation fill: start at the mean, then regress each incomplete column on all others, in rounds.

    Columns go from fewest to most gaps. Observed cells never change. Text columns named in
    ``categorical`` are indexed, filled as numbers, rounded to a valid index and labelled again.
    Each round is written to the shared folder, so lineage stays short and lost executors cost
    one round at most. The linear learner stops early when a round moves no cell by more than
    ``tol`` times the largest absolute value; it needs no pass per round where the missing patterns are few enough for
    ``chained_lines``, with the same result.
    """
    work, labels = category_index(df, list(categorical)) if categorical else (df, None)
    numbers = [*cols, *[c + "_idx" for c in categorical]]
    now = {c: f"_f{i}" for i, c in enumerate(numbers)}
    miss = {c: f"_m{i}" for i, c in enumerate(numbers)}
    facts = work.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(numbers)],
                     *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(numbers)],
                     *[F.max(F.abs(F.col(c).cast("double"))).alias(f"x{i}") for i, c in enumerate(numbers)]).first()
    mean = {c: facts[f"a{i}"] for i, c in enumerate(numbers)}
    gaps = {c: facts[f"n{i}"] for i, c in enumerate(numbers)}
    usable = [c for c in numbers if mean[c] is not None]
    incomplete = sorted([c for c in usable if gaps[c]], key=lambda c: gaps[c])
    largest = max((facts[f"x{i}"] or 0.0 for i, c in enumerate(numbers)), default=0.0)
    work = work.withColumns({
        **{miss[c]: F.col(c).isNull() for c in usable},
        **{now[c]: F.coalesce(F.col(c).cast("double"), F.lit(float(mean[c]))) for c in usable}})
    centre = {now[c]: float(mean[c]) for c in usable}
    held = None  # what the round before left
    made = None
    if incomplete and len(usable) > 1 and learner == "ridge" and rounds > 0:
        made = chained_lines(work, usable, incomplete, now, miss, mean, rounds, alpha, tol, largest)
    if made is not None:
        work = made
    elif incomplete and len(usable) > 1:
        for r in range(rounds):
            if learner == "ridge":
                work = work.withColumns({f"_p{i}": F.col(now[c]) for i, c in enumerate(incomplete)})
            for c in incomplete:
                predictors = [now[x] for x in usable if x != c]
                if learner == "ridge":
                    beta, constant = _ridge(work, now[c], predictors, miss[c], centre, alpha)
                    guess = sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, predictors)), F.lit(constant))
                    work = work.withColumn(now[c], F.when(F.col(miss[c]), guess).otherwise(F.col(now[c])))
                else:
                    ready = VectorAssembler(inputCols=predictors, outputCol="_x").transform(work)
                    model = Forest(
                        featuresCol="_x", labelCol=now[c], predictionCol="_guess", numTrees=trees,
                        maxDepth=depth, seed=seed).fit(ready.where(~F.col(miss[c])))
                    guessed = model.transform(ready)
                    work = guessed.withColumn(
                        now[c], F.when(F.col(miss[c]), F.col("_guess")).otherwise(F.col(now[c]))).drop("_x", "_guess")
            before, work = held, stage(work, "chained")
            held = work
            if before is not None:
                unstage(before)
            if learner == "ridge":
                moved = F.greatest(*[F.abs(F.col(now[c]) - F.col(f"_p{i}")) for i, c in enumerate(incomplete)],
                                   F.lit(0.0))
                step = work.agg(F.max(moved)).first()[0] or 0.0
                work = work.drop(*[f"_p{i}" for i in range(len(incomplete))])
                if step < tol * largest:
                    break
    out = {}
    for c in cols:
        if c in usable:
            out[c] = F.col(now[c])
    for c in categorical:
        if c + "_idx" in usable:
            work = restore_labels(work, F.col(now[c + "_idx"]), labels, c, f"_{c}_filled")
            out[c] = F.coalesce(F.col(c), F.col(f"_{c}_filled"))
    return work.withColumns(out).select(*df.columns)


def fill_report(before: DataFrame, after: DataFrame, by: str, method: str, cols: list[str],
                categorical: int = 0) -> DataFrame:
    """(source, original_missing, final_missing, completion, method, categorical), one row per source and ``ALL``."""
    counts = (missing_total(before, cols, by).withColumnRenamed("missing", "original_missing")
              .join(missing_total(after, cols, by).withColumnRenamed("missing", "final_missing"), "source"))
    total = counts.rollup("source").agg(
        F.grouping("source").alias("is_total"),
        F.sum("original_missing").alias("original_missing"), F.sum("final_missing").alias("final_missing"))
    name = F.when(F.col("is_total") == 1, "ALL").otherwise(F.col("source"))
    return total.select(name.alias("source"), "original_missing", "final_missing",
                        completion(F.col("original_missing"), F.col("final_missing")).alias("completion"),
                        F.lit(method).alias("method"), F.lit(categorical).alias("categorical"))
