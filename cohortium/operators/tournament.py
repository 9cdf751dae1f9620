"""Masked-holdout comparison of fill strategies."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucket, stage, unstage
from .columns import enough_rows
from .fill import apply_fill, fill_chained, fit_fill
from .neighbours import fill_knn
from .trees import over_cores

log = logging.getLogger(__name__)

SCORES = "strategy string, ordinal int, cells bigint, rmse double"
FAILURES = (PySparkException, Py4JJavaError, ValueError, ArithmeticError)  # of the data or the fit, not of the program
STRATEGIES = ("mean", "median", "knn", "chained", "zero")


def mask_cells(df: DataFrame, cols: list[str], key: str, one_in: int = 10, hashed: bool = False) -> DataFrame:
    """Complete rows with the truth kept in ``<c>__true`` and one cell in ``one_in`` hidden, by key alone."""
    complete = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    return complete.select(key, *[F.col(c).alias(f"{c}__true") for c in cols], *[
        F.when(bucket(key, i, one_in, hashed) != 0, F.col(c)).alias(c) for i, c in enumerate(cols, 1)])


def fill_with(df: DataFrame, cols: list[str], key: str, strategy: str, rounds: int = 5,
              learner: str = "forest") -> DataFrame:
    if strategy == "knn":
        # every column is filled from the columns as they came, not from cells filled before
        out = df
        for c in cols:
            out = out.withColumn(f"_o_{c}", F.col(c))
        for c in cols:
            out = stage(fill_knn(out, c, [f"_o_{x}" for x in cols if x != c], key), "knn")
        return out.drop(*[f"_o_{c}" for c in cols])
    if strategy == "chained":
        return fill_chained(df, cols, rounds=rounds, learner=learner)
    if strategy == "zero":
        return apply_fill(df, {c: 0.0 for c in cols})
    return apply_fill(df, fit_fill(df, cols, strategy))


def masked_rmse(filled: DataFrame, masked: DataFrame, cols: list[str], key: str, one_in: int, hashed: bool):
    """(cells, rmse) over the hidden cells of a filled frame; rmse is null where none was hidden."""
    error = sum((F.when(bucket(key, i, one_in, hashed) == 0, F.pow(F.col(c) - F.col(f"{c}__true"), 2)).otherwise(0.0)
                 for i, c in enumerate(cols, 1)), F.lit(0.0))
    hidden = sum((F.when(bucket(key, i, one_in, hashed) == 0, 1).otherwise(0)
                  for i, _ in enumerate(cols, 1)), F.lit(0))
    return filled.agg(F.sum(hidden).cast("bigint").alias("cells"),
                      F.sqrt(F.try_divide(F.sum(error), F.sum(hidden))).alias("rmse"))


def score_strategies(df: DataFrame, cols: list[str], key: str, strategies=STRATEGIES, one_in: int = 10,
                     rounds: int = 5, learner: str = "forest", hashed: bool = False) -> DataFrame:
    """(strategy, ordinal, cells, rmse), one row per strategy in the given order.

    Every strategy is run to its end here; one that fails has no rmse, and the others go on.
    """
    masked = stage(mask_cells(df, cols, key, one_in, hashed), "masked")
    scores = []
    for i, name in enumerate(strategies):
        cells = rmse = None
        try:
            cells, rmse = masked_rmse(fill_with(masked, cols, key, name, rounds, learner), masked, cols, key, one_in, hashed).first()
        except FAILURES as error:
            log.warning("fill strategy %s failed: %s", name, str(error).split("\n")[0])
        scores.append((name, i, cells, rmse))
    unstage(masked)
    return df.sparkSession.createDataFrame(scores, SCORES)


def winner(scores: DataFrame, score: str = "rmse", name: str = "strategy", by: list[str] = ()) -> DataFrame:
    """Row with the smallest score; of equal ones the first declared. Rows without a score never win."""
    order = F.struct(score, "ordinal")
    return scores.where(F.col(score).isNotNull()).groupBy(*by).agg(F.min_by(name, order).alias(name), F.min(score).alias(score))


def fill_tournament(df: DataFrame, cols: list[str], key: str, strategies=STRATEGIES, one_in: int = 10,
                    rounds: int = 5, learner: str = "forest", hashed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(scores, filled): the best strategy, fitted again on the whole table.

    With fewer than 10 complete rows, or where no cell was hidden or no strategy came through, nothing can be compared:
    chained fill. If the chosen strategy fails on the whole table, the mean fills it. A table that lies in fewer partitions
    than there are cores is dealt out and written first, as every strategy reads it many times.
    """
    spread = over_cores(df)
    rows = stage(spread, "tournament") if spread is not df else df
    scores = df.sparkSession.createDataFrame([], SCORES)
    best = None
    if enough_rows(rows.select(*cols).dropna(), 10):
        scores = score_strategies(rows, cols, key, strategies, one_in, rounds, learner, hashed)
        best = winner(scores).first()
    name = best["strategy"] if best and best["strategy"] else "chained"
    try:
        return scores, stage(fill_with(rows, cols, key, name, rounds, learner), "filled")
    except FAILURES as error:
        log.warning("fill strategy %s failed, the mean is used: %s", name, str(error).split("\n")[0])
        return scores, fill_with(df, cols, key, "mean")
    finally:
        if rows is not df:
            unstage(rows)
