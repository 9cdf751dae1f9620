"""Tree learners of Spark ML whose tasks hold a bounded number of rows."""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 250_000
LEAST_ROWS = 5_000  # rows that are worth a task of their own


def over_cores(df: DataFrame, least: int = LEAST_ROWS, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt over all cores where fewer partitions have rows, unless these are too few for that; else as it is.

    For tables that are read again and again: one of a few files, or of one, would keep as many cores busy each time, so that
    the time follows the rows and not the cluster. Two numbers reach the driver.
    """
    held = df.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n"))
    parts, total = held.agg(F.count(F.lit(1)), F.sum("n")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    want = max(math.ceil((total or 0) / rows), min(cores, (total or 0) // least))
    return df.repartition(want) if parts < min(want, cores) else df


def dealt(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt over as many partitions as keep one near ``rows`` rows; left as it is where none has more.

    A tree fit keeps its points in the partitions that it was given and reads them for every level of every tree, so that a
    few of them, one per core say, would grow with the table. Two numbers reach the driver.
    """
    held = df.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).first()
    return df.repartition(math.ceil(total / rows)) if (most or 0) > rows else df


class _Dealt:
    """Fits on its own columns alone, dealt out."""

    def _fit(self, dataset: DataFrame):
        used = [self.getFeaturesCol(), self.getLabelCol(), *([self.getWeightCol()] if self.isDefined("weightCol") else [])]
        used += [self.getValidationIndicatorCol()] if self.hasParam("validationIndicatorCol") and self.isDefined("validationIndicatorCol") else []
        return super()._fit(dealt(dataset.select(*dict.fromkeys(used))))


class Forest(_Dealt, RandomForestRegressor):
    """``RandomForestRegressor`` on dealt rows."""


class ForestClassifier(_Dealt, RandomForestClassifier):
    """``RandomForestClassifier`` on dealt rows."""


class Boosted(_Dealt, GBTRegressor):
    """``GBTRegressor`` on dealt rows."""
