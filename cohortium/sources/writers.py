"""Sinks for data, tables of results, metadata and models."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession


def suffixed(path: str, suffix: str, folder: str | None = None) -> str:
    base, _ = os.path.splitext(path.rstrip("/"))
    return f"{folder or os.path.dirname(base)}/{os.path.basename(base)}{suffix}"


def write_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet",
                partition_by: list[str] = ()) -> str:
    """Writes unless the target exists; ``overwrite`` replaces it."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_metadata(spark: SparkSession, path: str, columns: list[str], model: str) -> str:
    """One JSON record with the column list and the model name."""
    row = spark.createDataFrame([(columns, model)], "columns array<string>, model string")
    row.write.mode("overwrite").json(path)
    return path


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_model(spark: SparkSession, path: str):
    """A saved model of any kind; its own metadata tells which."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
