"""Explanation of a batch of models, with its exported tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import explain as ex
from ..sources import write_table


def explain_models(runs: dict[str, tuple], folder: str, key: str, top: int = 3, swarm: int = 15) -> DataFrame:
    """Contributions, importance, dependence and value spread per model, written by model; returns the summary.

    ``runs`` maps a model name to (frame with ``features``, tree model, feature names).
    """
    explained = {}
    for name, (df, model, names) in runs.items():
        done = ex.contributions_trees(df, model, names).select(key, "base", "factors").withColumn("model", F.lit(name))
        write_table(done, f"{folder}/contributions/model={name}", overwrite=True)
        explained[name] = df.sparkSession.read.parquet(f"{folder}/contributions/model={name}")
    rank = reduce(DataFrame.unionByName, [
        ex.importance(df).withColumn("model", F.lit(name)) for name, df in explained.items()])
    write_table(rank, f"{folder}/importance", overwrite=True, partition_by=["model"])
    for name, df in explained.items():
        leaders = [r["feature"] for r in rank.where((F.col("model") == name) & (F.col("rank") <= top))
                   .orderBy("rank").collect()]
        write_table(ex.dependence(df, leaders, [key], top), f"{folder}/dependence/model={name}", overwrite=True)
        write_table(ex.beeswarm(df, [key], swarm), f"{folder}/spread/model={name}", overwrite=True)
    return ex.run_summary(explained)
