"""Metrics, leaderboards, cross-source validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    """(by…, n, mae, mse, rmse, r2, and the ranges and means of both). One aggregate."""
    t, p = F.col(y), F.col(yhat)
    error = t - p
    return df.where(t.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.avg(error * error), F.var_pop(t))).alias("r2"),
        F.min(t).alias("target_min"), F.max(t).alias("target_max"), F.avg(t).alias("target_mean"),
        F.min(p).alias("pred_min"), F.max(p).alias("pred_max"), F.avg(p).alias("pred_mean"))


def goal_met(metrics: DataFrame, goal: float = 0.5, mae: str = "mae") -> DataFrame:
    return metrics.withColumn("goal", F.col(mae) < goal)


def long_predictions(df: DataFrame, models: dict, keep: list[str]) -> DataFrame:
    """(keep…, model, yhat): every model scores every row in one scan."""
    out = df
    for i, model in enumerate(models.values()):
        cols = [c for c in out.columns if c != "prediction"]
        out = model.transform(out.select(*cols)).select(*cols, F.col("prediction").cast("double").alias(f"_y{i}"))
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_y{i}").alias("yhat")) for i, n in enumerate(models)])
    return out.select(*keep, F.inline(pairs))


def cross_validate_sources(df: DataFrame, models: dict, y: str, source: str, goal: float = 0.5) -> DataFrame:
    """Each model on the held-out rows of each source: the whole matrix from one scan and one aggregate."""
    scored = long_predictions(df, models, [y, source])
    metrics = regression_metrics(scored, y, "yhat", ["model", source])
    return goal_met(metrics.select("model", source, "n", "mae", "rmse", "r2"), goal)


def leaderboard_summary(board: DataFrame, mae: str = "test_mae", minutes: str = "train_minutes",
                        goal: float = 0.5) -> DataFrame:
    """Models that met the goal, mean, median and best MAE, total training time. The board is small."""
    return board.agg(F.count_if(F.col(mae) < goal).alias("goals_met"), F.count(F.lit(1)).alias("models"),
                     F.avg(mae).alias("mean_mae"), F.median(mae).alias("median_mae"), F.min(mae).alias("best_mae"),
                     F.sum(minutes).alias("total_minutes"))


def best_by(board: DataFrame, score: str, ordinal: str = "ordinal") -> DataFrame:
    """The row with the smallest score, the first declared on a tie."""
    return board.orderBy(score, ordinal).limit(1)


def top_features(importance: DataFrame, k: int = 5, by: str = "model", score: str = "importance") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
