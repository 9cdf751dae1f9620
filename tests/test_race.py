"""Search over families: who stays in the race, what is on the board, who wins."""

import pytest
from pyspark.sql import functions as F

from cohortium.operators import models


def data(spark, rows=300):
    k = F.col("id")
    df = spark.range(rows).select("id", (F.pmod(k * 37, F.lit(101)) / 101.0).alias("a"), (F.pmod(k * 53, F.lit(89)) / 89.0).alias("b"))
    df = df.withColumn("label", F.when(k % 50 != 0, 3 * F.col("a") + F.when(F.col("b") > 0.5, 1.0).otherwise(0.0)))
    return df.withColumns({"on_a": models.as_vector(["a"]), "on_b": models.as_vector(["b"]), "features": models.as_vector(["a", "b"])})


def lines(column, alphas):
    return [models.LinearFamily("ridge", alpha, features=column) for alpha in alphas]


def test_a_family_that_stands_still_leaves_the_race(spark):
    raced = models.race(data(spark), {"still": lines("on_a", [0.0] * 6), "moving": lines("on_b", [1e6, 1e4, 1e3, 1e2, 10.0, 1.0])},
                        "id", folds=3, rounds=2)
    tried = {r["family"]: r["count"] for r in raced.board.groupBy("family").count().collect()}
    assert tried["still"] == 3 and tried["moving"] > 3 and tried["stack"] == 1


def test_the_stack_wins_only_if_better(spark):
    df = data(spark)
    together = models.race(df, {"a": lines("on_a", [0.0]), "b": lines("on_b", [0.0])}, "id", folds=3)
    assert together.winner == "stack" and isinstance(together.model, models.Stack)
    assert together.model.transform(df).where("prediction IS NULL").count() == 0
    board = together.board.collect()
    assert [r["place"] for r in board] == [1, 2, 3]
    assert [r["cv_mae"] for r in board] == sorted(r["cv_mae"] for r in board)
    alone = models.race(df, {"a": lines("on_a", [0.0])}, "id", folds=3)
    assert alone.winner == "a_1" and alone.board.count() == 1


def test_trees_and_lines_share_a_board(spark):
    df = data(spark)
    raced = models.race(df, {"line": lines("features", [0.0]), "tree": [models.boosted(trees=3, depth=3, rate=0.5)]}, "id", folds=2)
    found = {r["model"]: r["cv_mae"] for r in raced.board.collect()}
    assert set(found) == {"line_1", "tree_1", "stack"}
    # the line's error, fold by fold, with rows that have no label left out
    folded = models.out_of_fold(df.where("label IS NOT NULL"), {"line": lines("features", [0.0])[0]}, "id", 2)
    each = folded.groupBy("fold").agg(F.avg(F.abs(F.col("label") - F.col("base_line"))).alias("e")).agg(F.avg("e")).first()[0]
    assert found["line_1"] == pytest.approx(each)


def test_no_estimators(spark):
    with pytest.raises(ValueError):
        models.race(data(spark, 20), {"none": []}, "id", folds=2)


def test_sources_with_few_rows_are_named(spark):
    from pyspark.ml.regression import LinearRegression
    from cohortium.operators.models import as_vector
    from cohortium.plans.training import compare_sources
    df = spark.range(120).select("id", F.when(F.col("id") < 5, "tiny").otherwise("large").alias("source"), F.rand(1).alias("a"))
    df = df.withColumn("label", F.col("a") * 2).withColumn("features", as_vector(["a"]))
    found = compare_sources(df, "source", ["tiny", "large"], "id", LinearRegression(labelCol="label"), {"regParam": [0.1]}, sizes=(1,), folds=2)
    assert found.skipped == ["tiny"] and [r["dataset"] for r in found.board.collect()] == ["large"]
