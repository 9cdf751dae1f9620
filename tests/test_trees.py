"""Tree fits deal out rows that lie in few partitions."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortium.operators import models, ranking, tournament, trees


def _rows(spark, n, parts):
    x = F.pmod(F.col("id"), F.lit(7)).cast("double")
    return spark.range(0, n, 1, parts).select(array_to_vector(F.array(x)).alias("features"), (2 * x).alias("label"), F.lit("wide").alias("other"))


def test_partitions_follow_the_rows(spark):
    assert trees.dealt(_rows(spark, 1000, 1), 100).rdd.getNumPartitions() == 10
    assert trees.dealt(_rows(spark, 1000, 4), 300).rdd.getNumPartitions() == 4
    assert trees.dealt(_rows(spark, 0, 1), 10).count() == 0


def test_tree_estimators_fit_on_dealt_rows(spark, monkeypatch):
    seen = []
    real = trees.dealt

    def watched(df, rows=50):
        out = real(df, rows)
        seen.append((sorted(out.columns), out.rdd.getNumPartitions(), out.count()))
        return out

    monkeypatch.setattr(trees, "dealt", watched)
    df = _rows(spark, 400, 1).withColumn("id", F.monotonically_increasing_id())
    for estimator in (models.boosted(trees=2, depth=3, rate=1.0), models.forest(trees=2, depth=3), models.boosted_sampled(trees=2, depth=3)):
        seen.clear()
        estimator.fit(df)
        assert seen == [(["features", "label"], 8, 400)]
    model = models.boosted(trees=1, depth=3, rate=1.0).fit(df)
    assert model.transform(df).where(F.abs(F.col("prediction") - F.col("label")) > 1e-9).count() == 0
    best, board = models.search(df, models.boosted(trees=1, rate=1.0), {"maxDepth": [1, 3]}, "id", folds=2)
    assert best.getMaxDepth() == 3 and board.count() == 2


def test_forests_of_texts_are_dealt_too(spark, monkeypatch):
    real, seen = trees.dealt, []
    monkeypatch.setattr(trees, "dealt", lambda df: seen.append(df.columns) or real(df, 50))
    df = spark.range(0, 300, 1, 1).select(F.pmod("id", F.lit(3)).alias("x"), F.concat(F.lit("t"), F.pmod("id", F.lit(3))).alias("y"))
    out = ranking.forest_importance(df, ["x"], "y", trees=2, depth=3).collect()
    assert [(r["target"], r["feature"]) for r in out] == [("y", "x")] and seen == [["_x", "_y"]]


def test_rows_in_few_partitions_use_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert trees.over_cores(_rows(spark, 1000, 1), least=10).rdd.getNumPartitions() == min(cores, 100)
    assert trees.over_cores(_rows(spark, 1000, 1), least=10, rows=20).rdd.getNumPartitions() == max(cores, 50)
    for kept, least in ((_rows(spark, 1000, 1), 1000), (_rows(spark, 1000, cores), 10), (_rows(spark, 0, 1), 10)):
        assert trees.over_cores(kept, least=least) is kept


def test_tournament_deals_out_a_table_of_one_partition(spark, monkeypatch):
    real, seen = tournament.fill_with, []

    def watched(df, *rest):
        seen.append((df.rdd.getNumPartitions(), df.count()))
        return real(df, *rest)

    monkeypatch.setattr(tournament, "fill_with", watched)
    df = spark.range(0, 10_000, 1, 1).select("id", F.when(F.pmod("id", F.lit(7)) != 1, F.pmod("id", F.lit(5))).cast("double").alias("a"))
    scores, filled = tournament.fill_tournament(df, ["a"], "id", ("mean", "zero"))
    assert [n for n, _ in seen] == [min(2, spark.sparkContext.defaultParallelism)] * 3 and seen[-1][1] == 10_000
    assert scores.where(F.col("rmse").isNotNull()).count() == 2
    out = filled.agg(F.count("a"), F.count_distinct("id"), F.count_if(F.pmod("id", F.lit(7)) != 1)).first()
    assert tuple(out) == (10_000, 10_000, 8571)
    assert filled.where((F.pmod("id", F.lit(7)) != 1) & (F.col("a") != F.pmod("id", F.lit(5)))).count() == 0
