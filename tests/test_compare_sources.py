"""A comparison of sources derives the rows of a large table once, whatever the number of combinations."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortium.operators import models, trees
from cohortium.plans import training


def test_rows_are_derived_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(x):
        made.add(1)
        return float(x)

    df = spark.range(0, 240, 1, 2).select("id", F.element_at(F.array(F.lit("A"), F.lit("B")), (F.pmod("id", F.lit(2)) + 1).cast("int")).alias("source"),
                                          slow(F.pmod("id", F.lit(6))).alias("label"))
    df = df.withColumn("features", array_to_vector(F.array("label")))
    monkeypatch.setattr(training, "dealt", lambda df: trees.dealt(df, 100))
    out = training.compare_sources(df, "source", ["A", "B"], "id", models.boosted(trees=1, rate=1.0), {"maxDepth": [2]}, sizes=(1, 2), folds=2)
    assert out.board.count() == 3 and sorted(out.models) == ["A", "A + B", "B"]
    assert made.value <= 2 * 2 * 240  # for the count and the table; the vector may be made from a value of its own
