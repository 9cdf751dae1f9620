"""Split and filtered writes account for their rows; keys and flags of the cleaning plan."""

from pyspark.sql import functions as F

from cohortium import rules
from cohortium.operators import columns, validation
from cohortium.plans import cleaning


def test_both_parts_from_one_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, 50.0, ""), (4, 7.0, "c")], "id long, x double, s string")
    checks = [("x", True, 1, 10), ("s", True, None, None)]
    path = str(tmp_path / "out")
    seen = validation.write_validated(df, checks, path)
    assert seen == {"rows": 4, "valid": 2, "quarantined": 2, "violations": 3}
    good, bad = validation.read_validated(spark, path, df)
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 4] and good.columns == df.columns
    assert {r["id"]: [tuple(v) for v in r["violations"]] for r in bad.collect()} == {
        2: [("x", "required")], 3: [("x", "le 10"), ("s", "required")]}
    # the part is chosen by its folder
    assert "PartitionFilters: [isnotnull(valid" in good._jdf.queryExecution().toString()
    seen = validation.write_validated(df.limit(0), checks, str(tmp_path / "empty"))
    assert seen == {"rows": 0, "valid": 0, "quarantined": 0, "violations": 0}


def test_a_filtered_write_counts_like_filter_steps(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id")))
    steps = [("known", F.col("x").isNotNull()), ("small", F.col("x") < 50), ("null test", F.lit(None).cast("boolean") | (F.col("x") > 3))]
    account = columns.write_filtered(df, steps, str(tmp_path / "out"))
    assert account.collect() == columns.filter_steps(df, steps).collect()
    assert spark.read.parquet(str(tmp_path / "out")).count() == account.collect()[-1]["rows_after"]


def test_keys_follow_content_not_files(spark):
    df = spark.range(200).select((F.col("id") % 150).alias("v"), F.format_string("t%d", F.col("id") % 150).alias("s"))
    orders = []
    for parts in (1, 7):
        keyed = cleaning.with_row_key(df.repartition(parts, "v"))
        assert keyed.select("row_key").distinct().count() == 200
        orders.append([(r["v"], r["s"]) for r in keyed.orderBy("row_key").collect()])
    assert orders[0] == orders[1]


def test_legacy_flags_read_like_the_columns_beside_them(spark):
    c = rules.SMOKING_YES_NO[0]
    df = spark.createDataFrame([("1.0",), ("yes",)], f"`{c}` string")
    new, old = cleaning.clean_survey(df).collect(), cleaning.clean_survey(df, legacy=True).collect()
    assert [r["current_smoking"] for r in new] == [r[c] for r in new] == [1, 1]
    assert [r["current_smoking"] for r in old] == [r[c] for r in old] == [0, 1]
