"""Scalar functions: every map key, odd spellings, nulls, boundaries."""

import pytest
from pyspark.sql import functions as F

from cohortium import functions as fn
from cohortium import rules


def values(spark, kind, inputs, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_clean_text(spark):
    assert values(spark, "string", ["\t a b \n", " x ", "", None], fn.clean_text) == ["a b", "x", "", None]


def test_normalize_category(spark):
    words = [*rules.GENDER, " FE male ", "nan", "None", "NA", "", None, "?"]
    wanted = [*rules.GENDER.values(), "Female", *["Missing"] * 5, "Other"]
    assert values(spark, "string", words, fn.normalize_category) == wanted


def test_area(spark):
    words = ["Urban", " rural ", "town", None]
    assert values(spark, "string", words, fn.map_area) == ["Urban", "Rural", "Missing", "Missing"]
    assert values(spark, "string", words, lambda c: fn.map_area(c, True)) == [1, 0, -1, -1]


@pytest.mark.parametrize("table", [rules.EDUCATION, rules.SLEEP, rules.DIET, rules.MILK])
def test_ordinals(spark, table):
    words = [f" {k.upper()} " for k in table] + ["else", None]
    assert values(spark, "string", words, lambda c: fn.ordinal(c, table)) == [*table.values(), -1, -1]


def test_occupation(spark):
    words = [*rules.OCCUPATION, "pilot", None]
    assert values(spark, "string", words, fn.group_occupation) == [*rules.OCCUPATION.values(), "Other", "Missing"]


def test_marital(spark):
    words = [" Divorcee/Seperated", "WIDOW/WIDOWER", "Un  Married", None]
    assert values(spark, "string", words, fn.correct_labels) == [
        "Divorcee/Separated", "Widowed", "un married", "Missing"]


def test_durations(spark):
    words = ["At least 10 mins", "10 - 30mins", "30mins - 1hr", "1hr - 1.5hrs", ">1.5hrs", "x", None]
    assert values(spark, "string", words, fn.duration_minutes) == [10, 20, 45, 75, 105, -1, -1]
    assert values(spark, "int", [0, 1, 2, 3, 4, 5, 6, None], fn.code_minutes) == [0, 10, 20, 45, 75, 105, -1, -1]


def test_yes_no(spark):
    words = ["Yes", "No(0)", "Y", "n", "1", "0", "1.0", "0.0", "10", "none", "nothing", "yes(1)", "maybe", "", None,
             "(y)", "No 1", "01", "+1", "-0"]
    wanted = [1, 0, 1, 0, 1, 0, 1, 0, 0, None, 0, 1, None, None, None, 1, 1, 1, 1, 0]
    assert values(spark, "string", words, fn.yes_no) == wanted
    # a 0/1 column with gaps arrives as 1.0; by its digits alone that is a no
    assert values(spark, "string", ["1.0", "1"], lambda c: fn.yes_no(c, True)) == [0, 1]


def test_any_flag(spark):
    df = spark.createDataFrame([("No", None, None), ("No", "Yes", None), (None, None, 3.0), (None, None, None)],
                               "a string, b string, n double")
    flag = lambda zero: [r[0] for r in df.select(fn.any_flag([F.col("a"), F.col("b")], [F.col("n")], zero)).collect()]
    assert flag(False) == [0, 1, 1, None]
    assert flag(True) == [0, 1, 1, 0]


def test_bmi_and_ratio_exclude_their_bounds(spark):
    df = spark.createDataFrame([(100.0, 10.0), (100.0, 100.0), (100.0, 25.0), (0.0, 50.0), (170.0, -1.0)], "h double, w double")
    assert [r[0] for r in df.select(fn.bmi(F.col("h"), F.col("w"))).collect()] == [None, None, 25.0, None, None]
    df = spark.createDataFrame([(3.0, 10.0), (30.0, 10.0), (9.0, 10.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(fn.bounded_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 0.9, None]


def test_duration(spark):
    df = spark.createDataFrame([(50.0, 50.0), (90.0, 10.0), (91.0, 10.0), (40.0, 41.0), (None, 3.0)], "a double, o double")
    years = fn.duration(F.col("a"), F.col("o"))
    assert [r[0] for r in df.select(years).collect()] == [0.0, 80.0, 0.0, 0.0, 0.0]
    assert values(spark, "double", [0.6, 0.61], fn.duration_status) == ["newly diagnosed", "known diabetes"]


def test_activity(spark):
    df = spark.createDataFrame([(105, 105, 105), (-1, None, 20), (0, 0, 0)], "a int, b int, c int")
    score = fn.activity_score({"mild": F.col("a"), "moderate": F.col("b"), "vigorous": F.col("c")})
    got = [r[0] for r in df.select(F.round(score, 6)).collect()]
    assert got == [9702.0, 952.0, 0.0]
    assert values(spark, "double", [1099.9, 1100.0], fn.activity_optimal) == ["No", "Yes"]


def test_bands(spark):
    labs = [5.69, 5.7, 6.4, 6.41, 6.49, 6.5, 7.99, 8.0, None]
    assert values(spark, "double", labs, fn.risk_band) == [
        "NORMAL", *["PRE_DIABETIC"] * 4, "DIABETIC", "DIABETIC", "HIGH_RISK", None]
    assert values(spark, "double", labs, fn.glycaemic_category) == [
        "Normoglycemia", "Prediabetes", "Prediabetes", *["Diabetes"] * 5, None]
    assert values(spark, "int", [0, 2, 3, 5, 6, 8, 9, 10, 11], fn.stress_band) == [
        *["No to Mild Stress"] * 2, *["Moderate Stress"] * 2, *["High Stress"] * 2, *["Severe Stress"] * 2, None]


def test_response_and_target(spark):
    df = spark.createDataFrame([(7.0, 1.0), (7.0, 0.5), (7.0, 0.49), (7.0, -0.01), (6.4, 1.0), (7.0, None)], "p double, d double")
    got = [r[0] for r in df.select(fn.response_class(F.col("p"), F.col("d"))).collect()]
    assert got == [*[label for _, label in rules.RESPONSE_CLASSES], None, None]
    df = spark.createDataFrame([(7.0, 6.0, 50.0), (7.04, 6.9, 50.0), (7.04, 7.2, 50.0), (9.0, 7.5, 65.0), (9.0, 7.5, 64.0)],
                               "p double, q double, a double")
    got = [r[0] for r in df.select(fn.target_attainment(F.col("p"), F.col("q"), F.col("a"))).collect()]
    assert got == [None, "At target", "Above target", "Achieved target", "Not achieved"]


def test_split_multi_and_signed(spark):
    assert values(spark, "string", ["1,3", "6,6,x", "", None], fn.split_multi) == [[1, 3], [6], [], None]
    assert values(spark, "double", [1.0, -0.005, None], fn.signed)[::2] == ["+1.00", None]
    assert values(spark, "double", [0.31, 0.3, 0.1], fn.intensity) == ["significantly", "moderately", "slightly"]
