"""Derived inputs for the registered queries, each in a Spark and a SQL form.

The given tables have no gaps and no survey columns. Both are derived from them by key arithmetic
that any engine repeats, so every query works on all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# answers as people type them: column -> (factor, shift, spellings)
ANSWERS = {
    "PreRgender": (1, 0, ["M", " male", "fe male", "F\t", "Transgender", "NaN", "", "Male ", None, "x", "FEMALE"]),
    "PreRarea": (3, 1, ["Urban", " rural", "URBAN ", "village", None, "Rural", "urban"]),
    "PreRmaritalstatus": (7, 2, ["Married", "married ", " Divorcee/Seperated", "Widow/Widower", "Un  married", None,
                                 "MARRIED", "Married", "married", "married", "Married", "married", "married"]),
    "PreReducation": (5, 3, ["No formal schooling", "Up to primary school", "up to High School ", "Up to university",
                             "University completed or higher", "Specify if any", "PhD", None, "Up to intermediate"]),
    "PreRpresentoccupation": (11, 1, ["Homemaker", "Professional/Executive/Big business", "clerical/medium business",
                                      "Self-employed/ skilled", "Retired", "Unemployed(able to work)", "Farmer", None]),
    "PreRsleepquality": (13, 4, ["Very good", "fairly good", " Fairly bad", "Very bad", "ok", None]),
    "PreRmildactivityduration": (17, 0, ["At least 10 mins", "10 - 30mins", "30mins - 1hr", "1hr - 1.5hrs",
                                         ">1.5hrs", None, "a lot"]),
    "PreRmoderateduration": (19, 2, ["10 - 30mins", "At least 10 mins", None, "30mins - 1hr", "1hr - 1.5hrs"]),
    "PreRvigorousduration": (23, 3, [None, "At least 10 mins", ">1.5hrs", "10 - 30mins"]),
    "PreRskipbreakfast": (29, 1, ["Rarely/ Never", "Sometimes", "Usually/Often", "rarely/ never ", "daily", None]),
    "PreRmilk": (31, 2, ["Usually/Often", "Sometimes", "Rarely/ Never", None]),
    "PreRdiafather": (37, 0, ["Yes", "No(0)", "1", "1.0", "Y", "nan", "", "0.0", "n", "nothing", "10", None, "maybe"]),
    "PreRdiamother": (41, 5, ["No", "Yes(1)", "0", None, " yes", "none"]),
    "PreRtobuse": (43, 1, ["No", "Yes", None, "no"]),
    "PreRtobdaily": (47, 2, [None, "No", None, "Y"]),
    "PreRalcoholuse": (53, 3, ["No", None, "Yes", "No", None]),
    "PreRstaplefood": (59, 1, ["1", "1,3", "1,2,3", "4, 5", "6,6,1", "2,x", None]),
    "PreRBMItext": (61, 0, ["22.5", "31", "n/a", "", "27.25", None, "1e1"]),
}
# column -> (lowest, span, divisor, factor, modulus and residue of gaps, modulus, residue and value of outliers)
MEASURES = {
    "PreBLAge": (18, 68, 1, 7, (23, 5), (997, 3, 6262)),
    "PreRdiaage": (15, 70, 1, 11, (5, 2), None),
    "PreRheight": (110, 86, 1, 13, (19, 4), (101, 7, 0)),
    "PreRweight": (34, 89, 1, 17, (29, 6), None),
    "PreRwaist": (60, 108, 1, 19, (31, 1), None),
    "PreRhip": (60, 79, 1, 23, None, (103, 9, 0)),
    "PreRsystolicfirst": (80, 120, 1, 3, (13, 2), None),
    "PreRsystolicsecond": (80, 120, 1, 53, (11, 3), None),
    "PreRdiastolicfirst": (60, 79, 1, 59, (13, 4), None),
    "PreRdiastolicsecond": (60, 79, 1, 61, (11, 5), None),
    "PreBLHBA1C": (31, 144, 10, 37, None, None),
    "PostBLHBA1C": (32, 128, 10, 41, (20, 7), None),
    "PreBLFBS": (61, 461, 1, 43, (9, 1), None),
    "PreBLPPBS": (61, 527, 1, 47, (7, 3), None),
    "PreBLCHOLESTEROL": (59, 390, 1, 67, (17, 2), None),
    "PreBLTRIGLYCERIDES": (51, 918, 1, 71, (3, 1), None),
    "PreRstworkvalue": (0, 11, 1, 73, (37, 8), None),
    "PostRgroupname": (1, 2, 1, 1, None, None),
    "PreRtobaverage": (0, 20, 1, 79, (2, 0), None),
    "PreRlastmonthavg": (0, 15, 1, 83, (2, 1), None),
    "PreRmaritalcode": (0, 7, 1, 89, (41, 3), None),
    "PreRmildcode": (0, 7, 1, 97, (43, 2), None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that arrives in fewer splits than there are cores is dealt out over them; a large one is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _answer(key: Column, spec: tuple) -> Column:
    factor, shift, words = spec
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(key * factor + shift, F.lit(len(words))).cast("int"))


def _measure(key: Column, spec: tuple) -> Column:
    low, span, divisor, factor, gap, outlier = spec
    value = (F.pmod(key * factor, F.lit(span)) + low).cast("double") / divisor
    if outlier:
        value = F.when(F.pmod(key, F.lit(outlier[0])) == outlier[1], float(outlier[2])).otherwise(value)
    return F.when(F.pmod(key, F.lit(gap[0])) == gap[1], None).otherwise(value) if gap else value


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer sheet per order; the order status stands for the source."""
    key = F.col("o_orderkey")
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")).select(
        key.alias("id"), F.col("o_orderstatus").alias("source"),
        *[_answer(key, s).alias(c) for c, s in ANSWERS.items()],
        *[_measure(key, s).alias(c) for c, s in MEASURES.items()])


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _answer_sql(spec: tuple) -> str:
    factor, shift, words = spec
    return f"([{', '.join(text(w) for w in words)}])[1 + (o_orderkey * {factor} + {shift}) % {len(words)}]"


def _measure_sql(spec: tuple) -> str:
    low, span, divisor, factor, gap, outlier = spec
    value = f"CAST((o_orderkey * {factor}) % {span} + {low} AS DOUBLE) / {divisor}"
    if outlier:
        value = f"CASE WHEN o_orderkey % {outlier[0]} = {outlier[1]} THEN CAST({outlier[2]} AS DOUBLE) ELSE {value} END"
    return f"CASE WHEN o_orderkey % {gap[0]} = {gap[1]} THEN NULL ELSE {value} END" if gap else value


SURVEY_SQL = "SELECT o_orderkey AS id, o_orderstatus AS source, " + ", ".join(
    [f'{_answer_sql(s)} AS "{c}"' for c, s in ANSWERS.items()]
    + [f'{_measure_sql(s)} AS "{c}"' for c, s in MEASURES.items()]) + " FROM orders"


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with holes in three columns."""
    k = F.col("o_orderkey")
    hole = lambda c, factor, shift, one_in: F.when(F.pmod(k * factor + shift, F.lit(one_in)) != 0, F.col(c)).alias(c)
    return table(spark, sf_dir, "orders").select(
        k, F.col("o_orderstatus"), hole("o_totalprice", 7, 13, 10), hole("o_custkey", 3, 1, 3),
        hole("o_orderpriority", 11, 5, 4))


GAPS_SQL = """SELECT o_orderkey, o_orderstatus,
  CASE WHEN (o_orderkey * 7 + 13) % 10 <> 0 THEN o_totalprice END AS o_totalprice,
  CASE WHEN (o_orderkey * 3 + 1) % 3 <> 0 THEN o_custkey END AS o_custkey,
  CASE WHEN (o_orderkey * 11 + 5) % 4 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a known linear signal: y = 2a - b/2 + noise bounded by 0.2."""
    k = F.col("o_orderkey")
    noise = (F.pmod(k * 7919, F.lit(1000)).cast("double") / 1000 - 0.5) * 0.4
    a, b = F.col("o_totalprice") / 100000, F.col("c_acctbal") / 5000
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    joined = spread(orders).join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(k.alias("id"), F.col("o_orderstatus").alias("source"), F.col("c_mktsegment").alias("segment"),
                         a.alias("a"), b.alias("b"), (2 * a - 0.5 * b + noise).alias("y"))


PLANTED_SQL = """SELECT o_orderkey AS id, o_orderstatus AS source, c_mktsegment AS segment,
  o_totalprice / 100000 AS a, c_acctbal / 5000 AS b,
  CAST(2 AS DOUBLE) * (o_totalprice / 100000) - CAST(0.5 AS DOUBLE) * (c_acctbal / 5000)
    + (CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 - CAST(0.5 AS DOUBLE)) * CAST(0.4 AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey"""


def bucket_sql(key: str, salt: int, buckets: int) -> str:
    return f"((({key} % 1000003) + 1) * {7919 + 104729 * salt} % 999983 % {buckets})"


def split_sql(key: str, test: float = 0.2) -> str:
    return f"CASE WHEN {bucket_sql(key, 0, 100)} < {round(100 * (1 - test))} THEN 'train' ELSE 'test' END"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    value = lambda v: text(v) if isinstance(v, str) else str(v)
    return f"CASE {expr} " + " ".join(f"WHEN {value(k)} THEN {value(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def r6(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Rounds float results: sums depend on the order of their terms in the last digits."""
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})
