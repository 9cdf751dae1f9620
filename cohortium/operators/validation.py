"""Record validation and JSON ingest. A failing record is kept with its reasons, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_violations(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """Adds ``violations``: array of (field, rule). A rule is (field, required, low, high)."""
    checks = []
    for field, required, low, high in rules:
        if field not in df.columns:
            if required:
                checks.append(F.struct(F.lit(field).alias("field"), F.lit("required").alias("rule")))
            continue
        c = F.col(field)
        absent = c.isNull()
        if isinstance(df.schema[field].dataType, T.StringType):
            absent = absent | (c == "")
        elif isinstance(df.schema[field].dataType, (T.DoubleType, T.FloatType)):
            absent = absent | F.isnan(c)
        tests = [(absent, "required")] if required else []
        if low is not None:
            tests.append((~absent & (c < low), f"ge {low:g}"))
        if high is not None:
            tests.append((~absent & (c > high), f"le {high:g}"))
        for test, name in tests:
            checks.append(F.when(test, F.struct(F.lit(field).alias("field"), F.lit(name).alias("rule"))))
    return df.withColumn("violations", F.filter(F.array(*checks), lambda v: v.isNotNull()))


def validate(df: DataFrame, rules: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``violations``)."""
    tagged = with_violations(df, rules)
    ok = F.size("violations") == 0
    return tagged.where(ok).drop("violations"), tagged.where(~ok)


def write_validated(df: DataFrame, rules: list[tuple], path: str) -> dict[str, int]:
    """Valid and quarantined rows written in one pass, below ``path`` in valid=true and valid=false; their numbers.

    The numbers are observed by the write itself, so that the rows are read and checked once. Violations of valid rows are
    empty. An earlier table at ``path`` is replaced. ``read_validated`` reads both parts.
    """
    tagged = with_violations(df, rules).withColumn("valid", F.size("violations") == 0)
    seen = Observation()
    tagged = tagged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid"),
                            F.coalesce(F.sum(F.size("violations")), F.lit(0)).alias("violations"))
    tagged.write.mode("overwrite").partitionBy("valid").parquet(path)
    counts = seen.get
    return {"rows": counts["rows"], "valid": counts["valid"], "quarantined": counts["rows"] - counts["valid"],
            "violations": counts["violations"]}


def read_validated(spark, path: str, like: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``violations``) of a written table; ``like`` tells the columns of its rows.

    The part is chosen by its folder, so that the other one is not opened.
    """
    found = "array<struct<field:string,rule:string>>"
    schema = T.StructType([*like.schema.fields, T.StructField("violations", T._parse_datatype_string(found)),
                           T.StructField("valid", T.BooleanType())])
    both = spark.read.schema(schema).parquet(path)
    return both.where("valid").drop("valid", "violations"), both.where("NOT valid").drop("valid")


def violations_long(df: DataFrame, rules: list[tuple], key: list[str]) -> DataFrame:
    return with_violations(df, rules).select(*key, F.inline("violations"))


def record_schema(types: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in types.items())


def parse_records(df: DataFrame, json_col: str, types: dict[str, str]) -> DataFrame:
    """Known fields of a JSON object as columns; unknown keys are ignored, bad JSON sets ``bad_record``."""
    schema = record_schema({**types, "_bad": "string"})
    parsed = F.from_json(F.col(json_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in df.columns if c not in types]
    return df.withColumn("_r", parsed).select(
        *rest, *[F.col(f"_r.{n}").alias(n) for n in types],
        (F.col("_r").isNull() | F.col("_r._bad").isNotNull()).alias("bad_record"))
