"""Exact quantiles in two distributed passes.

``percentile`` keeps every distinct value of a group in one buffer. Here a sketch brackets each
quantile, and only the thin band of values inside the bracket is counted and ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import small_side

ACCURACY = 20_000
STRIPS = 1024


def to_long(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by…, column, value double), nulls and NaN left out."""
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = values.unpivot(list(by), cols, "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] = (),
                    interpolate: bool = True) -> DataFrame:
    """(by…, column, prob, quantile). Interpolated as ``median`` does it, or the value at rank ceil(p*n).

    Runs one job for the brackets; the result is lazy.
    """
    keys = [*by, "column"]
    long = to_long(df, cols, by)
    slack = 2.0 / ACCURACY
    order = sorted(range(len(probs)), key=lambda k: probs[k])
    ends = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    aggs, rows = [], []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"n{i}"), F.percentile_approx(v, ends, ACCURACY).alias(f"e{i}")]
        rows.append(F.struct(F.lit(c).alias("_column"), F.col(f"n{i}").alias("n"),
                             F.array(*[F.col(f"e{i}")[2 * k] for k in order]).alias("lows"),
                             F.array(*[F.col(f"e{i}")[2 * k + 1] for k in order]).alias("highs")))
    # all columns in one wide aggregate, then one row per (group, column) with all its brackets
    sketch = (df.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(*aggs)
              .select(*[f"_{b}" for b in by], F.inline(F.array(*rows))))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = long.join(small_side(sketch), same)
    # each value goes to one place: its strip of a bracket, or the gap behind the brackets below it. A bracket is cut into
    # strips, so that no task orders more than a strip of it
    begun = sum(((F.col("lows")[i] <= F.col("value")).cast("int") for i in range(len(probs))), F.lit(0))
    ended = sum(((F.col("highs")[i] < F.col("value")).cast("int") for i in range(len(probs))), F.lit(0))
    low, high = (F.get(side, F.col("begun") - 1) for side in ("lows", "highs"))
    along = F.coalesce(F.try_divide(F.col("value") - low, high - low), F.lit(0.0))
    strip = F.col("begun") * (STRIPS + 2) + F.when(F.col("held"), F.floor(along * STRIPS)).otherwise(STRIPS + 1)
    counted = (met.withColumn("begun", begun).withColumn("held", F.col("begun") > ended)
               .groupBy(*keys, "n", strip.alias("strip"), F.when(F.col("held"), F.col("value")).alias("inside"))
               .agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    strips = counted.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("strip").alias("_strip")).agg(F.sum("c").alias("in_strip"))
    before = F.sum("in_strip").over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_strip")
                                    .rowsBetween(Window.unboundedPreceding, -1))
    strips = strips.withColumn("before", F.coalesce(before, F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "strip"]]
    upto = F.sum("c").over(Window.partitionBy(*keys, "strip").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counted.withColumn("upto", upto).join(strips, same).withColumn("last", F.col("before") + F.col("upto"))
    ranks = ranks.withColumn("first", F.col("last") - F.col("c") + 1)

    def at(rank):
        # a gap is one row; only its ends, next to a bracket, can be asked for
        value = F.when(F.col("inside").isNotNull() | (rank == F.col("first")), F.col("lo")).when(rank == F.col("last"), F.col("hi"))
        return F.max(F.when(rank.between(F.col("first"), F.col("last")), value))

    n, picked, out = F.col("n"), [], []
    for i, p in enumerate(map(float, probs)):
        spot = F.lit(p) * (n - 1)
        if interpolate:
            picked += [at(F.floor(spot) + 1).alias(f"a{i}"), at(F.ceil(spot) + 1).alias(f"b{i}")]
            value = F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (spot - F.floor(spot))
        else:
            picked.append(at(F.greatest(F.ceil(F.lit(p) * n), F.lit(1))).alias(f"a{i}"))
            value = F.col(f"a{i}")
        out.append(F.struct(F.lit(p).alias("prob"), value.alias("quantile")))
    return ranks.groupBy(*keys, "n").agg(*picked).select(*keys, F.inline(F.array(*out)))
