"""Column choice, row filters, unions, limits and accounting."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import bucket


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Requested columns that exist, in requested order; the whole frame if none does."""
    present = [c for c in wanted if c in df.columns]
    return df.select(*present) if present else df


def missing_columns(df: DataFrame, wanted: list[str], source: str) -> DataFrame:
    """One row per requested column: source, rows of the source, column, present."""
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present")) for c in wanted])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(source).alias("source"), "rows", F.inline(listed))


def assign_where(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def enough_rows(df: DataFrame, at_least: int) -> bool:
    """Gate before an expensive step; reads no more than ``at_least`` rows."""
    return df.select(F.lit(1)).limit(at_least).count() >= at_least


def union_all(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All columns of all frames by name, null where a frame has none, tagged by source."""
    tagged = [df.withColumn(source, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def union_common(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Only the columns that every frame has."""
    shared = sorted(set.intersection(*[set(df.columns) for df in frames.values()]))
    tagged = [df.select(*shared, F.lit(name).alias(source)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def combo_names(sources: list[str], sizes=(1, 2, 3)) -> dict[str, list[str]]:
    return {" + ".join(c): list(c) for n in sizes for c in combinations(sources, n)}


def combos(df: DataFrame, source: str, sources: list[str], sizes=(1, 2, 3)) -> DataFrame:
    """Each row once per combination of sources it belongs to, tagged ``combo``.

    A narrow step: the memberships of a source are a literal, so nothing is joined or shuffled.
    """
    named = combo_names(sources, sizes)
    member = None
    for s in sources:
        value = F.array(*[F.lit(name) for name, parts in named.items() if s in parts])
        member = F.when(F.col(source) == s, value) if member is None else member.when(F.col(source) == s, value)
    return df.withColumn("combo", F.explode(member))


def _steps(steps: list[tuple[str, Column]]) -> tuple[Column, list[Column]]:
    """The condition of all steps together, and the counts n0, n1, … of the rows that are left after each."""
    passed, kept = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (_, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        kept.append(F.count_if(passed).alias(f"n{i}"))
    return passed, kept


def filter_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter, applied in order: step, rows_before, rows_after, dropped. One pass."""
    _, kept = _steps(steps)
    rows = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("step"), F.col(f"n{i - 1}").alias("rows_before"),
                 F.col(f"n{i}").alias("rows_after"), (F.col(f"n{i - 1}") - F.col(f"n{i}")).alias("dropped"))
        for i, (name, _) in enumerate(steps, 1)])
    return df.agg(*kept).select(F.inline(rows))


def write_filtered(df: DataFrame, steps: list[tuple[str, Column]], path: str) -> DataFrame:
    """Writes the rows that pass all steps, in place of an earlier table, and returns the account of ``filter_steps``.

    The write itself observes the counts, so that the rows are read once.
    """
    passed, kept = _steps(steps)
    seen = Observation()
    df.observe(seen, *kept).where(passed).write.mode("overwrite").parquet(path)
    left = [seen.get[f"n{i}"] for i in range(len(steps) + 1)]
    rows = [(i, name, left[i - 1], left[i], left[i - 1] - left[i]) for i, (name, _) in enumerate(steps, 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, step string, rows_before bigint, rows_after bigint, dropped bigint")


def cap_rows(df: DataFrame, key: str, rows: int, hashed: bool = True) -> DataFrame:
    """A repeatable sample of ``rows`` rows: those with the smallest spread key."""
    if hashed:
        spread = F.xxhash64(key)
    else:
        spread = bucket(key, 1, 100_003)
    return df.orderBy(spread, key).limit(rows)


def head_and_shape(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """First rows by key, with row count and column count beside them."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(key).limit(rows).select(
        "*", total.alias("total_rows"), F.lit(len(df.columns)).alias("total_columns"))
