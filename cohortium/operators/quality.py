"""Null reports, profiles and comparisons: one aggregate over all columns, then a small unpivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage
from .quantiles import exact_quantiles


def _missing(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def null_report(df: DataFrame, cols: list[str] | None = None, by: str | None = None, flag_above: float = 30.0,
                overall: str = "ALL") -> DataFrame:
    """(source, column, rows, nulls, null_pct, flagged) for each source and over all of them.

    Rows are counted once per source; the overall line is rolled up from those few rows.
    """
    cols = [c for c in (cols or df.columns) if c in df.columns and c != by]
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(_missing(df, c)).alias(c) for c in cols]]
    if by is None:
        wide = df.agg(*counts).withColumn("source", F.lit(overall))
    else:
        per_source = df.groupBy(F.col(by).alias("source")).agg(*counts)
        totals = [F.sum(c).alias(c) for c in ["rows", *cols]]
        wide = per_source.rollup("source").agg(F.grouping("source").alias("is_total"), *totals).withColumn(
            "source", F.when(F.col("is_total") == 1, overall).otherwise(F.col("source").cast("string")))
    long = wide.unpivot(["source", "rows"], cols, "column", "nulls")
    pct = F.try_divide(F.col("nulls") * 100.0, F.col("rows"))  # null for a table without rows
    flagged = F.coalesce(pct > flag_above, F.lit(False))
    return long.select("source", "column", "rows", "nulls", pct.alias("null_pct"), flagged.alias("flagged"))


def monitored_report(frames: dict[str, DataFrame], wanted: list[str], flag_above: float = 30.0) -> DataFrame:
    """Null report over the union of the frames that have at least one watched column."""
    from .columns import keep_columns, union_all
    usable = {n: keep_columns(d, wanted) for n, d in frames.items() if set(wanted) & set(d.columns)}
    if not usable:
        raise ValueError("no frame has a watched column")
    return null_report(union_all(usable), wanted, by="source", flag_above=flag_above)


def completion(before: Column, after: Column) -> Column:
    """Percent of the gaps that were filled; 100 when there was none."""
    return F.when(before > 0, (before - after) * 100.0 / before).otherwise(F.lit(100.0))


def missing_total(df: DataFrame, cols: list[str] | None = None, by: str | None = None) -> DataFrame:
    """(source, missing) over all cells of a table."""
    cols = [c for c in (cols or df.columns) if c != by]
    source = F.col(by) if by else F.lit("ALL")
    total = sum((F.count_if(_missing(df, c)) for c in cols), F.lit(0))
    return df.groupBy(source.alias("source")).agg(total.alias("missing"))


def profile(df: DataFrame, cols: list[str] | None = None, by: str | None = None, max_values: int = 12,
            exact: bool = True) -> DataFrame:
    """One row per (source, column): type, rows, missing %, unique values, min, max, range, mean, median, values.

    ``values`` lists the distinct values when there are at most ``max_values``. ``exact=False`` uses
    sketches for the unique count and the median and lists no values: a single lazy pass. The exact
    form runs that pass at once, to learn which columns can have a list at all.
    """
    cols = [c for c in (cols or df.columns) if c != by]
    source = F.col(by).cast("string") if by else F.lit("ALL")
    numeric = [c for c in cols if _numeric(df, c)]
    tidy = df.select(source.alias("source"), *[F.when(~_missing(df, c), F.col(c)).alias(c) for c in cols])

    stats = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        stats.append(F.count(c).alias(f"c{i}"))
        if c in numeric:
            v = F.col(c).cast("double")
            stats += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"av{i}")]
            if not exact:
                stats.append(F.percentile_approx(v, 0.5, 10_000).alias(f"md{i}"))
        stats.append(F.approx_count_distinct(c).alias(f"u{i}"))
    null = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(cols):
        n = c in numeric
        fields = [F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                  (F.col("rows") - F.col(f"c{i}")).alias("missing"),
                  F.try_divide((F.col("rows") - F.col(f"c{i}")) * 100.0, F.col("rows")).alias("missing_pct"),
                  (F.col(f"lo{i}") if n else null).alias("min"), (F.col(f"hi{i}") if n else null).alias("max"),
                  ((F.col(f"hi{i}") - F.col(f"lo{i}")) if n else null).alias("range"),
                  (F.col(f"av{i}") if n else null).alias("mean")]
        fields.append(F.col(f"u{i}").alias("unique"))
        if not exact:
            fields.append((F.col(f"md{i}") if n else null).alias("median"))
        rows.append(F.struct(*fields))
    base = tidy.groupBy("source").agg(*stats).select("source", "rows", F.inline(F.array(*rows)))
    if not exact:
        return base

    keys = ["source", "column"]
    base = stage(base.withColumnRenamed("unique", "about"), "profile")  # one row per source and column
    # four times the limit leaves the sketch room to be wrong
    about = base.groupBy("column").agg(F.min("about").alias("least"), F.max("about").alias("most")).collect()
    short = [r["column"] for r in about if r["most"] <= 4 * max_values]
    mixed = [r["column"] for r in about if r["least"] <= 4 * max_values < r["most"]]
    found = value_summary(tidy, cols, max_values, short, mixed)
    joined = base.drop("about").join(found, keys, "left").withColumn(
        "unique", F.coalesce("unique", F.lit(0)))
    if numeric:
        medians = exact_quantiles(tidy, numeric, [0.5], by=["source"]).select(*keys, F.col("quantile").alias("median"))
        return joined.join(medians, keys, "left")
    return joined.withColumn("median", null)


def _typed(df: DataFrame, c: str) -> Column:
    """(column, i, d, s): the value in the one type in which it can be told apart exactly."""
    kind = df.schema[c].dataType
    whole = isinstance(kind, T.IntegralType)
    real = isinstance(kind, (T.DoubleType, T.FloatType))
    pick = lambda use, t: (F.col(c) if use else F.lit(None)).cast(t)
    return F.struct(F.lit(c).alias("column"), pick(whole, "bigint").alias("i"), pick(real, "double").alias("d"),
                    pick(not whole and not real, "string").alias("s"))


def value_summary(tidy: DataFrame, cols: list[str], max_values: int, short: list[str],
                  mixed: list[str] = (), always: bool = False) -> DataFrame:
    """(source, column, unique, values): distinct values counted in two steps, listed only when few.

    ``short`` columns are known to have few values everywhere, so their lists are gathered as they
    are. ``mixed`` ones have few only in some sources: they pass a rank-limited window, in which a
    source of many values never gathers in one task. With ``always`` they list their first
    ``max_values`` however many there are.
    """
    keys, value = ["source", "column"], F.struct("i", "d", "s")
    values = tidy.select("source", F.inline(F.array(*[_typed(tidy, c) for c in cols])))
    distinct = values.where("i is not null or d is not null or s is not null").distinct()

    def shown(c):
        return F.transform(F.array_sort(c), lambda v: F.coalesce(v["i"].cast("string"), v["d"].cast("string"), v["s"]))
    out = distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique"), F.collect_list(F.when(F.col("column").isin(short), value)).alias("v"))
    listed = F.when(F.size("v").between(1, max_values), shown("v"))
    out = out.select(*keys, "unique", listed.alias("values"))
    if not mixed:
        return out
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    few = (distinct.where(F.col("column").isin(mixed)).withColumn("r", rank)
           .where(F.col("r") <= max_values + (0 if always else 1)).groupBy(*keys)
           .agg(F.collect_list(value).alias("v")))
    few = few.select(*keys, F.when(F.size("v") <= max_values, shown("v")).alias("more"))
    return out.join(few, keys, "left").select(*keys, "unique", F.coalesce("values", "more").alias("values"))


def describe_profile(profiled: DataFrame) -> DataFrame:
    """Adds the sentence a report shows: listed values, else a range, else a count of values."""
    listed = F.when(F.col("missing") > 0, F.concat("values", F.array(F.lit("NaN")))).otherwise(F.col("values"))
    text = (F.when(F.col("values").isNotNull(), F.concat(F.lit("Values: ["), F.array_join(listed, ", "), F.lit("]")))
            .when(F.col("min").isNotNull(), F.concat(F.lit("Range: "), F.format_string("%.1f", "min"), F.lit(" - "),
                                                      F.format_string("%.1f", "max")))
            .otherwise(F.concat(F.col("unique").cast("string"), F.lit(" unique values"))))
    return profiled.withColumn("summary", text)


def cross_verify(df: DataFrame, by: str, sources: list[str], cols: list[str] | None = None,
                 max_values: int = 12) -> DataFrame:
    """Columns × sources, each cell a sentence about the values found there."""
    told = describe_profile(profile(df, cols, by=by, max_values=max_values))
    return told.groupBy("column").pivot("source", sources).agg(F.first("summary"))


def column_detail(df: DataFrame, cols: list[str], samples: int = 5) -> DataFrame:
    """(column, type, unique, missing, samples): the samples are the first distinct values in order."""
    tidy = df.select(F.lit("ALL").alias("source"), *[F.when(~_missing(df, c), F.col(c)).alias(c) for c in cols])
    found = value_summary(tidy, cols, samples, [], cols, always=True).select(
        "column", "unique", F.array_join("values", ", ").alias("samples"))
    base = tidy.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in cols]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                 (F.col("rows") - F.col(c)).alias("missing")) for c in cols])))
    return base.join(found, "column", "left").withColumn("unique", F.coalesce("unique", F.lit(0)))


def target_summary(df: DataFrame, target: str, by: list[str] = ()) -> DataFrame:
    """Mean, sample deviation, min, max, count and exact quartiles."""
    v = F.col(target).cast("double")
    keys = list(by)
    base = df.groupBy(*keys).agg(F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"),
                                 F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                 F.min(v).alias("min"), F.max(v).alias("max"))
    quartiles = exact_quantiles(df, [target], [0.25, 0.5, 0.75], by=keys)
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    wide = quartiles.groupBy(*keys).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()])
    # a single summary row has no key; a constant one lets both sides meet in an equi-join
    if not keys:
        return base.withColumn("k", F.lit(1)).join(wide.withColumn("k", F.lit(1)), "k", "left").drop("k")
    return base.join(wide, keys, "left")


def for_reference_columns(report: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of a report whose column is named by another dataset."""
    return report.join(names.select("column").distinct(), "column", "left_semi")


def compare_reports(before: DataFrame, after: DataFrame, value: str = "null_pct") -> DataFrame:
    """(column, before, after) as text, '-' where a side has no such column."""
    joined = before.select("column", F.col(value).alias("b")).join(
        after.select("column", F.col(value).alias("a")), "column", "full_outer")
    text = lambda n: F.when(F.col(n).isNull(), "-").otherwise(F.format_string("%.2f", F.col(n)))
    return joined.select("column", text("b").alias("before"), text("a").alias("after"))
