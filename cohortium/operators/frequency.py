"""Category frequencies, rare grouping, most frequent value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, unstage

BROADCAST_LABELS = 200_000


def relative_frequency(df: DataFrame, c: str, missing: str = "Missing") -> DataFrame:
    """(c, n, share); null counts as a category of its own."""
    label = F.coalesce(F.col(c), F.lit(missing))
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(label.alias(c)).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n").cast("double") / total))


def group_rare(df: DataFrame, c: str, threshold: float = 0.01, other: str = "Other",
               missing: str = "Missing") -> DataFrame:
    """Categories with a share strictly below ``threshold`` become ``other``.

    At most 1/threshold categories can reach the threshold, so their list is small by proof and
    is broadcast; everything without a partner in it is rare.
    """
    common = (relative_frequency(df, c, missing).where(F.col("share") >= threshold)
              .select(F.col(c).alias("_common")))
    if threshold >= 1e-4:
        common = F.broadcast(common)
    label = F.coalesce(F.col(c), F.lit(missing))
    joined = df.withColumn(c, label).join(common, F.col(c) == F.col("_common"), "left")
    return joined.withColumn(c, F.coalesce("_common", F.lit(other))).drop("_common")


def most_frequent(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by…, column, value, n): the smallest of the most frequent non-null values.

    Counted in two steps, so that a hot value or a column of many values is combined before the shuffle.
    """
    texts = df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols])
    counted = (texts.unpivot(list(by), cols, "column", "value").where("value is not null")
               .groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("value")))
    return counted.groupBy(*by, "column").agg(best.alias("b")).select(
        *by, "column", F.col("b.value").alias("value"), (-F.col("b.m")).alias("n"))


@dataclass
class Labels:
    """Labels of several columns, indexed from zero in alphabetical order: (column, label, idx) and their number by column.

    The table stays in the shared folder; the driver holds one number per column.
    """
    table: DataFrame
    sizes: dict[str, int]

    def of(self, c: str) -> DataFrame:
        """(_label, _idx) of one column, hinted for broadcast when it is small."""
        side = self.table.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("idx").alias("_idx"))
        return F.broadcast(side) if self.sizes.get(c, 0) <= BROADCAST_LABELS else side


def label_table(df: DataFrame, cols: list[str]) -> Labels:
    """The distinct values of each column with their ranks, however many there are.

    They are sorted by range partitions; a rank is the place within the partition plus the counts of those before, of which
    there is one row for each column and partition.
    """
    spark = df.sparkSession
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    distinct = texts.unpivot([], cols, "column", "label").where("label is not null").distinct()
    ordered = (distinct.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "column", "label")
               .sortWithinPartitions("column", "label"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stage(ordered.select("column", "label", F.spark_partition_id().alias("part"), place.alias("place")), "labels")
    counts = placed.groupBy("column", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    before = F.sum("n").over(Window.partitionBy("column").orderBy("part")) - F.col("n")
    starts = counts.select("column", "part", (before - F.col("least")).alias("start"))
    table = stage(placed.join(F.broadcast(starts), ["column", "part"])
                  .select("column", "label", (F.col("start") + F.col("place")).cast("int").alias("idx")), "labels")
    sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    unstage(placed)
    return Labels(table, sizes)


def category_index(df: DataFrame, cols: list[str], suffix: str = "_idx") -> tuple[DataFrame, Labels]:
    """Adds a zero-based index per column in alphabetical order; nulls stay null. Returns the labels too."""
    labels = label_table(df, cols)
    out = df
    for c in cols:
        out = (out.drop(c + suffix).join(labels.of(c), F.col(c).cast("string") == F.col("_label"), "left")
               .withColumnRenamed("_idx", c + suffix).drop("_label"))
    return out, labels


def restore_labels(df: DataFrame, index: Column, labels: Labels, c: str, to: str) -> DataFrame:
    """Adds the label of the nearest valid index of column ``c``; null for a null index."""
    from ..functions import class_index
    at = class_index(index.cast("double"), labels.sizes.get(c, 0))
    return (df.withColumn("_at", F.when(index.isNotNull(), at)).join(labels.of(c), F.col("_at") == F.col("_idx"), "left")
            .drop("_at", "_idx").withColumnRenamed("_label", to))
