"""Exact duplicates by a content sort, with DataFrame functions only.

Rows are range-partitioned by their bytes at sampled splitters, sorted by them, on disk where need be, and compared in
full with their neighbours. The splitters see the first characters and a hash of the lower-cased text, so that the sample
that Spark takes for them stays small; equal texts agree in both and meet in one range.

A text with so many copies that its range would stand out does not enter the sort: its copies are combined where they are
read, before any shuffle, and compared in full by the grouping. Such texts are found by counting hashes of all rows; since
each has more than a fixed share of the rows there are at most ``8 * partitions`` of them, which bounds what is broadcast.

A row travels as one struct, so that no column of the user's clashes with those made here, whatever its name or type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .texts import whole_row

LEAST_HOT = 64
EDGE = 24  # characters of a text in its splitter key
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased and nothing else changed; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def hot_hashes(rows: DataFrame, partitions: int) -> DataFrame:
    """Values of ``hash`` that more than 1 / (8 * partitions) of the rows have, and over ``LEAST_HOT`` rows."""
    most = max(LEAST_HOT, rows.count() // (8 * partitions))
    return rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select("hash")


def grouped(df: DataFrame, key: str, text: str, keep: str) -> DataFrame:
    """``row`` (all columns of ``df``) with the columns of RESULT."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_key, own_text = F.col("row")[key], F.col("row")[text]
    lowered = F.lower(F.coalesce(own_text, F.lit("")))  # coarser than equality, which decides nothing but the range
    hashed = df.select(whole_row(df)).withColumn("hash", F.xxhash64(lowered))
    hot = stage(hot_hashes(hashed.select("hash"), partitions), "hot-texts")
    some_hot = not hot.isEmpty()

    cool = hashed.join(F.broadcast(hot), "hash", "left_anti") if some_hot else hashed
    cool = cool.withColumn("edge", F.substring(lowered, 1, EDGE)).repartitionByRange(F.col("edge"), F.col("hash"))
    equal = Window.partitionBy("edge", "hash", "content").orderBy(
        F.asc_nulls_first("key") if keep == "smallest" else F.desc_nulls_last("key"))
    group = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = cool.withColumn("content", normalised(own_text)).withColumn("key", own_key).select(
        "row", F.first("key").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(equal) == 1).alias("kept"), F.sha2("content", 256).alias("text_sha256"))
    if not some_hot:
        return found

    # written once, so that the number that tells rows of equal key apart is the same at every read
    many = stage(hashed.join(F.broadcast(hot), "hash", "left_semi").withColumn("number", F.monotonically_increasing_id()), "hot-rows")
    many = many.withColumn("content", normalised(own_text))
    place = F.struct(own_key.alias("key"), (F.col("number") if keep == "smallest" else -F.col("number")).alias("number"))
    totals = many.groupBy("hash", "content").agg(
        (F.min(place) if keep == "smallest" else F.max(place)).alias("best"), F.count(F.lit(1)).alias("group_size"))
    totals = stage(totals.select(F.sha2("content", 256).alias("text_sha256"), "best", "group_size"), "hot-totals")
    many = many.withColumn("text_sha256", F.sha2("content", 256)).withColumn("place", place).join(F.broadcast(totals), "text_sha256")
    return found.unionByName(many.select(
        "row", F.col("best")["key"].alias("keep_id"), "group_size", F.col("place").eqNullSafe(F.col("best")).alias("kept"), "text_sha256"))


def exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """``df`` with keep_id (key of the row that stays), group_size, kept and text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the smallest
    (``keep="largest"``: largest) key stays; of rows that share this key too, one. A null key is smaller than any other.
    Existing columns of the result's names are replaced, all others stay as they are. An empty table gives an empty result.
    """
    found = grouped(df, key, text, keep)
    return found.select(*(F.col("row")[c].alias(c) for c in df.columns if c not in RESULT), *RESULT)


def drop_exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, whole and unchanged: one of each group of equal texts."""
    return grouped(df, key, text, keep).where("kept").select(*(F.col("row")[c].alias(c) for c in df.columns))
