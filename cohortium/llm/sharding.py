"""Shards along a Hilbert curve through several metadata dimensions.

Every dimension is quantised to the same number of bits; rows are sorted by their place on the curve and cut into runs of
equal row counts. Rows of a shard are near each other in all dimensions, so filters on any of them skip shards. Only the
key, the dimensions and the digests travel, never the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .texts import importable

BITS = 8


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (one column per dimension, values below 2**bits).

    From the highest bit down, each cell's octant is read in Gray code while the axes are reflected and exchanged as the
    curve turns; the bits of all axes, interleaved, are then the index.
    """
    axes = points.astype(np.uint64).T.copy()
    dims = len(axes)
    high = np.uint64(1 << (bits - 1))
    level = high
    while level > 1:
        low = level - np.uint64(1)
        for i in range(dims):
            turned = (axes[i] & level) != 0
            swap = np.where(turned, 0, (axes[0] ^ axes[i]) & low).astype(np.uint64)
            axes[0] ^= np.where(turned, low, swap).astype(np.uint64)
            axes[i] ^= swap
        level >>= np.uint64(1)
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    flip = np.zeros_like(axes[0])
    level = high
    while level > 1:
        flip ^= np.where((axes[-1] & level) != 0, level - np.uint64(1), 0).astype(np.uint64)
        level >>= np.uint64(1)
    axes ^= flip
    index = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << np.uint64(1)) | ((axes[i] >> np.uint64(bit)) & np.uint64(1))
    return index.astype(np.int64)


def quantised_text(c: str, bits: int = BITS) -> Column:
    """A cell for a category: by hash, as categories have no order. Null is 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << bits)), F.lit(0)).cast("int")


def quantised_size(c: Column, bits: int = BITS) -> Column:
    """A cell for a size: logarithmic, some eight cells for each doubling. Null and negative values are 0."""
    cell = F.floor(F.log2(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) + 1.0) * 8)
    return F.least(cell, F.lit((1 << bits) - 1)).cast("int")


def quantised_ranges(df: DataFrame, c: str, bits: int = BITS) -> Column:
    """A cell for a number: ranges of about equal row counts, whatever the numbers are, in their order. Null is 0.

    The bounds are quantiles over all rows of ``df``, found by one job; 2**bits - 1 numbers reach the driver.
    """
    cells = 1 << bits
    bounds = df.agg(F.percentile_approx(c, [i / cells for i in range(1, cells)], 100 * cells)).first()[0] or []

    def cell(first: int, end: int) -> Column:
        """The cell of ``c``, which is in first..end - 1, by halving."""
        if end - first == 1:
            return F.lit(first)
        middle = (first + end) // 2
        return F.when(F.col(c) < F.lit(bounds[middle - 1]), cell(first, middle)).otherwise(cell(middle, end))

    return F.when(F.col(c).isNull(), 0).otherwise(cell(0, len(bounds) + 1)).cast("int")


def hilbert_shards(df: DataFrame, shards: int, dimensions: list[Column], key: str = "doc_id", bits: int = BITS,
                   carry: list[str] | None = None) -> DataFrame:
    """Each row's place: ``key``, the columns ``carry``, curve (index), shard (from 0) and slot (gapless from 0).

    ``dimensions`` are columns of integers from 0 to 2**bits - 1. Shards differ by at most one row. Rows of one cell are
    ordered by ``key``, null first, and spread over ranges where a cell is large; ties beyond have any order. An empty
    table gives an empty result. The sorted rows are written once, as their numbers must not change between two reads.
    """
    importable(df)

    @F.pandas_udf("long")
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    rows = df.select(key, *(carry or []), F.struct(*(d.alias(f"d{i}") for i, d in enumerate(dimensions))).alias("_cells"))
    rows = rows.withColumn("curve", curve("_cells")).drop("_cells")
    tie = F.xxhash64(*(rows[c] for c in rows.columns))
    # range and place of a row in its range: high and low bits of the increasing id
    placed = stage(rows.repartitionByRange(F.col("curve"), F.col(key), tie).sortWithinPartitions("curve", key)
                   .withColumn("_at", F.monotonically_increasing_id()), "curve")
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range, so the window over all of them is as small as the number of partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.withColumn("_total", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    rank = F.col("_before") + F.col("_at")
    shard = F.expr(f"int((_before + _at) * {int(shards)} div _total)")
    start = F.expr(f"(shard * _total + {int(shards) - 1}) div {int(shards)}")
    return (placed.join(F.broadcast(sizes), "_range").withColumn("shard", shard)
            .withColumn("slot", rank - start).drop("_range", "_at", "_n", "_before", "_total"))


def write_shards(df: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """The rows of ``df`` as Parquet, one folder per shard, in curve order; ``key`` must be unique."""
    joined = df.join(placed.select(key, "curve", "shard", "slot"), key)
    (joined.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
