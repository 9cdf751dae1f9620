"""Lookups of codes, labels and texts in small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import lookup


def decode(c: Column, concept: str, codebook: dict = rules.CODEBOOK, default: str = "—") -> Column:
    """Label of an integer code, ``default`` on a miss."""
    return F.coalesce(lookup(c.cast("int"), codebook[concept]), F.lit(default))


def encode(c: Column, concept: str, codebook: dict = rules.CODEBOOK) -> Column:
    return lookup(c, {label: code for code, label in codebook[concept].items()})


def attach(df: DataFrame, dimension: DataFrame, on: list[str], defaults: dict | None = None) -> DataFrame:
    """Left lookup in a dimension table; the optimizer picks the strategy from its real size."""
    joined = df.join(dimension, on, "left")
    for c, value in (defaults or {}).items():
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.lit(value)))
    return joined


def advise(df: DataFrame, band_col: str, advice: list[tuple] | None = None) -> DataFrame:
    """Several advice rows per record by its band. The fixed table is a literal, so nothing is shuffled."""
    picked = None
    by_band: dict[str, list] = {}
    for band, order, title, text in advice or rules.advice_rows():
        by_band.setdefault(band, []).append(F.struct(
            F.lit(order).alias("ord"), F.lit(title).alias("title"), F.lit(text).alias("text")))
    for band, items in by_band.items():
        test = F.col(band_col) == band
        picked = F.when(test, F.array(*items)) if picked is None else picked.when(test, F.array(*items))
    return df.select("*", F.inline(picked))
