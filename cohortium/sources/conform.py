"""Header clean-up, renames and numeric coercion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_header(name: str) -> str:
    """Runs of other characters become one underscore; outer underscores go."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]+", "_", name.strip())).strip("_")


def normalise_headers(df: DataFrame, sanitize: bool = True) -> DataFrame:
    names = [clean_header(c) if sanitize else c.strip() for c in df.columns]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"headers collide after clean-up: {sorted(twice)}")
    return df.toDF(*names)


def resolve_column(df: DataFrame, name: str) -> str:
    """Exact clean name, else the first column that contains it in any case, else an error."""
    clean = clean_header(name)
    if clean in df.columns:
        return clean
    for c in df.columns:
        if clean.lower() in c.lower():
            return c
    raise ValueError(f"no column like {name}")


def to_number(df: DataFrame, cols: list[str]) -> DataFrame:
    """Unparsable text and NaN become null."""
    def number(c):
        value = F.col(c).try_cast("double")
        return F.when(~F.isnan(value), value)
    return df.withColumns({c: number(c) for c in cols if c in df.columns})


def conform(df: DataFrame, numeric: list[str] = (), renames: dict[str, str] | None = None,
            sanitize: bool = True) -> DataFrame:
    out = normalise_headers(df, sanitize).withColumnsRenamed(renames or {})
    return to_number(out, list(numeric))
