"""Mergeable moment matrices by group: counts, sums and products of columns in one pass, summed in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_groups(df: DataFrame, values: Column, shift: list[float], by: list[Column] = ()) -> dict[tuple, np.ndarray]:
    """Per group of ``by``: the sum over rows of ``z z'`` for ``z = (1, values - shift)``; one group ``()`` without ``by``.

    ``values`` is an array without nulls, as long as ``shift``. Entry [0, 0] is the number of rows, row 0 has the sums. Such
    matrices add up over groups and are taken away from each other. Each group reaches the driver as one vector, so that the
    groups have to be few; a ``shift`` near the means saves digits.
    """
    width = len(shift) + 1
    centred = F.zip_with(values, F.array(*(F.lit(float(s)) for s in shift)), lambda a, b: a - b)
    whole = F.transform(F.array(F.concat(F.array(F.lit(1.0)), centred)), lambda z: F.flatten(F.transform(
        z, lambda a, i: F.transform(F.slice(z, i + 1, F.lit(width)), lambda b: a * b))))[0]
    names = [f"g{i}" for i in range(len(by))]
    rows = df.select(F.lit(0).alias("all"), *(g.alias(name) for g, name in zip(by, names)), array_to_vector(whole).alias("products"))
    sums = rows.groupBy("all", *names).agg(Summarizer.sum(F.col("products")).alias("products"))  # no row at all, no group
    upper, out = np.triu_indices(width), {}
    for r in sums.collect():
        matrix = np.zeros((width, width))
        matrix[upper] = r["products"].toArray()
        out[tuple(r[name] for name in names)] = matrix + np.triu(matrix, 1).T
    return out


def centred(total: np.ndarray, shift: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred products) of a sum of moment matrices."""
    n = int(round(total[0, 0]))
    mean = total[0, 1:] / n
    return n, mean + shift, total[1:, 1:] - n * np.outer(mean, mean)
