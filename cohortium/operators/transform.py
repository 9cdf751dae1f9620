"""Splits, scaling, one-hot preparation, interactions, power transform."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    Interaction, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bucket
from .fill import fit_fill


def add_split(df: DataFrame, key: str, test: float = 0.2, hashed: bool = True) -> DataFrame:
    """Adds ``split`` train/test from the key alone: the same row always lands on the same side."""
    side = bucket(key, 0, 100, hashed) < round(100 * (1 - test))
    return df.withColumn("split", F.when(side, "train").otherwise("test"))


def add_fold(df: DataFrame, key: str, folds: int = 5, hashed: bool = True) -> DataFrame:
    return df.withColumn("fold", bucket(key, 99, folds, hashed))


def standardise(df: DataFrame, cols: list[str], suffix: str = "_z") -> tuple[dict, DataFrame]:
    """z-scores with the population deviation; a constant column becomes 0. One pass for all columns."""
    facts = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    moments = {c: (facts[f"m{i}"], facts[f"s{i}"] or 1.0) for i, c in enumerate(cols)}
    return moments, df.withColumns({c + suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in moments.items()})


def interactions(df: DataFrame, group: str, levels: list, markers: dict[str, str]) -> DataFrame:
    """indicator(group = level) * marker for each marker and level; a level without rows gives 0."""
    return df.withColumns({
        f"{name}_{level}": F.when(F.col(group) == level, 1.0).otherwise(0.0) * F.col(marker)
        for marker, name in markers.items() for level in levels})


def fit_preprocessor(df: DataFrame, numeric: list[str], categorical: list[str],
                     pairs: list[tuple] = (), max_labels: int = 10_000) -> PipelineModel:
    """Numbers: mean fill and z-score. Categories: most frequent fill and one-hot, unseen values all zero.

    The model keeps every label and a slot for it. A column of more than ``max_labels`` values raises ``ValueError``: group
    its rare values first (``group_rare``) or index it (``category_index``), which keeps no list. ``pairs`` are (category, number, name) products. Other columns pass through untouched. All
    stages are built-in transformers, so the result saves and loads as a PipelineModel.
    """
    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric]).first().asDict()
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)).alias(c) for c in numeric])
    moments, _ = standardise(filled, numeric)
    if categorical:
        about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in categorical]).first().asDict()
        wide = [c for c, n in about.items() if n > max_labels]
        if wide:
            raise ValueError(f"more than {max_labels} values to encode: {', '.join(wide)}")
    modes = fit_fill(df, categorical, "mode") if categorical else {}
    z = [f"(coalesce(cast(`{c}` AS double), {float(means[c] or 0.0)!r}D) - {m!r}D) / {s!r}D AS `{c}__z`"
         for c, (m, s) in moments.items()]
    text = [f"coalesce(cast(`{c}` AS string), '{_quote(modes.get(c) or '')}') AS `{c}__c`" for c in categorical]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join([*z, *text])} FROM __THIS__")
    ready = prepare.transform(df)
    stages = [prepare]
    parts = [f"{c}__z" for c in numeric]
    if categorical:
        indexer = StringIndexer(inputCols=[f"{c}__c" for c in categorical],
                                outputCols=[f"{c}__i" for c in categorical],
                                stringOrderType="alphabetAsc", handleInvalid="keep").fit(ready)
        ready = indexer.transform(ready)
        # the extra slot for unseen values is the last one, and it is the one that is dropped
        encoder = OneHotEncoder(inputCols=[f"{c}__i" for c in categorical],
                                outputCols=[c + "__o" for c in categorical], dropLast=True).fit(ready)
        stages += [indexer, encoder]
        parts += [f"{c}__o" for c in categorical]
    for category, number, name in pairs:
        if category in categorical and number in numeric:
            stages.append(Interaction(inputCols=[f"{category}__o", f"{number}__z"], outputCol=f"{name}__x"))
            parts.append(f"{name}__x")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return PipelineModel(stages)


def _quote(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def prepared(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``features``, without the working columns."""
    out = model.transform(df)
    return out.select(*[c for c in df.columns if c != "features"], "features")


def feature_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of the vector's slots from its metadata: numbers, then column_value, then product_value."""
    groups = df.schema[vector].metadata["ml_attr"]["attrs"]
    slots = sorted((a for kind in groups.values() for a in kind), key=lambda a: a["idx"])

    def readable(name):
        if "__x_" in name:
            product, parts = name.split("__x_", 1)
            return f"{product}_{parts.split(':')[0].rsplit('_', 1)[-1]}"
        return name.replace("__z", "").replace("__o", "").replace("__c", "")
    return [readable(a["name"]) for a in slots]


LARGEST_POWER = 40  # beyond it doubles overflow for values of ordinary size


def yeo_johnson_value(x: Column, power: float) -> Column:
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson(df: DataFrame, cols: list[str], grid: list[float] | None = None, refine: int = 1,
                standard: bool = True) -> tuple[dict[str, float], DataFrame]:
    """Power per column by maximum likelihood on a grid, then the transformed and standardised columns.

    All columns and all grid points share one aggregate pass; each refinement is one more pass on a
    ten times finer grid around the best point. Where the best point is an edge, the grid goes on from there.
    """
    grid = grid or [round(-2 + 0.5 * i, 6) for i in range(13)]
    trial = {c: list(grid) for c in cols}
    best: dict[str, float] = {}
    step = grid[1] - grid[0] if len(grid) > 1 else 0.5
    turn = 0
    while turn <= refine:
        aggs = [F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j{i}"))
            aggs += [F.var_pop(yeo_johnson_value(x, p)).alias(f"v{i}_{k}") for k, p in enumerate(trial[c])]
        facts = df.agg(*aggs).first()
        moved = {}
        for i, c in enumerate(cols):
            def likelihood(k):
                spread = facts[f"v{i}_{k}"]
                if not spread or not math.isfinite(spread):
                    return -math.inf
                return -facts[f"n{i}"] / 2 * math.log(spread) + (trial[c][k] - 1) * facts[f"j{i}"]
            at = max(range(len(trial[c])), key=likelihood)
            best[c] = trial[c][at]
            if at in (0, len(trial[c]) - 1) and len(trial[c]) > 1 and math.isfinite(likelihood(at)) and abs(best[c]) < LARGEST_POWER:
                way = 1 if at else -1
                moved[c] = [round(best[c] + way * step * j, 9) for j in range(len(trial[c]))]
        if moved:
            trial = {c: moved.get(c, [best[c]]) for c in cols}
            continue
        turn += 1
        step /= 10
        trial = {c: [round(best[c] + step * i, 9) for i in range(-10, 11)] for c in cols}
    out = df.withColumns({c: yeo_johnson_value(F.col(c).cast("double"), p) for c, p in best.items()})
    if standard:
        _, out = standardise(out, cols, suffix="")
    return best, out
