"""Feature ranking: binned mutual information and forest importance."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stage, unstage
from .fill import fit_fill
from .frequency import category_index
from .neighbours import fill_knn, fill_knn_category
from .quantiles import exact_quantiles
from .trees import Forest, ForestClassifier


def _text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def bin_columns(df: DataFrame, cols: list[str], bins: int = 10) -> dict[str, Column]:
    """Bin label per column: a quantile bin of a number, the value itself of a text, NA of a null."""
    numeric = [c for c in cols if not _text(df, c)]
    probs = [i / bins for i in range(1, bins)]
    edges: dict[str, list] = {c: [] for c in numeric}
    if numeric:
        for r in exact_quantiles(df, numeric, probs, interpolate=False).collect():
            edges[r["column"]].append(r["quantile"])
    out = {}
    for c in cols:
        if c in edges:
            above = sum((F.when(F.col(c) > e, 1).otherwise(0) for e in sorted(set(edges[c]))), F.lit(0))
            label = above.cast("string")
        else:
            label = F.col(c)
        out[c] = F.when(F.col(c).isNull(), "NA").otherwise(label)
    return out


def _joint_counts(binned: DataFrame, pairs: list[tuple[str, str]], coded: dict[str, int]) -> DataFrame:
    """(pair, x, y, n): how often the values of each pair of columns meet, counted batch by batch.

    ``coded`` columns hold bin numbers 0..size-1: a partition keeps one array of counts for each pair of them. The values of
    texts are counted within a batch, so that no task holds all of them.
    """
    def count(batches):
        held = {i: np.zeros(coded[x] * coded[y], np.int64) for i, (x, y) in enumerate(pairs) if x in coded and y in coded}

        def rows(i, joint, n, x_names, y_names, width):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(joint), i, np.int32)), x_names.take(pa.array(joint // width)),
                 y_names.take(pa.array(joint % width)), pa.array(n, pa.int64())], ["pair", "x", "y", "n"])

        numbers = {c: pa.array([str(v) for v in range(size)]) for c, size in coded.items()}
        for batch in batches:
            codes, names = {}, dict(numbers)
            for c in batch.schema.names:
                column = batch.column(c)
                if c not in coded:
                    column = column.dictionary_encode()
                    names[c], column = column.dictionary, column.indices
                codes[c] = column.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (x, y) in enumerate(pairs):
                joint = codes[x] * len(names[y]) + codes[y]
                if i in held:
                    held[i] += np.bincount(joint, minlength=len(held[i]))
                elif len(joint):
                    yield rows(i, *np.unique(joint, return_counts=True), names[x], names[y], len(names[y]))
        for i, counts in held.items():
            x, y = pairs[i]
            met = np.flatnonzero(counts)
            yield rows(i, met, counts[met], numbers[x], numbers[y], coded[y])

    counted = binned.mapInArrow(count, "pair int, x string, y string, n bigint")
    return counted.groupBy("pair", "x", "y").agg(F.sum("n").cast("double").alias("n"))


def mutual_information(df: DataFrame, features: list[str], targets: list[str], bins: int = 10) -> DataFrame:
    """(target, feature, mi) from joint bin counts; null is a bin of its own.

    Rows are counted where they lie. Both margins and their entropies are sums by group, so that no value's rows and no
    pair's values are gathered.
    """
    cols = list(dict.fromkeys([*features, *targets]))
    pairs = [(f, t) for t in targets for f in features if f != t]
    label = bin_columns(df, cols, bins)
    coded = {c: bins + 1 for c in cols if not _text(df, c)}  # the last number stands for null
    binned = df.select(*[(F.when(F.col(c).isNull(), bins).otherwise(label[c].cast("int")) if c in coded else label[c]).alias(c)
                         for c in cols])
    joint = _joint_counts(binned, pairs, coded)
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("label"))
    margins = (joint.select("pair", "n", F.inline(F.array(side("x"), side("y")))).groupBy("pair", "side", "label")
               .agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("both")))
    first = F.col("side") == "x"
    sums = margins.groupBy("pair").agg(F.sum(F.when(first, F.col("m"))).alias("all"), F.sum(F.when(first, F.col("both"))).alias("both"),
                                       F.sum(F.col("m") * F.log("m")).alias("alone"))
    mi = F.greatest(F.lit(0.0), (F.col("both") - F.col("alone")) / F.col("all") + F.log("all"))
    names = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature")) for f, t in pairs])
    return sums.select(names[F.col("pair")].alias("name"), mi.alias("mi")).select("name.target", "name.feature", "mi")


def usable_targets(df: DataFrame, targets: list[str]) -> list[str]:
    """Targets with at least two distinct values and at most 80 % nulls."""
    present = [t for t in targets if t in df.columns]
    if not present:
        return []
    facts = df.agg(F.count(F.lit(1)).alias("n"),
                   *[F.count(t).alias(f"c{i}") for i, t in enumerate(present)],
                   *[F.min(t).alias(f"lo{i}") for i, t in enumerate(present)],
                   *[F.max(t).alias(f"hi{i}") for i, t in enumerate(present)]).first()
    return [t for i, t in enumerate(present)
            if facts[f"lo{i}"] != facts[f"hi{i}"] and facts["n"] - facts[f"c{i}"] <= 0.8 * facts["n"]]


def forest_importance(df: DataFrame, features: list[str], target: str, trees: int = 50, depth: int = 10,
                      seed: int = 42) -> DataFrame:
    """(target, feature, importance); texts are indexed, null numbers become the median."""
    texts = [c for c in [*features, target] if _text(df, c)]
    work = df.where(F.col(target).isNotNull())
    if texts:
        work, _ = category_index(work, texts)
    numeric = [c for c in features if c not in texts]
    medians = fit_fill(work, numeric, "median") if numeric else {}
    inputs = []
    for i, c in enumerate(features):
        source = F.col(c + "_idx") if c in texts else F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c) or 0.0))
        work = work.withColumn(f"_x{i}", F.coalesce(source.cast("double"), F.lit(-1.0)))
        inputs.append(f"_x{i}")
    label = F.col(target + "_idx") if target in texts else F.col(target)
    ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(
        work.select(*inputs, label.cast("double").alias("_y")))
    learner = ForestClassifier if target in texts else Forest
    model = learner(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed,
                    maxBins=32).fit(ready)
    rows = [(target, f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "target string, feature string, importance double")


def rank_features(df: DataFrame, targets: list[str], features: list[str] | None = None, bins: int = 10,
                  trees: int = 50, depth: int = 10) -> DataFrame:
    """(target, feature, mi, importance, score). Both parts sum to 1 per target before they are averaged."""
    targets = usable_targets(df, targets)
    features = features or [c for c in df.columns if c not in targets]
    if not targets or not features:
        return df.sparkSession.createDataFrame(
            [], "target string, feature string, mi double, importance double, score double")
    shares = mutual_information(df, features, targets, bins)
    total = F.sum("mi").over(Window.partitionBy("target"))
    shares = shares.select("target", "feature", F.coalesce(F.try_divide("mi", total), F.lit(0.0)).alias("mi"))
    forests = reduce(DataFrame.unionByName, [forest_importance(df, features, t, trees, depth) for t in targets])
    return shares.join(forests, ["target", "feature"]).withColumn("score", (F.col("mi") + F.col("importance")) / 2)


def average_over_targets(scores: DataFrame, score: str = "score") -> DataFrame:
    return scores.groupBy("feature").agg(F.avg(score).alias(score))


def top_share(scores: DataFrame, share: float = 0.5, score: str = "score") -> DataFrame:
    """The best max(1, int(n * share)) features with their rank. One row per feature, so one small window."""
    # scores that differ by the order of a sum alone are ties
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.round(score, 12).desc(), "feature")))
    n = scores.agg(F.count(F.lit(1))).scalar()
    return ranked.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(n * F.lit(float(share)))))


def enrich(df: DataFrame, targets: list[str], key: str, share: float = 0.5, k: int = 5, trees: int = 50,
           depth: int = 10, features: list[str] | None = None) -> DataFrame:
    """Fills each target from its nearest rows over the best features. Features are completed by their median first.

    Each target's fill is written to the shared folder, so that the next one does not run the searches before it again.
    """
    pool = features or [c for c in df.columns if c not in targets and c != key]
    scores = rank_features(df, targets, pool, trees=trees, depth=depth)
    best = [r["feature"] for r in top_share(average_over_targets(scores), share).collect()]
    if not best:
        return df
    texts = [c for c in best if _text(df, c)]
    work = category_index(df, texts)[0] if texts else df
    medians = fit_fill(work, [c for c in best if c not in texts], "median")
    names = []
    for i, c in enumerate(best):
        value = F.col(c + "_idx") if c in texts else F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)))
        work = work.withColumn(f"_b{i}", value.cast("double"))
        names.append(f"_b{i}")
    work = stage(work, "enrich")
    for t in targets:
        if t in df.columns:
            before, work = work, stage((fill_knn_category if _text(df, t) else fill_knn)(work, t, names, key, k), "enrich")
            unstage(before)
    return work.select(*df.columns)
