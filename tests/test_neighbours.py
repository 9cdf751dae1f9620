"""The two levels of the donor boxes against comparing every receiver with every donor."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortium.operators import neighbours


def brute(receivers, donors, k):
    out = {}
    for key, x in receivers:
        met = []
        for donor, value, y in donors:
            both = ~np.isnan(x) & ~np.isnan(y)
            if both.any():
                met.append((((x - y)[both] ** 2).sum() * len(x) / both.sum(), donor, value))
        out[key] = [donor for _, donor, _ in sorted(met)[:k]]
    return out


def frame(spark, ids, values, points):
    rows = [(int(i), None if np.isnan(v) else float(v), *[None if np.isnan(a) else float(a) for a in x])
            for i, v, x in zip(ids, values, points)]
    return spark.createDataFrame(rows, "id bigint, y double, a double, b double, c double")


@pytest.mark.parametrize("top_boxes", [1, 4, 1024])
def test_nearest_over_two_levels_is_exact(spark, top_boxes):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(900, 3)), 2)
    points[rng.random(points.shape) < 0.15] = np.nan
    points[500:560] = points[500]  # ties and repeated rows
    values = np.where(np.arange(900) < 150, np.nan, rng.normal(size=900))
    df = frame(spark, range(900), values, points)
    got = neighbours.nearest_donors(df.where("y IS NULL"), df.where("y IS NOT NULL"), "id", "y", list("abc"), 4,
                                    box_rows=20, top_boxes=top_boxes)
    found = {r["id"]: [n["donor"] for n in r["nearest"]] for r in got.collect()}
    wanted = brute([(i, points[i]) for i in range(150)], [(i, values[i], points[i]) for i in range(150, 900)], 4)
    assert {i: d for i, d in wanted.items() if d} == {i: d for i, d in found.items() if d}


def test_the_driver_holds_as_much_for_ten_times_the_donors(spark, monkeypatch):
    """Rows that the driver learns its splits from, and nodes of its tree."""
    held = []
    learn = neighbours._learn_splits
    monkeypatch.setattr(neighbours, "_learn_splits", lambda points, boxes: held.append((len(points), boxes)) or learn(points, boxes))
    for n in (2_000, 20_000):
        donors = spark.range(n).select("id", F.rand(3).alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(5).alias("c"))
        receivers = donors.where("id < 40").withColumn("id", F.col("id") + 1_000_000)
        got = neighbours.nearest_donors(receivers, donors, "id", "y", list("abc"), 1, box_rows=50, top_boxes=8)
        # each receiver has the features of one donor
        assert all(r["nearest"][0]["donor"] == r["id"] - 1_000_000 and r["nearest"][0]["d"] == 0 for r in got.collect())
    assert [boxes for _, boxes in held] == [8, 8]
    assert held[1][0] < 1.5 * held[0][0]


def test_nothing_to_find(spark):
    df = frame(spark, range(5), [np.nan] * 5, np.zeros((5, 3)))
    got = neighbours.nearest_donors(df, df.where("y IS NOT NULL"), "id", "y", list("abc"), 2, top_boxes=1)
    assert [r["nearest"] for r in got.collect()] == [[]] * 5
    full = frame(spark, range(5), np.arange(5.0), np.zeros((5, 3)))
    assert neighbours.nearest_donors(full.limit(0), full, "id", "y", list("abc"), 2, box_rows=2, top_boxes=1).count() == 0


@pytest.mark.parametrize("top_boxes", [4, 1024])
def test_an_index_saved_and_loaded_answers_alike(spark, tmp_path, top_boxes):
    from pyspark.ml.functions import array_to_vector
    donors = spark.range(600).select("id", F.rand(3).alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    donors = donors.withColumn("features", array_to_vector(F.array("a", "b")))
    index = neighbours.DonorIndex.build(donors, "id", "y", "features", 3, box_rows=20, top_boxes=top_boxes)
    asked = donors.sample(0.1, 5).withColumn("id", F.col("id") + 1000)
    index.save(str(tmp_path / "index"))
    loaded = neighbours.DonorIndex.load(spark, str(tmp_path / "index"))
    plain = neighbours.nearest_donors(asked, donors, "id", "y", ["a", "b"], 3)
    rows = [sorted(map(str, i.nearest(asked, "id").collect())) for i in (index, loaded)] + [sorted(map(str, plain.collect()))]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == asked.count()


def test_neighbours_as_a_base_of_the_stack(spark):
    """Rows without a label are no donors, rows without the key are scored too, a row that compares with nothing has the mean."""
    from cohortium.operators import models
    from pyspark.ml.functions import array_to_vector
    df = spark.range(400).select("id", F.rand(1).alias("a")).withColumn("label", F.floor(F.col("a") * 4) * 10.0)
    df = df.withColumn("features", array_to_vector(F.array("a")))
    bases = {n: b for n, b in models.default_bases(key="id").items() if n in ("ridge", "nearest")}
    assert "nearest" not in models.default_bases()
    stack = models.fit_stack(df, bases, folds=2, key="id")
    scored = stack.transform(df.drop("id")).agg(F.avg(F.abs(F.col("prediction") - F.col("label"))), F.count("prediction")).first()
    assert scored[0] < 1.0 and scored[1] == 400
    known = spark.createDataFrame([(1, 2.0, 5.0), (2, 3.0, 7.0), (3, 4.0, None)], "id long, a double, label double")
    model = models.NeighbourRegressor(["a"], "label", "id", 1).fit(known)
    asked = spark.createDataFrame([(9, 4.0), (10, None)], "id long, a double")
    assert [r["prediction"] for r in model.transform(asked).orderBy("id").collect()] == [7.0, 6.0]


def test_leaves_of_a_large_group_give_what_all_pairs_give(monkeypatch):
    """Also with gaps and with ties, which go to the smaller donor; a leaf alone is compared, not the whole group."""
    rng, real, pairs = np.random.default_rng(1), neighbours._compare_all, []
    monkeypatch.setattr(neighbours, "_compare_all", lambda r, d, k: pairs.append(len(r) * len(d)) or real(r, d, k))
    for gaps in (False, True):
        for tied in (False, True):
            for width in (1, 2, 7):
                d, r = rng.normal(size=(700, width)), rng.normal(size=(500, width))
                d, r = (np.round(d), np.round(r)) if tied else (d, r)
                if gaps:
                    d[rng.random(d.shape) < 0.2], r[rng.random(r.shape) < 0.2] = np.nan, np.nan
                for k in (1, 5):
                    found = [sorted(zip(*(x.tolist() for x in of(r, d, k)))) for of in (neighbours._k_nearest, real)]
                    assert found[0] == found[1]
    pairs.clear()
    d, r = rng.normal(size=(2048, 2)), rng.normal(size=(1000, 2))
    neighbours._k_nearest(r, d, 5)
    assert sum(pairs) < len(r) * len(d) / 5
