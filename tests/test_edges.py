"""Edge inputs: empty frames, files with other headers, failing fills, search bounds, staged folders."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortium.operators import models, neighbours, quality, tournament, transform
from cohortium.session import shared_dir, stage, unstage
from cohortium.sources import read_csv, read_many


def test_each_csv_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n20,10\n")
    (tmp_path / "c.csv").write_text('﻿"y",z\n30,"a,b"\n')
    (tmp_path / "d.csv").write_text("")
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    typed = read_csv(spark, str(tmp_path), "x int, y int", tag="file")
    assert rows(typed, "x", "y", "file") == [(1, 2, "a.csv"), (10, 20, "b.csv"), (None, 30, "c.csv")]
    assert rows(read_csv(spark, str(tmp_path)), "x", "y", "z") == [("1", "2", None), ("10", "20", None), (None, "30", "a,b")]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e f.csv").write_text("x\n5\n")
    assert read_csv(spark, str(tmp_path), "x int", recursive=True).agg(F.sum("x")).first()[0] == 16
    frames, skipped = read_many(spark, {"d": str(tmp_path / "d.csv"), "a": str(tmp_path / "a.csv")}, "x int")
    assert list(frames) == ["a"] and skipped == {"d": "no header"}


def test_null_report_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a double, b string, s string")
    assert [tuple(r) for r in quality.null_report(empty, ["a", "b"]).collect()] == [("ALL", "a", 0, 0, None, False), ("ALL", "b", 0, 0, None, False)]
    assert quality.profile(empty, ["a", "b"]).count() >= 0


def test_tournament_without_hidden_cells(spark):
    # keys whose bucket is never 0, so nothing is hidden
    keys = [k for k in range(400) if all((k % 1_000_003 + 1) * (7919 + 104_729 * i) % 999_983 % 10 for i in (1,))][:12]
    df = spark.createDataFrame([(k, float(k)) for k in keys] + [(10_000, None)], "id long, a double")
    scores, filled = tournament.fill_tournament(df, ["a"], "id", ("mean", "zero"), hashed=False)
    assert {r["rmse"] for r in scores.collect()} == {None}
    assert filled.where("a is null").count() == 0


def test_tournament_survives_a_failing_strategy(spark, monkeypatch):
    real = tournament.fill_with

    def sometimes(df, cols, key, strategy, *rest):
        if strategy == "median":
            raise ValueError("no")
        if strategy == "zero":  # fails only when it runs
            return df.withColumns({c: F.raise_error(F.lit("late")).cast("double") for c in cols})
        return real(df, cols, key, strategy, *rest)

    monkeypatch.setattr(tournament, "fill_with", sometimes)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(300)] + [(900, None, 1.0)], "id long, a double, b double")
    scores, filled = tournament.fill_tournament(df, ["a", "b"], "id", ("median", "zero", "mean"))
    assert {r["strategy"]: r["rmse"] is None for r in scores.collect()} == {"median": True, "zero": True, "mean": False}
    assert filled.where("a is null").count() == 0 and filled.count() == 301


def test_fit_without_labels_says_so(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, label double").withColumn("features", models.as_vector(["a"]))
    with pytest.raises(ValueError, match="no row has a label"):
        models.LinearFamily().fit(df)


def test_power_beyond_the_grid(spark):
    x = (10 + np.arange(2000) / 2000) ** 0.1
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    powers, _ = transform.yeo_johnson(df, ["x"])

    def likelihood(p):
        z = ((x + 1) ** p - 1) / p
        return -len(x) / 2 * math.log(z.var()) + (p - 1) * np.log1p(x).sum()
    assert powers["x"] > 4.5
    assert all(likelihood(powers["x"]) >= likelihood(powers["x"] + d) - 1e-6 for d in (-0.1, 0.1))


def test_boxes_reachable_are_those_that_may_matter():
    rng = np.random.default_rng(3)
    points = np.sort(rng.normal(size=(20_000, 2)), axis=0)  # sorted donors
    nodes = neighbours._learn_splits(points[::10], 256)
    box = neighbours._box_of(nodes, points)
    ids = np.unique(box)
    low, high = (np.array([f(points[box == b], axis=0) for b in ids]) for f in (np.min, np.max))
    outlines = neighbours._outlines(nodes, (ids, low, high, np.ones((len(ids), 2), bool), np.ones((len(ids), 2), bool)))
    asked = rng.normal(size=(200, 2))
    asked[150:, 0] = np.nan
    home, reach = neighbours._box_of(nodes, asked), rng.random(200) * 0.1
    got = neighbours._reachable(nodes, outlines, asked, home, reach)
    for i, point in enumerate(asked):
        known = ~np.isnan(point)
        gap = np.maximum(np.maximum(low - point, point - high), 0)[:, known]
        want = set(ids[(gap ** 2).sum(axis=1) * 2 / known.sum() <= reach[i]]) - {home[i]}
        assert set(got[i]) == want
    # nothing known: nothing compares, and no box is visited
    blank = np.full((50, 2), np.nan)
    assert not any(neighbours._reachable(nodes, outlines, blank, np.zeros(50), np.full(50, np.inf)))


def test_more_boxes_than_a_fixed_number(spark):
    rows = [(i, float(i), None if i % 50 == 0 else float(i)) for i in range(12_000)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    filled = neighbours.fill_knn(df, "y", ["x"], "id", k=2, box_rows=2)
    wrong = filled.where("id % 50 = 0 AND id > 0 AND y NOT IN (id, id - 0.5)").count()
    assert wrong == 0 and filled.where("y IS NULL").count() == 0


def test_staged_folders_go_and_nothing_stays_cached(spark):
    held = lambda: spark.sparkContext._jsc.sc().getRDDStorageInfo()
    before = len(held())
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 9 > 0 THEN CAST(id % 13 AS DOUBLE) END AS a", "CAST(id % 5 AS DOUBLE) AS b")
    scores, filled = tournament.fill_tournament(df, ["a", "b"], "id", ("mean", "median", "knn"))
    assert filled.count() == 100 and scores.count() == 3
    assert len(held()) == before
    once = stage(df)
    assert os.path.isdir(once.staged_at) and once.staged_at.startswith(shared_dir(spark))
    unstage(once)
    assert not os.path.exists(once.staged_at)


def test_scores_that_differ_by_rounding_are_ties(spark):
    from cohortium.operators import ranking

    scores = spark.createDataFrame([("b", 1.5859904931234805), ("a", 1.5859904931234803), ("c", 0.5)], "feature string, score double")
    assert [tuple(r) for r in ranking.top_share(scores, 0.7).select("feature", "rank").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
