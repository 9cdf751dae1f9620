"""Operators against brute force and against what must hold whatever the data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortium.operators import columns, explain, fill, frequency, models, quality, scoring, tournament, transform
from cohortium.operators.neighbours import fill_knn
from cohortium.operators.quantiles import exact_quantiles
from cohortium.plans import cleaning, training
from cohortium.session import bucket, shared_dir
from cohortium.sources import clean_header, normalise_headers, read_many, resolve_column


def nulls(spark, pdf):
    return spark.createDataFrame(pdf).select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if pdf[c].dtype == float else F.col(c) for c in pdf.columns])


def test_knn_is_exact_with_gaps_and_one_third_equal_rows(spark):
    rng = np.random.default_rng(1)
    n = 1500
    x = rng.normal(size=(n, 3)) * [1, 5, 20]
    x[rng.random((n, 3)) < 0.1] = np.nan
    x[:500] = [1.0, 2.0, 3.0]
    y = rng.normal(size=n)
    y[rng.random(n) < 0.3] = np.nan
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, id=rng.permutation(n))
    got = fill_knn(nulls(spark, pdf), "y", list("abc"), "id", 5, box_rows=60).toPandas().set_index("id")["y"]
    assert len(got) == n and got.notna().all()
    known = pdf[pdf.y.notna()]
    d, keys, values = known[list("abc")].to_numpy(), known.id.to_numpy(), known.y.to_numpy()
    for _, row in pdf[pdf.y.isna()].iterrows():
        diff = row[list("abc")].to_numpy(float) - d
        both = ~np.isnan(diff)
        sq = np.where(both, diff, 0) ** 2
        total = sq[:, 0] + sq[:, 1] + sq[:, 2]
        total = np.where(both.sum(1) > 0, total * (3 / np.maximum(both.sum(1), 1)), np.inf)
        best = np.lexsort((keys, total))[:5]
        best = best[np.isfinite(total[best])]
        assert got[row.id] == pytest.approx(values[best].mean() if len(best) else values.mean(), abs=1e-9)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.concat([pd.DataFrame({"g": n, "x": np.where(rng.random(n) < 0.4, 1.0, rng.random(n))})
                     for n in (1, 2, 3, 6, 7, 11, 40, 1001)])
    df = spark.createDataFrame(pdf).repartition(5)
    for interpolate in (True, False):
        for r in exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.75, 1.0], by=["g"], interpolate=interpolate).collect():
            v = pdf[pdf.g == r["g"]].x
            method = "linear" if interpolate else "inverted_cdf"
            assert r["quantile"] == pytest.approx(np.quantile(v, r["prob"], method=method), abs=1e-12)


def test_group_rare_keeps_the_threshold_itself(spark):
    df = spark.createDataFrame([("a",)] * 96 + [("b",)] * 3 + [(None,)], "c string")
    for threshold, kept in ((0.03, {"a", "b", "Other"}), (0.031, {"a", "Other"}), (0.01, {"a", "b", "Missing"})):
        out = frequency.group_rare(df, "c", threshold)
        assert {r["c"] for r in out.collect()} == kept and out.count() == 100


def test_null_report_flags_strictly_above(spark):
    df = spark.createDataFrame([(1.0 if i >= 3 else None, float("nan") if i < 4 else 1.0) for i in range(10)], "a double, b double")
    got = {r["column"]: (r["null_pct"], r["flagged"]) for r in quality.null_report(df).collect()}
    assert got == {"a": (30.0, False), "b": (40.0, True)}


def test_profile_lists_few_values_per_source(spark):
    rows = [("x", i % 3, i) for i in range(60)] + [("y", i, 5) for i in range(60)]
    df = spark.createDataFrame(rows, "s string, k int, big bigint").withColumn("big", F.col("big") + (1 << 60))
    got = {(r["source"], r["column"]): r for r in quality.profile(df, ["k", "big"], by="s").collect()}
    assert got["x", "k"]["values"] == ["0", "1", "2"] and got["y", "k"]["values"] is None
    assert got["x", "big"]["unique"] == 60 and got["y", "big"]["values"] == [str(5 + (1 << 60))]


@pytest.mark.parametrize("learner", ["forest", "ridge"])
def test_chained_fill_keeps_what_was_observed(spark, learner):
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    pdf = pd.DataFrame({"id": np.arange(400), "a": a, "b": 3 * a + rng.normal(size=400) * 0.1})
    pdf.loc[pdf.id % 5 == 0, "b"] = np.nan
    out = fill.fill_chained(nulls(spark, pdf), ["a", "b"], rounds=2, learner=learner).toPandas().set_index("id").sort_index()
    seen = pdf.b.notna()
    assert out.b.notna().all() and np.allclose(out.b[seen], pdf.b[seen])
    assert np.sqrt(((out.b - 3 * out.a)[~seen] ** 2).mean()) < (0.15 if learner == "ridge" else 1.0)


def test_tournament_names_the_linear_learner_on_a_line(spark):
    df = spark.range(600).select("id", (F.col("id") % 50).cast("double").alias("a"),
                                 ((F.col("id") % 50) * 4.0 + F.pmod("id", F.lit(3))).alias("b"))
    scores, filled = tournament.fill_tournament(df, ["a", "b"], "id", ("mean", "median", "chained", "zero"), learner="ridge")
    assert tournament.winner(scores).first()["strategy"] == "chained"
    assert filled.count() == 600


def test_too_few_complete_rows_need_no_tournament(spark):
    df = spark.createDataFrame([(i, None if i else 1.0, float(i)) for i in range(12)], "id int, a double, b double")
    scores, filled = tournament.fill_tournament(df, ["a", "b"], "id", learner="ridge")
    assert scores.count() == 0 and filled.where("a is null").count() == 0


def test_split_depends_on_the_key_alone(spark):
    df = spark.range(5000)
    for hashed in (True, False):
        a = transform.add_split(df, "id", hashed=hashed)
        b = transform.add_split(df.repartition(7, F.rand(1)), "id", hashed=hashed)
        assert a.exceptAll(b).count() == 0
        assert 0.77 < a.where("split = 'train'").count() / 5000 < 0.83
    twice = df.where((bucket("id", 1, 10) == 0) & (bucket("id", 2, 10) == 0)).count()
    assert 20 < twice < 80


def test_combos_count_members(spark):
    df = spark.createDataFrame([(s,) for s in "aabccc"], "s string")
    got = {r["combo"]: r["count"] for r in columns.combos(df, "s", ["a", "b", "c"]).groupBy("combo").count().collect()}
    assert got == {"a": 2, "b": 1, "c": 3, "a + b": 3, "a + c": 5, "b + c": 4, "a + b + c": 6}


def line(spark, n=500):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["label"] = 2 * pdf.a - 0.5 * pdf.b + 0.1 * rng.normal(size=n)
    return pdf, spark.createDataFrame(pdf).withColumn("features", models.as_vector(["a", "b"]))


@pytest.mark.parametrize("alpha", [1.0, 50.0])
def test_ridge_equals_closed_form(spark, alpha):
    pdf, df = line(spark)
    x = pdf[["a", "b"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (pdf.label - pdf.label.mean()))
    got = models.LinearFamily("ridge", alpha).fit(df).transform(df).orderBy("id").toPandas().prediction
    assert np.allclose(got, pdf.label.mean() + z @ beta, atol=1e-9)


@pytest.mark.parametrize("kind,share", [("lasso", 1.0), ("elastic", 0.5)])
def test_penalised_lines_are_optimal(spark, kind, share):
    pdf, df = line(spark)
    alpha = 0.3
    x = pdf[["a", "b"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    fitted = models.LinearFamily(kind, alpha, 0.5).fit(df)
    w = np.array(fitted.coefficients) * x.std(0)
    pull = z.T @ (pdf.label - pdf.label.mean() - z @ w) / len(pdf) - alpha * (1 - share) * w
    for p, c in zip(pull, w):
        assert p == pytest.approx(alpha * share * np.sign(c), abs=1e-8) if c else abs(p) <= alpha * share + 1e-8


def test_line_saves_and_loads(spark, tmp_path):
    _, df = line(spark)
    fitted = models.LinearFamily("ridge", 1.0).fit(df)
    fitted.save(spark, str(tmp_path / "line"))
    again = models.FixedLine.load(spark, str(tmp_path / "line"))
    assert (again.coefficients, again.intercept) == (fitted.coefficients, fitted.intercept)


def test_bayesian_line_finds_the_signal(spark):
    _, df = line(spark)
    fitted = models.BayesianLine().fit(df)
    assert fitted.coefficients == pytest.approx([2, -0.5], abs=0.05)


@pytest.mark.parametrize("make", [lambda: models.forest(trees=4, depth=5), lambda: models.boosted(trees=4, depth=3, rate=0.3)])
def test_tree_contributions_add_up_and_match_brute_force(spark, make):
    _, df = line(spark, 200)
    model = make().fit(df)
    out = explain.contributions_trees(model.transform(df), model, ["a", "b"])
    total = F.col("base") + F.aggregate("factors", F.lit(0.0), lambda s, f: s + f["phi"])
    assert out.select(F.max(F.abs(total - F.col("prediction")))).first()[0] < 1e-9

    # with two features the Shapley value is the mean of two orders, read off the trees directly
    tables, weights = explain.tree_table(model)

    def expected(tree, x, known, at=0):
        left, right, value, count, feature, cut, _ = tree[at]
        if left < 0:
            return value
        if feature in known:
            return expected(tree, x, known, left if x[feature] <= cut[0] else right)
        return sum(expected(tree, x, known, c) * tree[c][3] / count for c in (left, right))
    for r in out.limit(5).collect():
        x = r["features"].toArray()
        f = lambda known: sum(w * expected(t, x, known) for t, w in zip(tables, weights))
        phi = 0.5 * (f({0}) - f(set())) + 0.5 * (f({0, 1}) - f({1}))
        assert r["factors"][0]["phi"] == pytest.approx(phi, abs=1e-9)


def test_stack_beats_the_mean(spark):
    _, df = line(spark)
    stack = models.fit_stack(df.select("id", "features", "label"), {
        "ridge": models.LinearFamily("ridge", 1.0), "forest": models.forest(trees=5, depth=4)}, folds=3, key="id")
    error = stack.transform(df).select(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert error < 0.2


def test_combined_scenario_needs_two_that_apply(spark):
    df = spark.createDataFrame([(1, 2.0, 8.0), (2, 1.0, 8.0), (3, 3.0, 8.0)], "id int, g double, h double")
    score = scoring.linear_scorer({"g": 0.5, "h": 1.0}, 0.0)
    table = [(1, "g", 2, 1, "t", "d", "a", "b"), (2, "h", 8, 7, "t", "d", "a", "b")]
    got = scoring.combined(df, score, table).collect()
    assert [(r["id"], r["original"], r["combined"]) for r in got] == [(1, 9.0, 7.5)]
    assert scoring.what_if(df, score, table).count() == 4


def test_sources(spark, tmp_path):
    assert clean_header(" a--b (c)__d ") == "a_b_c_d"
    with pytest.raises(ValueError):
        normalise_headers(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))
    df = spark.createDataFrame([(1,)], "my_Target_col int")
    assert resolve_column(df, "target") == "my_Target_col"
    (tmp_path / "a.csv").write_text("x,y\n1,2\nbad,4\n")
    frames, skipped = read_many(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "none.csv")}, "x int, y int")
    assert list(skipped) == ["b"]
    assert sorted((r["x"], r["y"]) for r in frames["a"].select("x", "y").collect() if r["x"]) == [(1, 2)]
    assert frames["a"].count() == 2


def test_cleaning_follows_the_columns_that_exist(spark):
    df = spark.createDataFrame([("m", "Yes", 170.0, 68.0), ("?", None, 0.0, 68.0)],
                               "PreRgender string, PreRtobuse string, PreRheight double, PreRweight double")
    got = cleaning.clean_survey(df).collect()
    assert [(r["PreRgender"], r["current_smoking"], r["current_alcohol"]) for r in got] == [("Male", 1, None), ("Other", None, None)]
    assert got[0]["PreRBMI"] == pytest.approx(23.5294, abs=1e-4) and got[1]["PreRBMI"] is None


def test_merge_sources(spark):
    a = spark.createDataFrame([("1", "2.5", "x"), ("1", "2.5", "x"), (None, "1", "y")], "`y ` string, n string, c string")
    b = spark.createDataFrame([(3.0, "z")], "y double, old string")
    out = training.merge_sources({"a": a, "b": b}, "y", ["n"], ["c"], renames={"old": "c"})
    assert sorted((r["y"], r["n"], r["c"]) for r in out.collect() if r["n"]) == [(1.0, 2.5, "x")]
    assert out.count() == 2


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
