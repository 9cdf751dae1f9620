"""Models, stacks, searches and their evaluation."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...operators import evaluate as ev
from ...operators import models as md
from ...operators.neighbours import NeighbourRegressor
from ...operators.transform import add_fold, add_split
from ...session import fresh_path
from .. import training
from ..survey import PLANTED_SQL, bucket_sql, planted, r6, split_sql, table
from .registry import query


def _ready(spark, sf_dir, features=("a", "b")):
    df = planted(spark, sf_dir).withColumn("features", md.as_vector(list(features)))
    return df.withColumn("label", F.col("y"))


def _mean_beside(df, train, y="label", yhat="prediction"):
    """Held-out metrics of a model next to those of the mean of the training rows."""
    mean = train.agg(F.avg(y)).scalar()
    long = df.select(y, F.inline(F.array(
        F.struct(F.lit("model").alias("model"), F.col(yhat).alias("yhat")),
        F.struct(F.lit("mean").alias("model"), mean.alias("yhat")))))
    return ev.regression_metrics(long, y, "yhat", ["model"]).select("model", "n", "mae", "rmse", "r2")


_BEATS = f"""WITH p AS (SELECT *, {split_sql('id')} AS split FROM ({PLANTED_SQL})), m AS (SELECT avg(y) AS my FROM p WHERE split = 'train'),
  t AS (SELECT count(*) AS n, round(avg(abs(y - my)), 6) AS mae FROM p, m WHERE split = 'test')
  SELECT model, n, mae AS mean_mae, model = 'model' AS half_of_mean, model = 'model' AS explains_half FROM t, (VALUES ('model'), ('mean')) v(model)"""


def _beats(df, train):
    """The mean's held-out error, and whether the model has less than half of it and explains more than half of the variance."""
    both = _mean_beside(df, train)
    of_mean = F.max(F.when(F.col("model") == "mean", F.col("mae"))).over(Window.partitionBy(F.lit(1)))
    out = both.withColumn("mean_mae", of_mean).select(
        "model", "n", "mean_mae", (F.col("mae") < F.col("mean_mae") / 2).alias("half_of_mean"), (F.col("r2") > 0.5).alias("explains_half"))
    return r6(out, "mean_mae")


def _sides(df):
    split = add_split(df, "id", hashed=False)
    return split.where("split = 'train'"), split.where("split = 'test'")


def _line_sql(kind: str) -> str:
    """One predictor, standardised: slope and intercept on the scale of z, by their closed forms."""
    soft = "sign(zy / n) * greatest(abs(zy / n) - {0}, 0)"
    slope = {"ridge": "zy / (n + 1.0)", "lasso": soft.format(0.01),
             "elastic": f"{soft.format(0.005)} / (1 + 0.005)"}[kind]
    return f"""WITH p AS ({PLANTED_SQL}), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(y) AS my, count(*)::DOUBLE AS n FROM p),
      s AS (SELECT sum((a - ma) / sa * (y - my)) AS zy FROM p, m)
      SELECT id, round(my + ({slope}) * (a - ma) / sa, 6) AS prediction FROM p, m, s"""


def _line(kind: str, alpha: float):
    @query(f"t2_{kind}_line", _line_sql(kind))
    def run(spark, sf_dir):
        df = _ready(spark, sf_dir, ["a"])
        model = md.LinearFamily(kind, alpha, 0.5).fit(df)
        return r6(model.transform(df).select("id", "prediction"), "prediction")


_line("ridge", 1.0)
_line("lasso", 0.01)
_line("elastic", 0.01)


@query("t3_bayesian_line", _BEATS)
def bayesian(spark, sf_dir):
    train, test = _sides(_ready(spark, sf_dir))
    return _beats(md.BayesianLine().fit(train).transform(test), train)


@query("t4_forest", _BEATS)
def forest(spark, sf_dir):
    train, test = _sides(_ready(spark, sf_dir))
    return _beats(md.forest(trees=20, depth=8).fit(train).transform(test), train)


@query("t5_boosted", _BEATS)
def boosted(spark, sf_dir):
    train, test = _sides(_ready(spark, sf_dir))
    return _beats(md.boosted(trees=15, depth=4, rate=0.3).fit(train).transform(test), train)


@query("t5_boosted_sampled", _BEATS)
def boosted_sampled(spark, sf_dir):
    train, test = _sides(_ready(spark, sf_dir))
    return _beats(md.boosted_sampled(trees=15, depth=4, rate=0.3).fit(train).transform(test), train)


def _bases():
    return {"ridge": md.LinearFamily("ridge", 1.0), "lasso": md.LinearFamily("lasso", 0.01),
            "forest": md.forest(trees=10, depth=6)}


@query("t7_out_of_fold", f"""WITH p AS ({PLANTED_SQL}) SELECT id, CAST({bucket_sql('id', 99, 5)} AS INT) AS fold, 1::BIGINT AS times, true AS all_bases FROM p""")
def out_of_fold(spark, sf_dir):
    """Each row exactly once, with a prediction of every base."""
    df = _ready(spark, sf_dir).select("id", "features", "label")
    oof = md.out_of_fold(df, {"ridge": md.LinearFamily("ridge", 1.0), "lasso": md.LinearFamily("lasso", 0.01)},
                         "id", 5, hashed=False)
    return oof.groupBy("id", "fold").agg(
        F.count(F.lit(1)).alias("times"),
        F.bool_and(F.col("base_ridge").isNotNull() & F.col("base_lasso").isNotNull()).alias("all_bases"))


@query("t7_stack", _BEATS)
def stack(spark, sf_dir):
    train, test = _sides(_ready(spark, sf_dir))
    cols = ["id", "features", "label"]
    fitted = md.fit_stack(train.select(*cols), _bases(), folds=3, key="id", hashed=False)
    return _beats(fitted.transform(test.select(*cols)), train)


@query("t8_boosted_stack")
def boosted_stack(spark, sf_dir):
    """A stack with a boosted meta model is kept only if it beats the leader on the held-out rows."""
    train, test = _sides(_ready(spark, sf_dir))
    cols = ["id", "features", "label"]
    leader = md.boosted(trees=10, depth=4, rate=0.3).fit(train)
    made = md.fit_stack(train.select(*cols), {"ridge": md.LinearFamily("ridge", 1.0), "lasso": md.LinearFamily("lasso", 0.01)},
                        md.boosted(trees=10, depth=3, rate=0.3, features="_meta"), folds=3, key="id", hashed=False)
    scored = ev.long_predictions(test.select(*cols), {"leader": leader, "boosted_stack": made}, ["label"])
    board = ev.regression_metrics(scored, "label", "yhat", ["model"]).select("model", "mae", "rmse", "r2")
    order = F.when(F.col("model") == "leader", 0).otherwise(1)
    return board.withColumn("ordinal", order)


@query("t9_search_leaderboard")
def search(spark, sf_dir):
    """Cross-validated grid, best mean absolute error first; the head of the board."""
    df = _ready(spark, sf_dir).select("id", "features", "label")
    _, board = md.search(df, md.boosted(trees=5, rate=0.3), {"maxDepth": [2, 4], "maxIter": [3, 6]}, "id", folds=3,
                         hashed=False)
    return board.limit(15)


_FOLDED = f"""WITH p AS (SELECT *, {bucket_sql('id', 99, 5)} AS fold FROM ({PLANTED_SQL})),
  lines AS (SELECT f.fold, regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM p JOIN (SELECT DISTINCT fold FROM p) f
    ON p.fold <> f.fold GROUP BY 1), oof AS (SELECT p.*, i + s * a AS yhat FROM p JOIN lines USING (fold))"""


_RACED = f"""WITH p AS (SELECT *, {bucket_sql('id', 99, 5)} AS fold FROM ({PLANTED_SQL})), folds AS (SELECT DISTINCT fold AS f FROM p),
  lines AS (SELECT f, regr_slope(y, a) AS sa, regr_intercept(y, a) AS ia, regr_slope(y, b) AS sb, regr_intercept(y, b) AS ib
    FROM p JOIN folds ON p.fold <> f GROUP BY 1),
  oof AS (SELECT id, fold, y, ia + sa * a AS pa, ib + sb * b AS pb FROM p JOIN lines ON fold = f),
  m AS (SELECT f, avg(pa) AS ma, avg(pb) AS mb, avg(y) AS my, var_pop(pa) AS aa, var_pop(pb) AS bb, covar_pop(pa, pb) AS ab,
    covar_pop(pa, y) AS ay, covar_pop(pb, y) AS bty FROM oof JOIN folds ON fold <> f GROUP BY 1),
  stacked AS (SELECT oof.*, my + ((ay * bb - bty * ab) * (pa - ma) + (bty * aa - ay * ab) * (pb - mb)) / (aa * bb - ab * ab) AS ps
    FROM oof JOIN m ON fold = f),
  e AS (SELECT fold, avg(abs(y - pa)) AS price, avg(abs(y - pb)) AS balance, avg(abs(y - ps)) AS stack FROM stacked GROUP BY 1),
  board AS (SELECT 'price' AS family, avg(price) AS mae FROM e UNION ALL SELECT 'balance', avg(balance) FROM e
    UNION ALL SELECT 'stack', avg(stack) FROM e)"""


def _raced(spark, sf_dir):
    """Two families of lines whose later members bring nothing: each leaves the race after two of them."""
    df = _ready(spark, sf_dir).withColumns({"on_a": md.as_vector(["a"]), "on_b": md.as_vector(["b"])}).select("id", "on_a", "on_b", "label")
    families = {name: [md.LinearFamily("ridge", 1e-9 * i, features=c) for i in range(5)] for name, c in (("price", "on_a"), ("balance", "on_b"))}
    return df, md.race(df, families, "id", folds=5, rounds=2, meta=md.LinearFamily("ridge", 0.0, features="_meta"), hashed=False)


@query("t9_race_board", f"""{_RACED} SELECT family, count(*) AS lines, round(min(mae), 4) AS cv_mae, family = (SELECT arg_min(family, mae) FROM board) AS won
  FROM (SELECT * FROM board UNION ALL SELECT b.* FROM board b, range(2) WHERE family <> 'stack') GROUP BY 1""")
def race_board(spark, sf_dir):
    """Lines tried and least error of each family and of the stack of their best; two of five members are never fitted."""
    _, raced = _raced(spark, sf_dir)
    out = raced.board.groupBy("family").agg(F.count(F.lit(1)).alias("lines"), F.min("cv_mae").alias("cv_mae"))
    return r6(out.withColumn("won", F.col("family") == raced.winner.rpartition("_")[0] if "_" in raced.winner else F.col("family") == raced.winner),
              "cv_mae", places=4)


@query("t8_race_winner", f"""{_RACED}, w AS (SELECT regr_slope(y, a) AS sa, regr_intercept(y, a) AS ia, regr_slope(y, b) AS sb,
    regr_intercept(y, b) AS ib FROM p),
  wm AS (SELECT avg(pa) AS ma, avg(pb) AS mb, avg(y) AS my, var_pop(pa) AS aa, var_pop(pb) AS bb, covar_pop(pa, pb) AS ab,
    covar_pop(pa, y) AS ay, covar_pop(pb, y) AS bty FROM oof)
  SELECT id, round(my + ((ay * bb - bty * ab) * (ia + sa * a - ma) + (bty * aa - ay * ab) * (ib + sb * b - mb)) / (aa * bb - ab * ab), 4) AS prediction
  FROM p, w, wm""")
def race_winner(spark, sf_dir):
    """The stack is better than its bases, so it is kept: its meta line over bases fitted to all rows."""
    df, raced = _raced(spark, sf_dir)
    return r6(raced.model.transform(df).select("id", "prediction"), "prediction", places=4)


def _oof(spark, sf_dir):
    df = _ready(spark, sf_dir, ["a"]).select("id", "features", "label")
    return md.out_of_fold(df, {"line": md.LinearFamily("ridge", 0.0)}, "id", 5, hashed=False)


@query("t7_out_of_fold_lines", f"{_FOLDED} SELECT id, CAST(fold AS INT) AS fold, round(yhat, 4) AS base_line FROM oof")
def out_of_fold_lines(spark, sf_dir):
    """The prediction of every row by the line of the other folds; all lines come from one pass of moments by fold."""
    return r6(_oof(spark, sf_dir).select("id", "fold", "base_line"), "base_line", places=4)


@query("t10_cv_metrics", f"""{_FOLDED} SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(avg(abs(y - yhat)), 4) AS mae,
  round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse, round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 4) AS r2
  FROM oof GROUP BY 1""")
def cv_metrics(spark, sf_dir):
    out = ev.regression_metrics(_oof(spark, sf_dir), "label", "base_line", ["fold"])
    return r6(out.select("fold", "n", "mae", "rmse", "r2"), "mae", "rmse", "r2", places=4)


_METRICS = """count(*) AS n, round(avg(abs(y - yhat)), 6) AS mae, round(avg((y - yhat) * (y - yhat)), 6) AS mse,
  round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse, round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 6) AS r2,
  round(min(y), 6) AS target_min, round(max(y), 6) AS target_max, round(avg(y), 6) AS target_mean,
  round(min(yhat), 6) AS pred_min, round(max(yhat), 6) AS pred_max, round(avg(yhat), 6) AS pred_mean"""
_NUMBERS = ["mae", "mse", "rmse", "r2", "target_min", "target_max", "target_mean", "pred_min", "pred_max", "pred_mean"]


@query("a11_a12_regression_metrics", f"""WITH p AS (SELECT *, {split_sql('id')} AS split, 1.9 * a - 0.4 * b AS yhat FROM ({PLANTED_SQL}))
  SELECT source, split, {_METRICS} FROM p GROUP BY 1, 2""")
def metrics(spark, sf_dir):
    df = add_split(planted(spark, sf_dir), "id", hashed=False).withColumn("yhat", 1.9 * F.col("a") - 0.4 * F.col("b"))
    return r6(ev.regression_metrics(df, "y", "yhat", ["source", "split"]), *_NUMBERS)


@query("t11_goal_test", f"""WITH p AS (SELECT *, 1.9 * a AS yhat FROM ({PLANTED_SQL})) SELECT segment,
  round(avg(abs(y - yhat)), 6) AS mae, avg(abs(y - yhat)) < 0.5 AS goal FROM p GROUP BY 1""")
def goal(spark, sf_dir):
    df = planted(spark, sf_dir).withColumn("yhat", 1.9 * F.col("a"))
    out = ev.goal_met(ev.regression_metrics(df, "y", "yhat", ["segment"]))
    return r6(out.select("segment", "mae", "goal"), "mae")


_CROSS = f"""WITH p AS (SELECT *, {split_sql('id')} AS split FROM ({PLANTED_SQL})), c AS (SELECT * FROM (VALUES
  ('F', 'F'), ('O', 'O'), ('P', 'P'), ('F + O + P', 'F'), ('F + O + P', 'O'), ('F + O + P', 'P')) v(model, member)),
  lines AS (SELECT model, regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM p JOIN c ON source = member
    WHERE split = 'train' GROUP BY 1),
  scored AS (SELECT model, source, y, i + s * a AS yhat FROM p, lines WHERE split = 'test')"""


def _source_models(spark, sf_dir):
    train, test = _sides(_ready(spark, sf_dir, ["a"]))
    line = md.LinearFamily("ridge", 0.0)
    found = {s: line.fit(train.where(F.col("source") == s)) for s in "FOP"}
    found["F + O + P"] = line.fit(train)
    return found, test


@query("t12_cross_sources", f"""{_CROSS} SELECT model, source, count(*) AS n, round(avg(abs(y - yhat)), 4) AS mae,
  round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse, round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 4) AS r2,
  avg(abs(y - yhat)) < 0.5 AS goal FROM scored GROUP BY 1, 2""")
def cross_sources(spark, sf_dir):
    """Every model on the held-out rows of every source."""
    found, test = _source_models(spark, sf_dir)
    return r6(ev.cross_validate_sources(test, found, "label", "source"), "mae", "rmse", "r2", places=4)


@query("t15_best_by_cv", f"""{_FOLDED} SELECT strategy, round(mae, 4) AS mae FROM (
  SELECT 'mean' AS strategy, 0 AS ordinal, avg(abs(y - (SELECT avg(y) FROM oof))) AS mae FROM oof UNION ALL
  SELECT 'line', 1, avg(abs(y - yhat)) FROM oof) b ORDER BY b.mae, ordinal LIMIT 1""")
def best_by_cv(spark, sf_dir):
    """Smallest cross-validated error of two models, the first declared on a tie."""
    from ...operators.tournament import winner
    oof = _oof(spark, sf_dir)
    mean = oof.agg(F.avg("label")).scalar()
    long = oof.select("label", F.inline(F.array(
        F.struct(F.lit("mean").alias("strategy"), F.lit(0).alias("ordinal"), mean.alias("yhat")),
        F.struct(F.lit("line").alias("strategy"), F.lit(1).alias("ordinal"), F.col("base_line").alias("yhat")))))
    scored = ev.regression_metrics(long, "label", "yhat", ["strategy", "ordinal"])
    return r6(winner(scored, score="mae"), "mae", places=4)


_BOARD = """SELECT p_brand AS model, avg(abs(p_retailprice - 950)) / 60 AS test_mae, count(*) * 0.5 AS train_minutes FROM part GROUP BY 1"""


def _board(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(
        (F.avg(F.abs(F.col("p_retailprice") - 950)) / 60).alias("test_mae"),
        (F.count(F.lit(1)) * F.lit(0.5).cast("double")).alias("train_minutes"))


@query("a14_leaderboard_summary", f"""WITH b AS ({_BOARD}) SELECT count(*) FILTER (WHERE test_mae < 0.42) AS goals_met, count(*) AS models,
  round(avg(test_mae), 6) AS mean_mae, round(median(test_mae), 6) AS median_mae, round(min(test_mae), 6) AS best_mae,
  round(sum(train_minutes), 6)::DOUBLE AS total_minutes FROM b""")
def summary(spark, sf_dir):
    out = ev.leaderboard_summary(_board(spark, sf_dir), goal=0.42)
    return r6(out, "mean_mae", "median_mae", "best_mae", "total_minutes")


@query("l4_board_head", f"WITH b AS ({_BOARD}) SELECT model, round(test_mae, 6) AS test_mae FROM b ORDER BY b.test_mae, model LIMIT 15")
def board_head(spark, sf_dir):
    return r6(_board(spark, sf_dir).select("model", "test_mae").orderBy("test_mae", "model").limit(15), "test_mae")


@query("l7_best_bases", f"WITH b AS ({_BOARD}) SELECT replace(model, '#1', 'Stack') AS model, round(test_mae, 6) AS test_mae FROM b "
       "WHERE replace(model, '#1', 'Stack') NOT LIKE '%Stack%' ORDER BY b.test_mae, model LIMIT 10")
def best_bases(spark, sf_dir):
    """Ensembles are left out before the best ten are taken."""
    board = _board(spark, sf_dir).withColumn("model", F.replace("model", F.lit("#1"), F.lit("Stack")))
    return r6(md.best_bases(board, 10, "test_mae").select("model", "test_mae"), "test_mae")


@query("w8_top_features_per_model", """SELECT model, feature, round(importance, 6) AS importance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM (
    SELECT o_orderstatus AS model, 'c' || (o_custkey % 12) AS feature, avg(o_totalprice) AS importance FROM orders GROUP BY 1, 2))
  WHERE rank <= 5""")
def top_features(spark, sf_dir):
    feature = F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(12)).cast("string"))
    scores = (table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model"), feature.alias("feature"))
              .agg(F.avg("o_totalprice").alias("importance")))
    return r6(ev.top_features(scores, 5), "importance")


@query("t14_compare_sources")
def compare_sources(spark, sf_dir):
    """A search per source and combination; lines sorted by held-out error."""
    df = _ready(spark, sf_dir).select("id", "source", "features", "label")
    out = training.compare_sources(df, "source", ["F", "O", "P"], "id", md.boosted(trees=3, rate=0.5),
                                   {"maxDepth": [2]}, folds=2, hashed=False)
    return out.board.drop("train_minutes")


_COMBINED = f"""WITH p AS (SELECT *, {split_sql('id')} AS split, {bucket_sql('id', 99, 2)} AS fold FROM ({PLANTED_SQL})),
  c AS (SELECT * FROM (VALUES (0, 'F', ['F']), (1, 'O', ['O']), (2, 'P', ['P']), (3, 'F + O', ['F', 'O']), (4, 'F + P', ['F', 'P']),
    (5, 'O + P', ['O', 'P']), (6, 'F + O + P', ['F', 'O', 'P'])) v(ordinal, dataset, members)),
  q AS (SELECT ordinal, dataset, p.* FROM p JOIN c ON list_contains(members, source)),
  cvl AS (SELECT dataset, f, regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM q, range(2) r(f) WHERE split = 'train' AND fold <> f GROUP BY 1, 2),
  cv AS (SELECT dataset, avg(mae) AS cv_mae FROM (SELECT q.dataset, fold, avg(abs(y - i - s * a)) AS mae FROM q JOIN cvl
    ON q.dataset = cvl.dataset AND fold = f WHERE split = 'train' GROUP BY 1, 2) GROUP BY 1),
  l AS (SELECT dataset, regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM q WHERE split = 'train' GROUP BY 1),
  t AS (SELECT ordinal, dataset, avg(abs(y - i - s * a)) AS mae, sqrt(avg((y - i - s * a) * (y - i - s * a))) AS rmse, var_pop(y) AS vy
    FROM q JOIN l USING (dataset) WHERE split = 'test' GROUP BY 1, 2)"""


@query("t14_compare_lines", f"""{_COMBINED} SELECT CAST(ordinal AS INT) AS ordinal, dataset, 'LinearRegressionModel' AS model_type, round(cv_mae, 4) AS cv_mae,
  round(mae, 4) AS test_mae, round(rmse, 4) AS test_rmse, round(1 - rmse * rmse / vy, 4) AS test_r2, mae < 0.3 AS goal FROM t JOIN cv USING (dataset)""")
def compare_lines(spark, sf_dir):
    """The board of all sources and combinations of them, each with a line found by cross-validation."""
    df = _ready(spark, sf_dir, ["a"]).select("id", "source", "features", "label")
    line = LinearRegression(featuresCol="features", labelCol="label", solver="normal")
    out = training.compare_sources(df, "source", ["F", "O", "P"], "id", line, {"regParam": [0.0]}, folds=2, goal=0.3, hashed=False)
    return r6(out.board.drop("train_minutes"), "cv_mae", "test_mae", "test_rmse", "test_r2", places=4)


@query("t13_second_strategies")
def second_strategies(spark, sf_dir):
    """No model meets a hard goal, so the best source is tried again, transformed and stacked."""
    df = _ready(spark, sf_dir).select("id", "source", "a", "b", "features", "label")
    tree = md.boosted(trees=2, rate=0.3)
    first = training.compare_sources(df, "source", ["F", "O", "P"], "id", tree, {"maxDepth": [2]}, sizes=(1,), folds=2,
                                     goal=0.001, hashed=False)
    board = training.retry_best(df, "source", first, ["a", "b"], "id", tree, {"maxDepth": [2]},
                                {"ridge": md.LinearFamily("ridge", 1.0)}, folds=2, goal=0.001, hashed=False)
    return board.drop("train_minutes")


_STUMP = f"""WITH p AS (SELECT id, y, CAST(id % 5 AS DOUBLE) AS u, CAST(id % 11 % 3 AS DOUBLE) AS v FROM ({PLANTED_SQL})),
  cuts AS (SELECT f, t, sum(y) FILTER (WHERE x <= t) AS sl, count(*) FILTER (WHERE x <= t) AS nl, sum(y) FILTER (WHERE x > t) AS sr,
    count(*) FILTER (WHERE x > t) AS nr FROM (SELECT 'u' AS f, u AS x, y FROM p UNION ALL SELECT 'v', v, y FROM p) JOIN
    (VALUES ('u', 0.5), ('u', 1.5), ('u', 2.5), ('u', 3.5), ('v', 0.5), ('v', 1.5)) c(g, t) ON f = g GROUP BY 1, 2),
  best AS (SELECT * FROM cuts ORDER BY sl * sl / nl + sr * sr / nr DESC LIMIT 1)"""


@query("t5_boosted_stump", f"""{_STUMP} SELECT id, round(CASE WHEN CASE WHEN f = 'u' THEN u ELSE v END <= t THEN sl / nl ELSE sr / nr END, 6) AS prediction
  FROM p, best""")
def boosted_stump(spark, sf_dir):
    """One boosted tree of depth one: the best of all cuts through two features, and the means on its sides."""
    return r6(_stump(spark, sf_dir)[1].select("id", "prediction"), "prediction")


def _stump(spark, sf_dir):
    k = F.col("id")
    df = planted(spark, sf_dir).withColumns({"u": F.pmod(k, F.lit(5)).cast("double"), "v": F.pmod(F.pmod(k, F.lit(11)), F.lit(3)).cast("double")})
    df = df.withColumn("features", md.as_vector(["u", "v"])).withColumn("label", F.col("y"))
    model = md.boosted(trees=1, depth=1, rate=1.0).fit(df)
    return model, model.transform(df)


@query("x4_boosted_stump_importance", f"""{_STUMP} SELECT feature, CASE WHEN feature = f THEN 1.0 ELSE 0.0 END::DOUBLE AS importance
  FROM best, (VALUES ('u'), ('v')) n(feature)""")
def stump_importance(spark, sf_dir):
    """The only cut has all of the importance."""
    return md.importances(_stump(spark, sf_dir)[0], ["u", "v"], spark)


@query("s12_bundle_round_trip", f"SELECT id, true AS same, true AS named FROM ({PLANTED_SQL})")
def bundle(spark, sf_dir):
    """A saved run of training, loaded again, scores every row as before."""
    df = planted(spark, sf_dir)
    done = training.train(df, "y", ["a", "b"], ["segment"], "id", bases={"ridge": md.LinearFamily("ridge", 1.0),
                          "tree": md.boosted(trees=2, depth=2, rate=0.5)}, explainer=md.boosted(trees=2, rate=0.5), folds=2, hashed=False)
    path = fresh_path(spark, "bundle")
    done.save(path)
    loaded = training.Trained.load(spark, path)
    before = done.score(df).withColumnRenamed("prediction", "before")
    both = loaded.score(before)
    return both.select("id", (F.col("before") == F.col("prediction")).alias("same"), F.lit(loaded.names == done.names).alias("named"))


@query("s12_bundle_with_neighbours", f"SELECT id, true AS same FROM ({PLANTED_SQL})")
def neighbour_bundle(spark, sf_dir):
    """A saved stack with a neighbour base, its boxes beside it, scores every row as before."""
    df = planted(spark, sf_dir)
    done = training.train(df, "y", ["a", "b"], ["segment"], "id", bases={"ridge": md.LinearFamily("ridge", 1.0),
                          "nearest": NeighbourRegressor("features", "label", "id", 5)}, explainer=md.boosted(trees=2, rate=0.5),
                          folds=2, hashed=False)
    path = fresh_path(spark, "bundle")
    done.save(path)
    before = done.score(df).withColumnRenamed("prediction", "before")
    both = training.Trained.load(spark, path).score(before)
    return both.select("id", (F.abs(F.col("before") - F.col("prediction")) <= 1e-9).alias("same"))


@query("t_train_stacked_model")
def train_model(spark, sf_dir):
    """Split, preprocess with interactions, stack, and a separate model to explain: metrics of both."""
    df = planted(spark, sf_dir)
    done = training.train(df, "y", ["a", "b"], ["segment", "source"], "id", [("source", "b", "group_x_b")],
                          bases={"ridge": md.LinearFamily("ridge", 1.0), "lasso": md.LinearFamily("lasso", 0.01)},
                          explainer=md.boosted(trees=5, rate=0.3), folds=3, hashed=False)
    return done.metrics


@query("t_train_held_out", f"""WITH p AS (SELECT *, {split_sql('id')} AS split FROM ({PLANTED_SQL}))
  SELECT model, (SELECT count(*) FROM p WHERE split = 'test' AND y IS NOT NULL) AS n, true AS explains
  FROM (VALUES ('stack'), ('explainer')) m(model)""")
def train_held_out(spark, sf_dir):
    """Both models are measured on every held-out row, of whose spread they explain more than half."""
    return train_model(spark, sf_dir).select("model", "n", (F.col("r2") > 0.5).alias("explains"))
