"""Ranking, scaling, encoding, power transform, splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...operators import ranking as rk
from ...operators import transform as tr
from ...operators.models import as_vector, boosted, importances
from ..survey import PLANTED_SQL, SURVEY_SQL, bucket_sql, planted, r6, split_sql, survey, table
from .registry import query


def _edge(c: str, i: int) -> str:
    return (f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM p) "
            f"WHERE rn = greatest(ceil(CAST({i / 10} AS DOUBLE) * n), 1))")


def _bins(c: str) -> str:
    return "CAST(" + " + ".join(f"(p.{c} > e.{c}{i})::INT" for i in range(1, 10)) + " AS VARCHAR)"


def _mi(feature: str, target: str = "y") -> str:
    return (f"SELECT '{target}' AS target, '{feature}' AS feature, sum(n / total * ln(n * total / (nx * ny))) AS mi FROM (SELECT n, "
            f"sum(n) OVER () AS total, sum(n) OVER (PARTITION BY {feature}) AS nx, sum(n) OVER (PARTITION BY {target}) AS ny "
            f"FROM (SELECT {feature}, {target}, count(*)::DOUBLE AS n FROM binned GROUP BY 1, 2))")


_BINNED = f"""WITH p AS ({PLANTED_SQL}), e AS (SELECT {', '.join(f'{_edge(c, i)} AS {c}{i}' for c in 'aby' for i in range(1, 10))}),
  binned AS (SELECT segment, {', '.join(f'{_bins(c)} AS {c}' for c in 'aby')} FROM p, e),
  mi AS ({' UNION ALL '.join(_mi(f) for f in ('a', 'b', 'segment'))})"""


@query("x2_mutual_information", f"{_BINNED} SELECT target, feature, round(mi, 6) AS mi FROM mi")
def mutual(spark, sf_dir):
    return r6(rk.mutual_information(planted(spark, sf_dir), ["a", "b", "segment"], ["y"]), "mi")


@query("a16_l3_top_share", f"{_BINNED} SELECT feature, round(mi, 6) AS score, 1 AS rank FROM mi ORDER BY mi DESC LIMIT 1")
def top_share(spark, sf_dir):
    """Scores averaged over targets; the best max(1, int(n * 0.5)) features."""
    scores = rk.average_over_targets(rk.mutual_information(planted(spark, sf_dir), ["a", "b", "segment"], ["y"]), "mi")
    return r6(rk.top_share(scores.withColumnRenamed("mi", "score"), 0.5), "score")


@query("a16_top_share_of_two_targets", f"""{_BINNED}, shares AS ({' UNION ALL '.join(
    _mi(f, t) for t in ('y', 'a') for f in ('a', 'b', 'segment', 'y') if f != t)}),
  mean AS (SELECT feature, avg(mi) AS score FROM shares GROUP BY 1),
  placed AS (SELECT feature, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, feature) AS INT) AS rank,
  count(*) OVER () AS n FROM mean) SELECT feature, score, rank FROM placed WHERE rank <= greatest(1, floor(n * 0.75))""")
def top_share_of_two(spark, sf_dir):
    """The best three quarters by the mean over two targets, each of which is a feature of the other."""
    shares = rk.mutual_information(planted(spark, sf_dir), ["a", "b", "segment", "y"], ["y", "a"])
    scores = rk.average_over_targets(shares, "mi").withColumnRenamed("mi", "score")
    return r6(rk.top_share(scores, 0.75), "score")


@query("x1_rank_features")
def ranked(spark, sf_dir):
    """Information and forest importance for two targets; a constant target is skipped."""
    df = planted(spark, sf_dir).withColumns({"flat": F.lit(1.0), "z": F.col("b") * 3 + F.col("a")})
    return rk.rank_features(df, ["y", "z", "flat"], ["a", "b", "segment"], trees=10, depth=5)


@query("x1_rank_shares", f"""{_BINNED}, share AS (SELECT target, feature, mi / sum(mi) OVER () AS mi FROM mi)
  SELECT target, feature, round(mi, 6) AS mi, 1.0::DOUBLE AS importances, 0.0::DOUBLE AS off FROM share""")
def rank_shares(spark, sf_dir):
    """Shares of the information; the forest's importances sum to 1 and the score is the mean of both; a constant target is skipped."""
    out = rk.rank_features(planted(spark, sf_dir).withColumn("flat", F.lit(1.0)), ["y", "flat"], ["a", "b", "segment"], trees=5, depth=4)
    of_target = Window.partitionBy("target")
    off = F.abs(F.col("score") - (F.col("mi") + F.col("importance")) / 2)
    return r6(out.select("target", "feature", "mi", F.sum("importance").over(of_target).alias("importances"), off.alias("off")),
              "mi", "importances", "off")


@query("x3_single_cause", f"""WITH p AS ({PLANTED_SQL}) SELECT 'y' AS target, feature, CAST(var_pop(CASE feature WHEN 'u' THEN CAST(a > 1.5 AS INT)
  ELSE 1 END) > 0 AS INT)::DOUBLE AS importance FROM p, (VALUES ('u'), ('flat')) n(feature) GROUP BY 2""")
def single_cause(spark, sf_dir):
    """Of a question that tells something and a constant, the question has all of the importance."""
    df = planted(spark, sf_dir).withColumns({"u": (F.col("a") > 1.5).cast("double"), "flat": F.lit(1.0)})
    return rk.forest_importance(df, ["u", "flat"], "y", trees=10, depth=3)


@query("x3_forest_importance")
def forest_importance(spark, sf_dir):
    df = planted(spark, sf_dir)
    number = rk.forest_importance(df, ["a", "b", "segment"], "y", trees=10, depth=5)
    return number.unionByName(rk.forest_importance(df, ["a", "b", "y"], "segment", trees=5, depth=3))


@query("x4_boosted_importance")
def boosted_importance(spark, sf_dir):
    df = planted(spark, sf_dir).select(as_vector(["a", "b"]).alias("features"), F.col("y").alias("label"))
    return importances(boosted(trees=10, depth=4, rate=0.3).fit(df), ["a", "b"], spark, top=10)


@query("x5_standardise", """SELECT event_id, round((value - (SELECT avg(value) FROM events)) /
  (SELECT stddev_pop(value) FROM events), 6) AS value_z FROM events""")
def standardise(spark, sf_dir):
    _, out = tr.standardise(table(spark, sf_dir, "events"), ["value"])
    return r6(out.select("event_id", "value_z"), "value_z")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def _encoded(spark, sf_dir):
    """Fitted without one segment, applied to all rows; one number has gaps, so has one category."""
    df = planted(spark, sf_dir)
    df = df.withColumns({"a": F.when(F.pmod("id", F.lit(6)) != 1, F.col("a")),
                         "source": F.when(F.pmod("id", F.lit(8)) != 1, F.col("source"))})
    model = tr.fit_preprocessor(df.where("segment <> 'MACHINERY'"), ["a", "b"], ["segment", "source"],
                                [("source", "b", "group_x_b")])
    out = tr.prepared(model, df)
    names = tr.feature_names(out)
    x = out.select("id", vector_to_array("features").alias("x"))
    return names, x


_ENC = f"""WITH p AS (SELECT id, segment, b, CASE WHEN id % 6 <> 1 THEN a END AS a,
    CASE WHEN id % 8 <> 1 THEN source END AS source FROM ({PLANTED_SQL})),
  f AS (SELECT * FROM p WHERE segment <> 'MACHINERY'), m AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(b) AS sb FROM f),
  sa AS (SELECT stddev_pop(coalesce(a, ma)) AS sa FROM f, m),
  top AS (SELECT source AS s FROM f WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  z AS (SELECT id, segment, coalesce(source, s) AS source, (coalesce(a, ma) - ma) / sa AS za, (b - mb) / sb AS zb
    FROM p, m, sa, top)"""


@query("x7_preprocess", f"{_ENC} SELECT id, round(za, 6) AS x0, round(zb, 6) AS x1, "
       + ", ".join(f"CAST(segment = '{s}' AS INT)::DOUBLE AS x{i + 2}" for i, s in enumerate(_SEGMENTS)) + ", "
       + ", ".join(f"CAST(source = '{s}' AS INT)::DOUBLE AS x{i + 6}" for i, s in enumerate("FOP")) + ", "
       + ", ".join(f"round(CAST(source = '{s}' AS INT) * zb, 6) + 0.0::DOUBLE AS x{i + 9}" for i, s in enumerate("FOP")) + " FROM z")
def preprocess(spark, sf_dir):
    names, x = _encoded(spark, sf_dir)
    return x.select("id", *[(F.round(F.col("x")[i], 6) + F.lit(0.0)).alias(f"x{i}") for i in range(len(names))])


@query("x6_one_hot", f"{_ENC} SELECT segment, "
       + ", ".join(f"CAST(segment = '{s}' AS INT)::DOUBLE AS is_{s.lower()}" for s in _SEGMENTS) + ", count(*) AS n FROM z GROUP BY ALL")
def one_hot(spark, sf_dir):
    """The segment that was not seen while fitting has zeros everywhere."""
    names, x = _encoded(spark, sf_dir)
    flags = [F.col("x")[2 + i].alias(f"is_{s.lower()}") for i, s in enumerate(_SEGMENTS)]
    segment = planted(spark, sf_dir).select("id", "segment")
    return segment.join(x.select("id", *flags), "id").groupBy("segment", *[f"is_{s.lower()}" for s in _SEGMENTS]).agg(
        F.count(F.lit(1)).alias("n"))


@query("x8_feature_names", f"WITH p AS ({PLANTED_SQL}), s AS (SELECT DISTINCT segment FROM p WHERE segment <> 'MACHINERY'), "
       "o AS (SELECT DISTINCT source FROM p), n AS (SELECT 0 AS g, 'a' AS name UNION ALL SELECT 1, 'b' UNION ALL SELECT 2, "
       "'segment_' || segment FROM s UNION ALL SELECT 3, 'source_' || source FROM o UNION ALL SELECT 4, 'group_x_b_' || source FROM o) "
       "SELECT CAST(row_number() OVER (ORDER BY g, name) - 1 AS INT) AS slot, name FROM n")
def names(spark, sf_dir):
    found, _ = _encoded(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(found)), "slot int, name string")


_GRID = [round(-2 + 0.5 * i, 6) for i in range(13)]


def _yj(x: str, p: float) -> str:
    up = f"ln(1 + {x})" if p == 0 else f"(pow({x} + 1, {p}) - 1) / {p}"
    down = f"-ln(1 - {x})" if p == 2 else f"-(pow(1 - {x}, {2 - p}) - 1) / {2 - p}"
    return f"CASE WHEN {x} >= 0 THEN {up} ELSE {down} END"


def _likelihood(c: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS power, -count(*) / 2.0 * ln(var_pop({_yj(c, p)})) + ({p} - 1) * "
        f"sum(sign({c}) * ln(abs({c}) + 1)) AS ll FROM p" for p in _GRID)


_POWER = f"WITH p AS ({PLANTED_SQL}), ll AS ({_likelihood('b')} UNION ALL {_likelihood('a')}), best AS (" \
         "SELECT \"column\", arg_max(power, ll) AS power FROM ll GROUP BY 1)"


@query("x9_yeo_johnson_power", f"{_POWER} SELECT * FROM best")
def power(spark, sf_dir):
    best, _ = tr.yeo_johnson(planted(spark, sf_dir), ["a", "b"], grid=_GRID, refine=0)
    return spark.createDataFrame([(c, float(p)) for c, p in best.items()], "column string, power double")


@query("x9_yeo_johnson_values", f"""{_POWER}, v AS (SELECT id, CASE (SELECT power FROM best WHERE "column" = 'b') """
       + " ".join(f"WHEN {p} THEN {_yj('b', p)}" for p in _GRID)
       + " END AS v FROM p) SELECT id, round((v - (SELECT avg(v) FROM v)) / (SELECT stddev_pop(v) FROM v), 5) AS b FROM v")
def power_values(spark, sf_dir):
    _, out = tr.yeo_johnson(planted(spark, sf_dir), ["b"], grid=_GRID, refine=0)
    return r6(out.select("id", "b"), "b", places=5)


@query("x10_interactions", f"""WITH survey AS ({SURVEY_SQL}) SELECT id, """ + ", ".join(
    f'round(CAST("PostRgroupname" = {g} AS INT) * {m}, 6) AS {n}_{g}' for m, n in (
        ('"PreBLHBA1C"', "group_x_hba1c"), ('coalesce("PreBLFBS", 0)', "group_x_fbs")) for g in (1, 2, 3)) + " FROM survey")
def interactions(spark, sf_dir):
    """A level that no row has gives a column of zeros."""
    df = survey(spark, sf_dir).fillna({"PreBLFBS": 0.0})
    out = tr.interactions(df, "PostRgroupname", [1, 2, 3], {"PreBLHBA1C": "group_x_hba1c", "PreBLFBS": "group_x_fbs"})
    cols = [f"{n}_{g}" for n in ("group_x_hba1c", "group_x_fbs") for g in (1, 2, 3)]
    return r6(out.select("id", *cols), *cols)


@query("t1_split", f"SELECT o_orderkey, {split_sql('o_orderkey')} AS split, CAST({bucket_sql('o_orderkey', 99, 5)} AS INT) AS fold FROM orders")
def split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return tr.add_fold(tr.add_split(df, "o_orderkey", hashed=False), "o_orderkey", 5, hashed=False)
