"""Contributions and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import rules
from ...operators import explain as ex
from ...operators import models as md
from ..survey import PLANTED_SQL, SURVEY_SQL, case_map, planted, r6, survey
from .registry import query

# a fixed line over answer-sheet columns; odd digits keep rounded results away from ties
LINE = {
    "PreBLHBA1C": 0.4537190381, "PreBLFBS": 0.0041170923, "PreBLCHOLESTEROL": 0.0013370741,
    "PreRsystolicfirst": -0.0073190217, "PreRwaist": -0.0051930411, "PostBLAge": 0.0071930127,
    "PreRdiafather_1": 0.1271930571, "PostRgroupname": 0.3190571273,
}
MEANS = {"PreBLHBA1C": 10.25, "PreBLFBS": 290.0, "PreBLCHOLESTEROL": 250.0, "PreRsystolicfirst": 139.0,
         "PreRwaist": 113.0, "PostBLAge": 51.0, "PreRdiafather_1": 0.4, "PostRgroupname": 1.5}
START = 1.8190371
BASE = START + sum(b * MEANS[f] for f, b in LINE.items())


def sheet(spark, sf_dir):
    """Answer sheets with the columns of the line; blanks stay blank."""
    df = survey(spark, sf_dir)
    father = F.pmod("id", F.lit(7))
    return df.select("id", "source", *[c for c in LINE if c in df.columns], F.col("PreBLAge").alias("PostBLAge"),
                     F.when(father < 3, 1.0).when(father < 6, 0.0).alias("PreRdiafather_1"))


SHEET_SQL = "SELECT *, \"PreBLAge\" AS \"PostBLAge\", CASE WHEN id % 7 < 3 THEN CAST(1 AS DOUBLE) WHEN id % 7 < 6 THEN " \
            f"CAST(0 AS DOUBLE) END AS \"PreRdiafather_1\" FROM ({SURVEY_SQL})"
_FACTORS = " UNION ALL ".join(
    f"SELECT id, source, '{f}' AS feature, \"{f}\" AS value, CAST({b} AS DOUBLE) * (\"{f}\" - CAST({MEANS[f]} AS DOUBLE)) AS phi FROM s"
    for f, b in LINE.items())
LONG_SQL = f"WITH s AS ({SHEET_SQL}), f AS ({_FACTORS})"


def explained(spark, sf_dir):
    return ex.contributions_linear(sheet(spark, sf_dir), LINE, MEANS, START)


@query("e2_linear_contributions", f"{LONG_SQL} SELECT id, feature, value, round(phi, 6) AS phi, round({BASE}, 6) AS base FROM f")
def linear(spark, sf_dir):
    long = ex.long_factors(explained(spark, sf_dir), ["id", "base"])
    return r6(long.select("id", "feature", "value", "phi", "base"), "phi", "base")


def _forest(spark, sf_dir):
    df = planted(spark, sf_dir).withColumn("features", md.as_vector(["a", "b"])).withColumn("label", F.col("y"))
    return df, md.forest(trees=5, depth=4).fit(df)


_ADDS_UP = f"WITH p AS ({PLANTED_SQL}) SELECT id, true AS adds_up FROM p"


@query("e1_forest_contributions", _ADDS_UP)
def forest(spark, sf_dir):
    """Base and contributions add up to the prediction for every row."""
    df, model = _forest(spark, sf_dir)
    out = ex.contributions_trees(model.transform(df), model, ["a", "b"])
    total = F.col("base") + F.aggregate("factors", F.lit(0.0), lambda s, f: s + f["phi"])
    return out.select("id", (F.abs(total - F.col("prediction")) < 1e-6).alias("adds_up"))


@query("e1_boosted_contributions", _ADDS_UP)
def boosted(spark, sf_dir):
    df = planted(spark, sf_dir).withColumn("features", md.as_vector(["a", "b"])).withColumn("label", F.col("y"))
    model = md.boosted(trees=6, depth=4, rate=0.3).fit(df)
    out = ex.contributions_trees(model.transform(df), model, ["a", "b"])
    total = F.col("base") + F.aggregate("factors", F.lit(0.0), lambda s, f: s + f["phi"])
    return out.select("id", (F.abs(total - F.col("prediction")) < 1e-6).alias("adds_up"))


# the contributions of a tree that asks u first and then v on both sides, from the means of rows alike in u, in v's answer and in both
_ASKED = f"""WITH p AS (SELECT id, y, CAST(a > 1.5 AS DOUBLE) AS u, CAST(b > 1 AS DOUBLE) AS v FROM ({PLANTED_SQL})),
  whole AS (SELECT avg(y) AS f0, count(*)::DOUBLE AS n FROM p), byu AS (SELECT u, avg(y) AS fu, count(*) AS nu FROM p GROUP BY 1),
  cells AS (SELECT u, v, avg(y) AS fuv FROM p GROUP BY 1, 2),
  byv AS (SELECT v, sum(fuv * nu / n) AS fv FROM cells JOIN byu USING (u), whole GROUP BY 1),
  phi AS (SELECT id, f0, ((fu - f0) + (fuv - fv)) / 2 AS phi_u, ((fv - f0) + (fuv - fu)) / 2 AS phi_v
    FROM p JOIN byu USING (u) JOIN byv USING (v) JOIN cells USING (u, v), whole)"""


def _asked(spark, sf_dir, names=("u", "v"), depth=2):
    """Two yes-or-no questions, of which the first tells more by the planted signal; a single tree sees all rows once."""
    df = planted(spark, sf_dir).withColumns({"u": (F.col("a") > 1.5).cast("double"), "v": (F.col("b") > 1).cast("double")})
    df = df.withColumn("features", md.as_vector(list(names))).withColumn("label", F.col("y"))
    return df, md.forest(trees=1, depth=depth).setBootstrap(False).fit(df)


@query("e1_depth_two_contributions", f"{_ASKED} SELECT id, round(f0, 6) AS base, round(phi_u, 6) AS phi_u, round(phi_v, 6) AS phi_v FROM phi")
def depth_two(spark, sf_dir):
    """Contributions of both questions of a tree of depth two."""
    df, model = _asked(spark, sf_dir)
    out = ex.contributions_trees(df, model, ["u", "v"])
    return r6(out.select("id", "base", F.col("factors")[0]["phi"].alias("phi_u"), F.col("factors")[1]["phi"].alias("phi_v")),
              "base", "phi_u", "phi_v")


@query("e1_depth_one_contributions", f"""{_ASKED} SELECT id, round(f0, 6) AS base, round(fu - f0, 6) AS phi_u, 0.0::DOUBLE AS phi_v
  FROM p JOIN byu USING (u), whole""")
def depth_one(spark, sf_dir):
    """A tree that asks one question: the other feature adds nothing."""
    df, model = _asked(spark, sf_dir, depth=1)
    out = ex.contributions_trees(df, model, ["u", "v"])
    return r6(out.select("id", "base", F.col("factors")[0]["phi"].alias("phi_u"), F.col("factors")[1]["phi"].alias("phi_v")),
              "base", "phi_u", "phi_v")


@query("e3_explainable_base", f"""{_ASKED}, m AS (SELECT 'u' AS feature, avg(abs(phi_u)) AS mean_abs FROM phi UNION ALL
  SELECT 'v', avg(abs(phi_v)) FROM phi) SELECT feature, round(mean_abs, 6) AS mean_abs,
  CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INT) AS rank, 'forest' AS explained_model FROM m""")
def explainable(spark, sf_dir):
    """Of a stack's bases the first tree model is explained."""
    df, model = _asked(spark, sf_dir)
    line = md.LinearFamily("ridge", 1.0).fit(df)
    name, chosen = ex.explainable({"ridge": line, "forest": model})
    out = ex.importance(ex.contributions_trees(df, chosen, ["u", "v"])).withColumn("explained_model", F.lit(name))
    return r6(out, "mean_abs")


_IMPORTANCE = f"{LONG_SQL}, imp AS (SELECT feature, avg(abs(phi)) AS mean_abs FROM f GROUP BY 1), ranked AS (" \
              "SELECT *, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INT) AS rank FROM imp)"


@query("a13_e4_w1_importance", f"{_IMPORTANCE} SELECT feature, round(mean_abs, 6) AS mean_abs, rank FROM ranked")
def importance(spark, sf_dir):
    return r6(ex.importance(explained(spark, sf_dir)), "mean_abs")


@query("l2_top_features", f"{_IMPORTANCE} SELECT feature, round(mean_abs, 6) AS mean_abs FROM ranked WHERE rank <= 5")
def top_n(spark, sf_dir):
    top = ex.importance(explained(spark, sf_dir)).orderBy(F.desc("mean_abs"), "feature").limit(5)
    return r6(top.select("feature", "mean_abs"), "mean_abs")


def _leaders(df, k):
    return [r["feature"] for r in ex.importance(df).where(F.col("rank") <= k).orderBy("rank").collect()]


@query("e5_dependence", f"""{_IMPORTANCE}, top AS (SELECT * FROM ranked WHERE rank <= 3)
  SELECT f.id, f.feature, f.value, round(f.phi, 6) AS phi, n.feature AS colour_feature, c.value AS colour_value
  FROM f JOIN top t USING (feature) LEFT JOIN top n ON n.rank = t.rank + 1 LEFT JOIN f c ON c.id = f.id AND c.feature = n.feature""")
def dependence(spark, sf_dir):
    df = explained(spark, sf_dir)
    return r6(ex.dependence(df, _leaders(df, 3), ["id"]), "phi")


@query("e6_beeswarm", f"""{_IMPORTANCE}, facts AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM f GROUP BY 1)
  SELECT id, feature, value, CASE WHEN value IS NULL THEN 0.5 ELSE round((value - lo) / nullif(hi - lo, 0), 6) END::DOUBLE AS scaled, round(phi, 6) AS phi
  FROM f JOIN facts USING (feature) JOIN ranked USING (feature) WHERE rank <= 5""")
def beeswarm(spark, sf_dir):
    return r6(ex.beeswarm(explained(spark, sf_dir), ["id"], top=5), "scaled", "phi")


_WATER = """SELECT id, CAST(row_number() OVER w AS INT) AS step, feature, round(phi, 6) AS phi,
  round({base} + sum(phi) OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature ROWS UNBOUNDED PRECEDING), 6) AS running
  FROM f WHERE {condition} WINDOW w AS (PARTITION BY id ORDER BY abs(phi) DESC, feature)"""


def _known(df):
    return df.withColumn("factors", F.filter("factors", lambda f: f["phi"].isNotNull()))


@query("w3_waterfall", f"{LONG_SQL} " + _WATER.format(base=BASE, condition="phi IS NOT NULL"))
def waterfall(spark, sf_dir):
    return r6(ex.waterfall(_known(explained(spark, sf_dir)), ["id"]), "phi", "running")


@query("e7_chosen_records", f"{LONG_SQL} " + _WATER.format(base=BASE, condition="phi IS NOT NULL AND id IN (0, 50, 100)"))
def chosen(spark, sf_dir):
    """Waterfall of three chosen records, which is what the operator is for."""
    df = explained(spark, sf_dir).where(F.col("id").isin(0, 50, 100))
    return r6(ex.waterfall(_known(df), ["id"]), "phi", "running")


_HIDDEN = """CASE WHEN phi IS NULL OR phi = 0 OR value IS NULL THEN true
  WHEN feature LIKE 'PreBLFBS%' OR feature LIKE 'PreBLHBA1C%' THEN true
  WHEN feature LIKE 'PreBLCHOLESTEROL%' THEN value >= 200 AND phi < 0
  WHEN feature LIKE 'PreRsystolicfirst%' THEN value >= 130 AND phi < 0
  WHEN feature LIKE 'PreRwaist%' THEN value >= 90 AND phi < 0
  WHEN feature LIKE 'PreRdiafather%' THEN (value = 0 AND phi > 0) OR (value = 1 AND phi < 0)
  WHEN feature LIKE 'PostBLAge%' THEN value > 60 AND phi < 0 ELSE false END"""


@query("e8_guardrail", f"{LONG_SQL} SELECT id, feature, CASE WHEN phi > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM f WHERE NOT ({_HIDDEN})")
def guardrail(spark, sf_dir):
    long = ex.long_factors(ex.guardrail(explained(spark, sf_dir)), ["id"])
    return long.select("id", "feature", F.when(F.col("phi") > 0, "increase").otherwise("decrease").alias("direction"))


@query("e9_source_column", f"{LONG_SQL} SELECT feature, " + case_map("feature", {
    f: "PreRdiafather" if f == "PreRdiafather_1" else f for f in LINE}) + " AS source_column, count(*) AS records FROM f GROUP BY 1")
def source_column(spark, sf_dir):
    """The input column of an encoded feature: the longest name that it starts with."""
    origin = ex.source_columns(list(LINE), [*[f for f in LINE if "_" not in f], "PreRdiafather", "PreRdia", "PreR"])
    long = ex.long_factors(explained(spark, sf_dir), ["id"])
    column = F.create_map(*[F.lit(x) for item in origin.items() for x in item])
    return long.groupBy("feature", F.try_element_at(column, F.col("feature")).alias("source_column")).agg(
        F.count(F.lit(1)).alias("records"))


_READABLE = {f: rules.READABLE_NAMES[f.replace("_1", "")] for f in LINE}
_TOP = f"""{LONG_SQL}, shown AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature) AS r FROM f WHERE NOT ({_HIDDEN})),
  ten AS (SELECT *, max(abs(phi)) OVER (PARTITION BY id) AS largest FROM shown WHERE r <= {{k}})"""
_TOLD = f"""SELECT id, CAST({{place}} AS INT) AS place, feature, round(phi, 4) AS impact, CASE WHEN phi > 0 THEN 'Increases HbA1c' ELSE
  'Reduces HbA1c' END AS direction, concat_ws(' ', {case_map('feature', _READABLE)}, CASE WHEN abs(phi) > 0.3 THEN 'significantly'
  WHEN abs(phi) > 0.1 THEN 'moderately' ELSE 'slightly' END, CASE WHEN phi > 0 THEN 'increases' ELSE 'decreases' END,
  'predicted HbA1c') AS interpretation, round(abs(phi) * 100 / largest, 4) AS share FROM ten"""


def _top(df, **options):
    told = ex.top_factors(ex.guardrail(df), **options)
    return r6(ex.spread_array(told, ["id"], "top"), "share", places=4)


@query("w2_w4_top_factors", _TOP.format(k=10) + " " + _TOLD.format(place="r"))
def top_factors(spark, sf_dir):
    """Largest factors that may be shown, with their share of the largest one."""
    return _top(explained(spark, sf_dir), k=10)


_PINNED = (", spot AS (SELECT id AS pid, min(r) AS p FROM ten WHERE feature LIKE 'PostRgroupname%' GROUP BY 1), "
           "moved AS (SELECT ten.*, CASE WHEN p > 3 AND r = p THEN 3 WHEN p > 3 AND r >= 3 AND r < p THEN r + 1 ELSE r END AS place "
           "FROM ten LEFT JOIN spot ON pid = id) ")


@query("w5_pinned_factor", _TOP.format(k=10) + _PINNED + _TOLD.format(place="place").replace("FROM ten", "FROM moved"))
def pinned(spark, sf_dir):
    """The intervention moves up to the third place when it ranks lower."""
    return _top(explained(spark, sf_dir), k=10, pin="PostRgroupname")


@query("e10_run_summary", f"""WITH s AS ({SHEET_SQL}) SELECT 'full' AS model, count(*) AS records, 8 AS features,
  round({BASE}, 6)::DOUBLE AS expected_value FROM s UNION ALL SELECT 'short', count(*), 2,
  round({START} + {LINE['PreBLHBA1C']} * 10.25 + {LINE['PreBLFBS']} * 290, 6)::DOUBLE FROM s""")
def run_summary(spark, sf_dir):
    df = sheet(spark, sf_dir)
    short = {f: LINE[f] for f in ("PreBLHBA1C", "PreBLFBS")}
    return r6(ex.run_summary({"full": ex.contributions_linear(df, LINE, MEANS, START),
                              "short": ex.contributions_linear(df, short, MEANS, START)}), "expected_value")
