"""Scores, clinical reading, what-if, sweeps, narrative."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import rules
from ...operators import explain as ex
from ...operators import models as md
from ...operators import scoring as sc
from ...operators.transform import fit_preprocessor
from ..survey import PLANTED_SQL, planted, r6
from .explaining import LINE, MEANS, SHEET_SQL, START, sheet
from .registry import query

_BAND = "CASE WHEN {0} < 5.7 THEN 'NORMAL' WHEN {0} < 6.5 THEN 'PRE_DIABETIC' WHEN {0} < 8.0 THEN 'DIABETIC' ELSE 'HIGH_RISK' END"
_CAT = "CASE WHEN {0} < 5.7 THEN 'Normoglycemia' WHEN {0} <= 6.4 THEN 'Prediabetes' ELSE 'Diabetes' END"
_RANK = "CASE WHEN {0} < 5.7 THEN 0 WHEN {0} <= 6.4 THEN 1 ELSE 2 END"


def _line_sql(changes: dict | None = None) -> str:
    parts = [f"CAST({START} AS DOUBLE)"]
    for f, b in LINE.items():
        parts.append(f"CAST({b} AS DOUBLE) * {(changes or {}).get(f, chr(34) + f + chr(34))}")
    return " + ".join(parts)


_COMPLETE = " AND ".join(f'"{f}" IS NOT NULL' for f in LINE)
_FULL = f"WITH s AS (SELECT * FROM ({SHEET_SQL}) WHERE {_COMPLETE})"


def full(spark, sf_dir):
    """Answer sheets that have every column of the line."""
    return sheet(spark, sf_dir).dropna(subset=list(LINE))


def scorer():
    return sc.linear_scorer(LINE, START)


@query("c2_score_with_band", f"""{_FULL}, p AS (SELECT id, {_line_sql()} AS p FROM s) SELECT id, round(p, 2) AS score, {_BAND.format('p')} AS risk_band,
  CASE WHEN p < 5.7 THEN 'High Confidence' WHEN p < 8.0 THEN 'Moderate Confidence' ELSE 'High Confidence' END AS confidence FROM p""")
def band(spark, sf_dir):
    return sc.score(full(spark, sf_dir), scorer()).select("id", "score", "risk_band", "confidence")


@query("c1_score_model")
def score_model(spark, sf_dir):
    """Fitted preprocessor and model in one scorer, prediction at two places."""
    df = planted(spark, sf_dir)
    made = fit_preprocessor(df, ["a", "b"], ["segment", "source"], [("source", "b", "group_x_b")])
    model = md.boosted(trees=5, rate=0.3, label="y").fit(made.transform(df))
    return sc.score(df, sc.model_scorer(made, model)).select("id", "score", "risk_band", "confidence")


@query("c1_score_line", f"""WITH p AS ({PLANTED_SQL}), l AS (SELECT regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM p),
  v AS (SELECT id, i + s * a AS p FROM p, l) SELECT id, round(p, 2) AS score, {_BAND.format('p')} AS risk_band,
  CASE WHEN p < 5.7 THEN 'High Confidence' WHEN p < 8.0 THEN 'Moderate Confidence' ELSE 'High Confidence' END AS confidence FROM v""")
def score_line(spark, sf_dir):
    """A fitted preprocessor and a line behind it: the z-score does not move the line's predictions."""
    df = planted(spark, sf_dir)
    made = fit_preprocessor(df, ["a"], [])
    model = md.LinearFamily("ridge", 0.0, label="y").fit(made.transform(df))
    return sc.score(df, sc.model_scorer(made, model)).select("id", "score", "risk_band", "confidence")


_LINES = f"""{_FULL}, p AS (SELECT id, "PreBLHBA1C" AS pre, "PostBLAge" AS age, round({_line_sql()}, 2) AS post FROM s),
  d AS (SELECT *, round(pre - post, 2) AS delta, {_CAT.format('pre')} AS pre_category, {_CAT.format('post')} AS post_category,
    CASE WHEN ({_RANK.format('post')}) < ({_RANK.format('pre')}) THEN 'Regression' WHEN ({_RANK.format('post')}) = ({_RANK.format('pre')})
      THEN 'Persistence' ELSE 'Progression' END AS trajectory, CASE WHEN age < 65 THEN 7.0 ELSE 7.5 END::DOUBLE AS target FROM p),
  r AS (SELECT *, CASE WHEN pre <= 6.4 THEN NULL WHEN delta >= 1.0 THEN 'Major improvement – Risk reduction achieved'
      WHEN delta >= 0.5 THEN 'Clinically meaningful improvement' WHEN delta >= 0 THEN 'Stabilization / modest improvement'
      ELSE 'Non-response' END AS response,
    CASE WHEN pre > 7.0 THEN CASE WHEN round(pre, 1) <= target AND round(post, 1) <= target THEN 'At target'
      WHEN round(pre, 1) <= target THEN 'Above target' WHEN round(post, 1) <= target THEN 'Achieved target'
      ELSE 'Not achieved' END END AS attainment FROM d)"""


@query("c3_clinical_lines", f"""{_LINES} SELECT id, delta, trajectory, response, attainment,
  'Predicted outcome: ' || pre_category || ' → ' || post_category || ' (' || trajectory || ')' AS outcome_line,
  'Predicted response: ' || response || ' (ΔHbA1c ' || printf('%+.2f', delta) || ')' AS response_line,
  'Glycemic control target: ≤' || printf('%.1f', target) || '% (age ' || CAST(age AS INT) || ') | ' || attainment AS target_line FROM r""")
def clinical(spark, sf_dir):
    scored = sc.score(full(spark, sf_dir), scorer())
    out = sc.clinical_lines(scored, "PreBLHBA1C", "score", "PostBLAge")
    return out.select("id", "delta", "trajectory", "response", "attainment", "outcome_line", "response_line", "target_line")


# two more scenarios than the usual pair, so that several apply to one record
SCENARIOS = [*rules.SCENARIOS,
             (3, "PreRdiafather_1", 1, 0, "No family history", "What if the father had no diabetes?", "Yes", "No"),
             (4, "PreRdiafather_1", 0, 1, "Family history", "What if the father had diabetes?", "No", "Yes")]


def _scenario_sql(i, f, old, new, title):
    return (f"SELECT id, {i} AS scenario_id, '{f}' AS field, '{title}' AS title, {_line_sql()} AS p0, "
            f"{_line_sql({f: f'CAST({new} AS DOUBLE)'})} AS p1 FROM s WHERE \"{f}\" = {old}")


_WHAT = f"{_FULL}, w AS ({' UNION ALL '.join(_scenario_sql(i, f, o, n, t) for i, f, o, n, t, *_ in SCENARIOS)})," \
        " r AS (SELECT id, scenario_id, field, title, round(p0, 2) AS original, round(p1, 2) AS modified FROM w)," \
        " d AS (SELECT *, round(original - modified, 2) AS delta, CASE WHEN original > 0 THEN" \
        " round((original - modified) / original * 100, 2) ELSE 0 END::DOUBLE AS improvement_pct FROM r)"


@query("c4_j4_m16_what_if", f"{_WHAT} SELECT * FROM d")
def what_if(spark, sf_dir):
    """Each record under each change that applies to it."""
    return sc.what_if(full(spark, sf_dir), scorer(), SCENARIOS).select(
        "id", "scenario_id", "field", "title", "original", "modified", "delta", "improvement_pct")


@query("w6_best_scenario", f"{_WHAT} SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY "
       "field = 'PostRgroupname' DESC, CASE WHEN field = 'PostRgroupname' THEN 0 ELSE -delta END, scenario_id) = 1")
def best(spark, sf_dir):
    return sc.best_scenario(sc.what_if(full(spark, sf_dir), scorer(), SCENARIOS), ["id"])


_BOTH = _line_sql({"PostRgroupname": '(3 - "PostRgroupname")', "PreRdiafather_1": '(1 - "PreRdiafather_1")'})


@query("c5_combined_scenario", f"""{_FULL}, p AS (SELECT id, round({_line_sql()}, 2) AS original, round({_BOTH}, 2) AS combined FROM s)
  SELECT id, original, combined, {_BAND.format('combined')} AS combined_band, 2 AS changes FROM p""")
def combined(spark, sf_dir):
    out = sc.combined(full(spark, sf_dir), scorer(), SCENARIOS)
    return out.select("id", "original", "combined", "combined_band", "changes")


GRID = {"PostRgroupname": [1.0, 2.0], "PreBLHBA1C": [float(v) for v in range(4, 19, 2)]}


@query("c6_sweep", f"""{_FULL}, g AS (SELECT s.*, CAST(grp AS DOUBLE) AS grp, CAST(lab AS DOUBLE) AS lab FROM s, unnest([1, 2]) a(grp),
  unnest([4, 6, 8, 10, 12, 14, 16, 18]) b(lab)), p AS (SELECT id, grp, lab, round({_line_sql()}, 2) AS baseline,
  round({_line_sql({'PostRgroupname': 'grp', 'PreBLHBA1C': 'lab'})}, 2) AS simulated FROM g)
  SELECT id, grp AS "PostRgroupname", lab AS "PreBLHBA1C", baseline, simulated, round(simulated - baseline, 2) + 0.0::DOUBLE AS change,
  round(least((simulated - 3) / 13 * 100, 100), 6) AS gauge FROM p""")
def sweep(spark, sf_dir):
    """Care plan and baseline value over a grid, with the change from the record's own score."""
    out = sc.sweep(full(spark, sf_dir), scorer(), GRID)
    out = out.withColumn("change", F.col("change") + F.lit(0.0))
    return r6(out.select("id", "PostRgroupname", "PreBLHBA1C", "baseline", "simulated", "change", "gauge"), "gauge")


@query("f16_narrative", f"""{_FULL}, p AS (SELECT *, {_line_sql()} AS p FROM s) SELECT id, concat_ws(chr(10) || chr(10),
  '=== PATIENT DIABETES ASSESSMENT DATA ===',
  'PATIENT PROFILE:' || chr(10) || '  - Age: ' || "PostBLAge" || ' years' || chr(10) || '  - Gender: N/A' || chr(10) || '  - Area: N/A' || chr(10) ||
    '  - Marital Status: N/A' || chr(10) || '  - Education Level: N/A' || chr(10) || '  - Occupation: N/A',
  'FAMILY DIABETES HISTORY:' || chr(10) || '  - Father Diabetic: No' || chr(10) || '  - Mother Diabetic: No' || chr(10) ||
    '  - Brother Diabetic: No' || chr(10) || '  - Sister Diabetic: No',
  'LIFESTYLE:' || chr(10) || '  - Current Smoking: No' || chr(10) || '  - Current Alcohol: No' || chr(10) || '  - Sleep Quality: N/A (1=Good, 4=Poor)',
  'HEALTH METRICS:' || chr(10) || '  - Waist: ' || "PreRwaist" || ' cm' || chr(10) || '  - BMI: N/A' || chr(10) || '  - Systolic BP: ' ||
    "PreRsystolicfirst" || ' mmHg' || chr(10) || '  - Diastolic BP: N/A mmHg',
  'BLOOD WORK:' || chr(10) || '  - Fasting Blood Sugar (FBS): ' || "PreBLFBS" || ' mg/dL' || chr(10) ||
    '  - Post-Prandial Blood Sugar (PPBS): N/A mg/dL' || chr(10) || '  - Pre-Treatment HbA1c: ' || "PreBLHBA1C" || '%' || chr(10) ||
    '  - Cholesterol: ' || "PreBLCHOLESTEROL" || ' mg/dL' || chr(10) || '  - Triglycerides: N/A mg/dL' || chr(10) ||
    '  - Diabetic Duration: N/A years' || chr(10) || '  - Intervention Group: ' || CASE "PostRgroupname" WHEN 1 THEN 'Yoga' ELSE 'Control' END,
  'PREDICTED OUTCOME:' || chr(10) || '  - Predicted Post-Treatment HbA1c: ' || round(p, 2) || '%' || chr(10) || '  - Risk Level: ' ||
    {_BAND.format('p')} || chr(10) || '  - Confidence: ' || CASE WHEN p < 5.7 OR p >= 8.0 THEN 'High Confidence' ELSE 'Moderate Confidence' END,
  'TOP CONTRIBUTING FACTORS (SHAP):' || chr(10) || '  (None available)',
  'WHAT-IF SCENARIOS:' || chr(10) || '  (None generated)', repeat('=', 40)) AS narrative FROM p""")
def narrative(spark, sf_dir):
    return sc.narrative(sc.score(full(spark, sf_dir), scorer())).select("id", "narrative")


def _told(spark, sf_dir):
    """Narratives with factors, scenarios and the combined outcome; a record without scenarios has one too."""
    sheets = full(spark, sf_dir)
    df = ex.top_factors(ex.guardrail(ex.contributions_linear(sc.score(sheets, scorer()), LINE, MEANS, START)), k=3)
    told = sc.what_if(sheets, scorer()).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        "scenario_id", "title", "original", "modified", "delta", "description"))).alias("scenarios"))
    together = sc.combined(sheets, scorer(), SCENARIOS).select("id", "combined", "combined_band")
    return sc.narrative(df.join(told, "id", "left").join(together, "id", "left"))


@query("f16_narrative_with_factors")
def narrative_long(spark, sf_dir):
    return _told(spark, sf_dir).select("id", "narrative")


@query("f16_combined_outcome", f"""{_FULL}, p AS (SELECT id, round({_BOTH}, 2) AS combined FROM s) SELECT id,
  '  BEST COMBINED OUTCOME (all changes): HbA1c ' || combined || '% (' || {_BAND.format('combined')} || ')' AS line FROM p""")
def combined_outcome(spark, sf_dir):
    """The line of the combined outcome, read out of the narrative."""
    return _told(spark, sf_dir).select("id", F.regexp_extract("narrative", r"(?m)^  BEST COMBINED .*$", 0).alias("line"))
