"""One query per scalar function: key and result over all answer sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import functions as fn
from ... import rules
from ...operators.lookup import decode
from ..survey import SURVEY_SQL, case_map, survey, table, text
from .registry import query

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _t(c: str) -> str:
    return f"lower({_TRIM.format(c)})"


def _number(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def _yes_no_sql(c: str) -> str:
    t = _t(c)
    w = f"regexp_replace({t}, '[^a-z0-9]', '', 'g')"
    n = f"try_cast({t} AS DOUBLE)"
    missing = ", ".join(text(m) for m in rules.MISSING_TOKENS)
    return (f"CASE WHEN {t} IS NULL OR {t} IN ({missing}) THEN NULL WHEN {n} = 1 THEN 1 WHEN {n} = 0 THEN 0 "
            f"WHEN {w} = '1' THEN 1 WHEN {w} = '0' THEN 0 "
            f"WHEN {w} LIKE 'yes%' OR {w} = 'y' OR {w} LIKE '%1' THEN 1 "
            f"WHEN {w} LIKE 'no%' OR {w} = 'n' OR {w} LIKE '%0' THEN 0 END")


def _dur_sql(c: str) -> str:
    return "coalesce(" + case_map(f"replace({_t(c)}, ' ', '')", rules.ACTIVITY_MINUTES) + ", -1)"


_WEIGHTS = rules.ACTIVITY_WEIGHTS
_SCORE_SQL = " + ".join(
    f"{_number(_WEIGHTS[k])} * CAST(greatest({_dur_sql(c)}, 0) AS DOUBLE) * 7" for k, c in rules.ACTIVITY_COLUMNS.items())


def _score():
    return fn.activity_score({k: fn.duration_minutes(F.col(c)) for k, c in rules.ACTIVITY_COLUMNS.items()})


_CATEGORY = "CASE WHEN {0} < 5.7 THEN 'Normoglycemia' WHEN {0} <= 6.4 THEN 'Prediabetes' WHEN {0} IS NOT NULL THEN 'Diabetes' END"
_RANK = "CASE WHEN {0} < 5.7 THEN 0 WHEN {0} <= 6.4 THEN 1 WHEN {0} IS NOT NULL THEN 2 END"
_PRE, _POST, _AGE = '"PreBLHBA1C"', '"PostBLHBA1C"', '"PreBLAge"'
_DELTA = f"round({_PRE} - {_POST}, 2)"
_DURATION = 'CASE WHEN "PreBLAge" - "PreRdiaage" BETWEEN 0 AND 80 THEN "PreBLAge" - "PreRdiaage" ELSE CAST(0 AS DOUBLE) END'
_SIGNED = f"printf('%+.2f', {_DELTA})"
_BMI = ('CASE WHEN "PreRheight" > 0 AND "PreRweight" > 0 AND '
        '"PreRweight" / nullif(("PreRheight" / 100) * ("PreRheight" / 100), 0) > 10 AND '
        '"PreRweight" / nullif(("PreRheight" / 100) * ("PreRheight" / 100), 0) < 100 THEN '
        '"PreRweight" / (("PreRheight" / 100) * ("PreRheight" / 100)) END')


def _c(name):
    return F.col(name)


def _delta():
    return F.round(_c("PreBLHBA1C") - _c("PostBLHBA1C"), 2)


# name -> (Spark expression, SQL expression); both become column ``result``
SCALARS = {
    "f1_clean_text": (lambda: fn.clean_text(_c("PreRgender")), _TRIM.format('"PreRgender"')),
    "f2_normalize_category": (
        lambda: fn.normalize_category(_c("PreRgender")),
        f"CASE WHEN {_t(chr(34) + 'PreRgender' + chr(34))} IS NULL OR {_t(chr(34) + 'PreRgender' + chr(34))} IN "
        f"('nan', 'none', 'na', '') THEN 'Missing' ELSE "
        + case_map("replace(" + _t('"PreRgender"') + ", ' ', '')", rules.GENDER, "'Other'") + " END"),
    "f3_map_area": (lambda: fn.map_area(_c("PreRarea")), case_map(_t('"PreRarea"'), rules.AREA, "'Missing'")),
    "f3_map_area_numeric": (lambda: fn.map_area(_c("PreRarea"), as_numeric=True),
                            case_map(_t('"PreRarea"'), {"urban": 1, "rural": 0}, "-1")),
    "f4_correct_labels": (
        lambda: fn.correct_labels(_c("PreRmaritalstatus")),
        "coalesce(" + case_map(f"regexp_replace({_t(chr(34) + 'PreRmaritalstatus' + chr(34))}, '\\s+', ' ', 'g')",
                               rules.MARITAL_CORRECTIONS,
                               f"regexp_replace({_t(chr(34) + 'PreRmaritalstatus' + chr(34))}, '\\s+', ' ', 'g')")
        + ", 'Missing')"),
    "f6_education_ordinal": (lambda: fn.ordinal(_c("PreReducation"), rules.EDUCATION),
                             case_map(_t('"PreReducation"'), rules.EDUCATION, "-1")),
    "f6_sleep_ordinal": (lambda: fn.ordinal(_c("PreRsleepquality"), rules.SLEEP),
                         case_map(_t('"PreRsleepquality"'), rules.SLEEP, "-1")),
    "f6_diet_ordinal": (lambda: fn.ordinal(_c("PreRskipbreakfast"), rules.DIET),
                        case_map(_t('"PreRskipbreakfast"'), rules.DIET, "-1")),
    "f6_milk_ordinal": (lambda: fn.ordinal(_c("PreRmilk"), rules.MILK),
                        case_map(_t('"PreRmilk"'), rules.MILK, "-1")),
    "f7_group_occupation": (
        lambda: fn.group_occupation(_c("PreRpresentoccupation")),
        'CASE WHEN "PreRpresentoccupation" IS NULL THEN \'Missing\' ELSE '
        + case_map(_t('"PreRpresentoccupation"'), rules.OCCUPATION, "'Other'") + " END"),
    "f8_duration_minutes": (lambda: fn.duration_minutes(_c("PreRmildactivityduration")),
                            _dur_sql('"PreRmildactivityduration"')),
    "f9_code_minutes": (lambda: fn.code_minutes(_c("PreRmildcode")),
                        "coalesce(" + case_map('CAST("PreRmildcode" AS INT)', rules.ACTIVITY_CODE_MINUTES) + ", -1)"),
    "f10_yes_no": (lambda: fn.yes_no(_c("PreRdiafather")), _yes_no_sql('"PreRdiafather"')),
    "f12_split_multi": (
        lambda: F.array_join(fn.split_multi(_c("PreRstaplefood")).cast("array<string>"), "|"),
        "CASE WHEN \"PreRstaplefood\" IS NOT NULL THEN (SELECT coalesce(string_agg(v, '|' ORDER BY p), '') FROM "
        "(SELECT CAST(try_cast(trim(u.x) AS INT) AS VARCHAR) AS v, min(u.i) AS p FROM (SELECT "
        "unnest(string_split(\"PreRstaplefood\", ',')) AS x, "
        "generate_subscripts(string_split(\"PreRstaplefood\", ','), 1) AS i) u "
        "WHERE try_cast(trim(u.x) AS INT) IS NOT NULL GROUP BY 1)) END"),
    "f13_decode": (lambda: decode(_c("PreRmaritalcode"), "marital"),
                   case_map('CAST("PreRmaritalcode" AS INT)', rules.CODEBOOK["marital"], "'—'")),
    "f17_signed": (lambda: fn.signed(_delta()), f"CASE WHEN {_DELTA} IS NULL THEN NULL ELSE {_SIGNED} END"),
    "f18_null_tokens": (lambda: fn.null_tokens(_c("PreRdiafather")),
                        'CASE WHEN lower("PreRdiafather") NOT IN (\'nan\', \'none\', \'\') THEN "PreRdiafather" END'),
    "m1_bmi": (lambda: F.round(fn.bmi(_c("PreRheight"), _c("PreRweight")), 6), f"round({_BMI}, 6)"),
    "m2_bounded_ratio": (
        lambda: F.round(fn.bounded_ratio(_c("PreRwaist"), _c("PreRhip")), 6),
        'round(CASE WHEN "PreRwaist" > 0 AND "PreRhip" > 0 AND "PreRwaist" / nullif("PreRhip", 0) > 0.3 AND '
        '"PreRwaist" / nullif("PreRhip", 0) < 3 THEN "PreRwaist" / "PreRhip" END, 6)'),
    "m3_row_max": (lambda: fn.row_max(_c("PreRsystolicfirst"), _c("PreRsystolicsecond")),
                   'greatest("PreRsystolicfirst", "PreRsystolicsecond")'),
    "m4_duration": (lambda: fn.duration(_c("PreBLAge"), _c("PreRdiaage")), _DURATION),
    "m5_duration_status": (lambda: fn.duration_status(fn.duration(_c("PreBLAge"), _c("PreRdiaage"))),
                           f"CASE WHEN {_DURATION} > 0.6 THEN 'known diabetes' ELSE 'newly diagnosed' END"),
    "m6_duration_by_codebook": (
        lambda: fn.duration_by_codebook(_c("PreBLAge"), _c("PreRdiaage") - 12),
        'CASE WHEN "PreRdiaage" IS NULL THEN 0 WHEN "PreRdiaage" - 12 <= 10 THEN "PreRdiaage" - 12 '
        'WHEN "PreRdiaage" - 12 > 1900 THEN 2013 - ("PreRdiaage" - 12) ELSE "PreBLAge" - ("PreRdiaage" - 12) END'),
    "m7_activity_score": (lambda: F.round(_score(), 6), f"round({_SCORE_SQL}, 6)"),
    "m8_activity_optimal": (lambda: fn.activity_optimal(_score()),
                            f"CASE WHEN {_SCORE_SQL} >= 1100 THEN 'Yes' ELSE 'No' END"),
    "m9_smoking_flag": (
        lambda: fn.any_flag([_c("PreRtobuse"), _c("PreRtobdaily")], [_c("PreRtobaverage")]),
        f"greatest({_yes_no_sql(chr(34) + 'PreRtobuse' + chr(34))}, {_yes_no_sql(chr(34) + 'PreRtobdaily' + chr(34))}, "
        'CASE WHEN "PreRtobaverage" IS NOT NULL THEN 1 END)'),
    "m9_alcohol_flag_zero": (
        lambda: fn.any_flag([_c("PreRalcoholuse")], [_c("PreRlastmonthavg")], legacy_zero=True),
        f"greatest({_yes_no_sql(chr(34) + 'PreRalcoholuse' + chr(34))}, "
        'CASE WHEN "PreRlastmonthavg" IS NOT NULL THEN 1 ELSE 0 END)'),
    "m10_stress_band": (
        lambda: fn.stress_band(_c("PreRstworkvalue")),
        "CASE WHEN \"PreRstworkvalue\" <= 2 THEN 'No to Mild Stress' WHEN \"PreRstworkvalue\" <= 5 THEN "
        "'Moderate Stress' WHEN \"PreRstworkvalue\" <= 8 THEN 'High Stress' WHEN \"PreRstworkvalue\" <= 10 "
        "THEN 'Severe Stress' END"),
    "m11_risk_band": (
        lambda: F.concat_ws(" / ", fn.risk_band(_c("PreBLHBA1C")), fn.risk_confidence(_c("PreBLHBA1C"))),
        f"CASE WHEN {_PRE} < 5.7 THEN 'NORMAL / High Confidence' WHEN {_PRE} < 6.5 THEN "
        f"'PRE_DIABETIC / Moderate Confidence' WHEN {_PRE} < 8.0 THEN 'DIABETIC / Moderate Confidence' "
        "ELSE 'HIGH_RISK / High Confidence' END"),
    "m12_glycaemic_category": (lambda: fn.glycaemic_category(_c("PostBLHBA1C")), _CATEGORY.format(_POST)),
    "m13_trajectory": (
        lambda: fn.trajectory(_c("PreBLHBA1C"), _c("PostBLHBA1C")),
        f"CASE WHEN {_RANK.format(_POST)} < {_RANK.format(_PRE)} THEN 'Regression' WHEN {_RANK.format(_POST)} = "
        f"{_RANK.format(_PRE)} THEN 'Persistence' WHEN {_RANK.format(_POST)} > {_RANK.format(_PRE)} THEN 'Progression' END"),
    "m14_response_class": (
        lambda: fn.response_class(_c("PreBLHBA1C"), _delta()),
        f"CASE WHEN {_PRE} <= 6.4 THEN NULL WHEN {_DELTA} >= 1.0 THEN {text(rules.RESPONSE_CLASSES[0][1])} "
        f"WHEN {_DELTA} >= 0.5 THEN {text(rules.RESPONSE_CLASSES[1][1])} WHEN {_DELTA} >= 0 THEN "
        f"{text(rules.RESPONSE_CLASSES[2][1])} WHEN {_DELTA} IS NOT NULL THEN {text(rules.RESPONSE_CLASSES[3][1])} END"),
    "m15_target_attainment": (
        lambda: fn.target_attainment(_c("PreBLHBA1C"), _c("PostBLHBA1C"), F.coalesce(_c("PreBLAge"), F.lit(50.0))),
        f"CASE WHEN {_PRE} > 7.0 AND {_POST} IS NOT NULL THEN CASE "
        + "".join(
            f"WHEN {a}({_PRE} <= (CASE WHEN coalesce({_AGE}, 50) < 65 THEN 7.0 ELSE 7.5 END)) AND "
            f"{b}({_POST} <= (CASE WHEN coalesce({_AGE}, 50) < 65 THEN 7.0 ELSE 7.5 END)) THEN '{label}' "
            for a, b, label in (("", "", "At target"), ("", "NOT ", "Above target"),
                                ("NOT ", "", "Achieved target"), ("NOT ", "NOT ", "Not achieved")))
        + "END END"),
    "m16_improvement_pct": (
        lambda: fn.improvement_pct(_c("PreBLHBA1C"), _c("PreBLHBA1C") - _c("PostBLHBA1C")),
        f"CASE WHEN {_PRE} > 0 THEN round(({_PRE} - {_POST}) / {_PRE} * 100, 2) ELSE 0 END"),
    "m17_class_index": (
        lambda: fn.class_index((_c("PreRstworkvalue") - 2) / 2, 4),
        'CAST(greatest(least(round_even(("PreRstworkvalue" - 2) / 2, 0), 3), 0) AS INT)'),
    "m18_interaction": (
        lambda: F.round(fn.interaction(_c("PostRgroupname") == 1, (_c("PreBLFBS") - 290) / 130), 6),
        'round(CAST("PostRgroupname" = 1 AS INT) * (("PreBLFBS" - 290) / 130), 6)'),
    "m19_gauge": (lambda: F.round(fn.gauge(_c("PreBLHBA1C") + 1), 6),
                  f"round(least(({_PRE} + 1 - 3) / 13 * 100, 100), 6)"),
    "p7_clamp_to_null": (lambda: fn.clamp_to_null(_c("PreBLAge"), 20, 80),
                         f"CASE WHEN {_AGE} > 20 AND {_AGE} < 80 THEN {_AGE} END"),
    "s8_to_number": (lambda: _c("PreRBMItext").try_cast("double"), 'try_cast("PreRBMItext" AS DOUBLE)'),
}


def _register(name, spark_expr, sql_expr):
    @query(name, f"WITH survey AS ({SURVEY_SQL}) SELECT id, {sql_expr} AS result FROM survey")
    def run(spark, sf_dir):
        return survey(spark, sf_dir).select("id", spark_expr().alias("result"))


for _name, (_expr, _sql) in SCALARS.items():
    _register(_name, _expr, _sql)


_ENCODING = {"F": {"Male": 1, "Female": 0, "Transgender": 2}, "O": {"Male": 1, "Female": 0}}


@query("f11_encode_by_source", f"""WITH survey AS ({SURVEY_SQL}), named AS (
  SELECT id, source, {SCALARS['f2_normalize_category'][1]} AS label FROM survey)
  SELECT id, CASE WHEN source = 'F' THEN CASE label WHEN 'Male' THEN '1' WHEN 'Female' THEN '0'
      WHEN 'Transgender' THEN '2' END
    WHEN source = 'O' THEN CASE label WHEN 'Male' THEN '1' WHEN 'Female' THEN '0' END
    ELSE label END AS result FROM named""")
def encode_by_source(spark, sf_dir):
    """Codes by kind of source; the third source has no map and keeps its labels."""
    df = survey(spark, sf_dir)
    label = fn.normalize_category(F.col("PreRgender"))
    return df.select("id", fn.encode_label(label, F.col("source"), _ENCODING).alias("result"))


@query("f14_readable_name", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  l_extendedprice, CASE l_returnflag WHEN 'A' THEN 'Age' WHEN 'N' THEN 'Sleep quality'
  ELSE 'Unknown Marker' END AS result FROM lineitem""")
def readable(spark, sf_dir):
    flag = F.col("l_returnflag")
    feature = (F.when(flag == "A", "PostBLAge").when(flag == "N", F.concat(F.lit("PreRsleepquality_"), F.lit("2.0")))
               .otherwise("unknown_marker"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        fn.readable_name(feature).alias("result"))


@query("f15_interpretation", """SELECT event_id, concat_ws(' ', 'Marker ' || event_type,
  CASE WHEN abs((value - 50) / 200) > 0.3 THEN 'significantly' WHEN abs((value - 50) / 200) > 0.1 THEN 'moderately'
    ELSE 'slightly' END, CASE WHEN (value - 50) / 200 > 0 THEN 'increases' ELSE 'decreases' END,
  'predicted HbA1c') AS result FROM events""")
def interpreted(spark, sf_dir):
    impact = (F.col("value") - 50) / 200
    return table(spark, sf_dir, "events").select(
        "event_id", fn.interpretation(F.concat(F.lit("Marker "), "event_type"), impact).alias("result"))
