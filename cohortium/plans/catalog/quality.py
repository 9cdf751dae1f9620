"""Null reports, profiles, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import quality as q
from ..survey import GAPS_SQL, SURVEY_SQL, gaps, r6, spread, survey, table
from .registry import query

_COLS = ["o_totalprice", "o_custkey", "o_orderpriority"]


def _null_sql(source: str, group: bool) -> str:
    return " UNION ALL ".join(
        f"SELECT {source} AS source, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, "
        f"(count(*) - count({c})) * 100.0 / count(*) > 30 AS flagged FROM g" + (" GROUP BY 1" if group else "")
        for c in _COLS)


_REPORT = f"WITH g AS ({GAPS_SQL}), report AS ({_null_sql('o_orderstatus', True)} UNION ALL {_null_sql(chr(39) + 'ALL' + chr(39), False)})"


@query("a1_null_report", f"{_REPORT} SELECT * REPLACE (null_pct::DOUBLE AS null_pct) FROM report")
def null_report(spark, sf_dir):
    report = r6(q.null_report(gaps(spark, sf_dir), _COLS, by="o_orderstatus"), "null_pct")
    return report.orderBy(F.desc("null_pct"), "column", "source")


@query("a2_high_missing", f"{_REPORT} SELECT source, \"column\", null_pct::DOUBLE AS null_pct FROM report WHERE flagged")
def high_missing(spark, sf_dir):
    report = r6(q.null_report(gaps(spark, sf_dir), _COLS, by="o_orderstatus"), "null_pct")
    return report.where("flagged").select("source", "column", "null_pct")


@query("a3_combined_report", f"""WITH g AS ({GAPS_SQL}), u AS (
  SELECT o_totalprice AS balance, o_orderpriority AS grade FROM g UNION ALL
  SELECT c_acctbal, NULL FROM customer) SELECT c AS "column", n AS rows, nulls,
  round(nulls * 100.0 / n, 6)::DOUBLE AS null_pct FROM (
    SELECT 'balance' AS c, count(*) AS n, count(*) - count(balance) AS nulls FROM u UNION ALL
    SELECT 'grade', count(*), count(*) - count(grade) FROM u)""")
def combined(spark, sf_dir):
    """Only frames with a watched column take part; absent columns count as null."""
    frames = {
        "orders": gaps(spark, sf_dir).withColumnsRenamed({"o_totalprice": "balance", "o_orderpriority": "grade"}),
        "customers": table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "balance"),
        "nations": table(spark, sf_dir, "nation")}
    report = q.monitored_report(frames, ["balance", "grade", "never_seen"])
    return r6(report.where("source = 'ALL'"), "null_pct").select("column", "rows", "nulls", "null_pct")


@query("a4_missing_total", f"""WITH g AS ({GAPS_SQL}), t AS (SELECT o_orderstatus AS source,
  sum((o_totalprice IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderpriority IS NULL)::INT)::BIGINT AS before_fill,
  sum((o_custkey IS NULL)::INT + (o_orderpriority IS NULL)::INT)::BIGINT AS after_fill FROM g GROUP BY 1)
  SELECT *, round(CASE WHEN before_fill > 0 THEN (before_fill - after_fill) * 100.0 / before_fill ELSE 100 END, 6)::DOUBLE
  AS completion FROM t""")
def missing_total(spark, sf_dir):
    df = gaps(spark, sf_dir)
    before = q.missing_total(df, _COLS, by="o_orderstatus").withColumnRenamed("missing", "before_fill")
    after = q.missing_total(df.fillna({"o_totalprice": 0.0}), _COLS, by="o_orderstatus").withColumnRenamed(
        "missing", "after_fill")
    both = before.join(after, "source")
    return r6(both.withColumn("completion", q.completion(F.col("before_fill"), F.col("after_fill"))), "completion")


def _profile_sql(frame: str, cols: dict, source: str) -> str:
    parts = []
    for c, kind in cols.items():
        n = kind != "string"
        num = lambda f: f"{f}" if n else "NULL::DOUBLE"
        parts.append(
            f"SELECT {source} AS source, '{c}' AS \"column\", '{kind}' AS type, count(*) AS rows, "
            f"count(*) - count(\"{c}\") AS missing, round((count(*) - count(\"{c}\")) * 100.0 / count(*), 4)::DOUBLE AS missing_pct, "
            f"count(DISTINCT \"{c}\") AS \"unique\", {num(f'min({chr(34)}{c}{chr(34)})::DOUBLE')} AS min, "
            f"{num(f'max({chr(34)}{c}{chr(34)})::DOUBLE')} AS max, "
            f"{num(f'round(max({chr(34)}{c}{chr(34)}) - min({chr(34)}{c}{chr(34)}), 4)::DOUBLE')} AS range, "
            f"{num(f'round(avg({chr(34)}{c}{chr(34)}), 4)')} AS mean, {num(f'round(median({chr(34)}{c}{chr(34)}), 4)::DOUBLE')} AS median "
            f"FROM {frame} GROUP BY 1")
    return " UNION ALL ".join(parts)


_PROFILED = {"o_totalprice": "double", "o_custkey": "bigint", "o_orderpriority": "string"}


@query("a5_profile", f"WITH g AS ({GAPS_SQL}), p AS ({_profile_sql('g', _PROFILED, 'o_orderstatus')}) "
       "SELECT p.*, CASE WHEN \"column\" = 'o_orderpriority' THEN "
       "'1-URGENT|2-HIGH|3-MEDIUM|4-NOT SPECIFIED|5-LOW' END AS \"values\" FROM p")
def profile(spark, sf_dir):
    out = q.profile(gaps(spark, sf_dir), list(_PROFILED), by="o_orderstatus")
    return r6(out, "missing_pct", "range", "mean", "median", places=4).withColumn("values", F.array_join("values", "|"))


_LINES = {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
          "l_linenumber": "int", "l_returnflag": "string"}


@query("a5_profile_lineitem", f"WITH p AS ({_profile_sql('lineitem', _LINES, chr(39) + 'ALL' + chr(39))}) SELECT * FROM p")
def profile_lines(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "lineitem").select(*_LINES))
    out = q.profile(lines, list(_LINES)).drop("values")
    return r6(out, "missing_pct", "range", "mean", "median", places=4)


@query("a5_profile_sketch", "SELECT '" + "' AS \"column\", count(*) AS rows, 0::BIGINT AS missing FROM lineitem UNION ALL SELECT '".join(_LINES)
       + "' AS \"column\", count(*) AS rows, 0::BIGINT AS missing FROM lineitem")
def profile_sketch(spark, sf_dir):
    """The single-pass form; its approximate columns are left out of the comparison."""
    return q.profile(table(spark, sf_dir, "lineitem"), list(_LINES), exact=False).select("column", "rows", "missing")


@query("a6_target_summary", f"""WITH g AS ({GAPS_SQL}) SELECT o_orderstatus, count(o_totalprice) AS count,
  count(*) - count(o_totalprice) AS missing, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std,
  min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS q25,
  round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75
  FROM g GROUP BY 1""")
def target_summary(spark, sf_dir):
    out = q.target_summary(gaps(spark, sf_dir), "o_totalprice", by=["o_orderstatus"])
    return r6(out, "mean", "std", "q25", "q50", "q75", places=4)


_DETAIL = {"PreRsleepquality": "string", "PreRstworkvalue": "double", "PreRarea": "string"}


@query("a7_column_detail", f"WITH survey AS ({SURVEY_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) - count(\"{c}\") AS missing, count(DISTINCT \"{c}\") AS \"unique\", "
    f"(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT \"{c}\" AS v FROM survey WHERE \"{c}\" "
    f"IS NOT NULL ORDER BY v LIMIT 5)) AS samples FROM survey" for c, t in _DETAIL.items()))
def column_detail(spark, sf_dir):
    return q.column_detail(survey(spark, sf_dir), list(_DETAIL))


def _cell(c: str, s: str, kind: str) -> str:
    if kind == "few":
        return (f"(SELECT 'Values: [' || string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) || (CASE WHEN (SELECT count(*) - count(\"{c}\") FROM survey "
                f"WHERE source = '{s}') > 0 THEN ', NaN' ELSE '' END) || ']' FROM (SELECT DISTINCT \"{c}\" AS v "
                f"FROM survey WHERE source = '{s}' AND \"{c}\" IS NOT NULL))")
    if kind == "range":
        return (f"(SELECT printf('Range: %.1f - %.1f', min(\"{c}\"), max(\"{c}\")) FROM survey WHERE source = '{s}')")
    return f"(SELECT count(DISTINCT \"{c}\") || ' unique values' FROM survey WHERE source = '{s}')"


_VERIFIED = {"PostRgroupname": "few", "PreRstworkvalue": "few", "PreBLFBS": "range", "PostBLHBA1C": "range",
             "PreRmaritalstatus": "few", "label": "many"}


@query("a8_cross_verify", f"WITH survey AS (SELECT *, 'L' || CAST(\"PreBLFBS\" AS INT) AS label FROM ({SURVEY_SQL})) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(f"{_cell(c, s, k)} AS \"{s}\"" for s in "FOP") for c, k in _VERIFIED.items()))
def cross_verify(spark, sf_dir):
    df = survey(spark, sf_dir).withColumn("label", F.concat(F.lit("L"), F.col("PreBLFBS").cast("int").cast("string")))
    return q.cross_verify(df, "source", ["F", "O", "P"], list(_VERIFIED))


@query("j2_reference_columns", f"WITH g AS ({GAPS_SQL}) SELECT 'o_custkey' AS \"column\", count(*) - count(o_custkey) AS nulls "
       "FROM g UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority) FROM g")
def reference_columns(spark, sf_dir):
    """Only columns that a second data set also names."""
    other = q.null_report(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"))
    return q.for_reference_columns(q.null_report(gaps(spark, sf_dir), _COLS), other).select("column", "nulls")


@query("j3_compare_reports", f"""WITH g AS ({GAPS_SQL}), b AS (
  SELECT 'o_totalprice' AS c, avg((o_totalprice IS NULL)::INT) * 100 AS p FROM g UNION ALL
  SELECT 'o_custkey', avg((o_custkey IS NULL)::INT) * 100 FROM g UNION ALL
  SELECT 'o_orderpriority', avg((o_orderpriority IS NULL)::INT) * 100 FROM g), a AS (
  SELECT 'o_totalprice' AS c, CAST(0 AS DOUBLE) AS p UNION ALL
  SELECT 'o_custkey', avg((o_custkey IS NULL)::INT) * 100 FROM g UNION ALL SELECT 'o_year', 0)
  SELECT coalesce(b.c, a.c) AS "column", CASE WHEN b.p IS NULL THEN '-' ELSE printf('%.2f', b.p) END AS "before",
  CASE WHEN a.p IS NULL THEN '-' ELSE printf('%.2f', a.p) END AS "after" FROM b FULL JOIN a ON b.c = a.c""")
def compare_reports(spark, sf_dir):
    df = gaps(spark, sf_dir)
    after = df.fillna({"o_totalprice": 0.0}).withColumn("o_year", F.lit(1))
    return q.compare_reports(q.null_report(df, _COLS),
                             q.null_report(after, ["o_totalprice", "o_custkey", "o_year"]))
