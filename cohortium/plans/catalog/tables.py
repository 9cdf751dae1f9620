"""Column choice, filters, validation, lookups, unions, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import functions as fn
from ... import rules
from ...operators import columns as col
from ...operators import lookup, validation
from ...operators.frequency import group_rare, most_frequent, relative_frequency
from ...sources import conform, normalise_headers, resolve_column
from ...session import fresh_path
from ..survey import (
    ANSWERS, GAPS_SQL, MEASURES, SURVEY_SQL, bucket_sql, case_map, gaps, r6, survey, table, text)
from .registry import query

WANTED = ["o_totalprice", "o_missing", "o_orderkey", "o_orderpriority", "o_comment"]


@query("p1_keep_columns", "SELECT o_totalprice, o_orderkey, o_orderpriority FROM orders")
def keep(spark, sf_dir):
    return col.keep_columns(table(spark, sf_dir, "orders"), WANTED)


@query("p2_missing_columns", "SELECT 'orders' AS source, (SELECT count(*) FROM orders) AS rows, * FROM (VALUES ('o_totalprice', true), ('o_missing', false), "
       "('o_orderkey', true), ('o_orderpriority', true), ('o_comment', false)) t(\"column\", present)")
def missing(spark, sf_dir):
    return col.missing_columns(table(spark, sf_dir, "orders"), WANTED, "orders")


@query("p3_drop_column", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def drop(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_orderstatus", "not_there")


@query("p4_drop_null_target", f"WITH g AS ({GAPS_SQL}) SELECT * FROM g WHERE o_totalprice IS NOT NULL")
def null_target(spark, sf_dir):
    return gaps(spark, sf_dir).dropna(subset=["o_totalprice"])


@query("p5_complete_cases", f"WITH g AS ({GAPS_SQL}) SELECT * FROM g WHERE o_totalprice IS NOT NULL AND "
       "o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL")
def complete(spark, sf_dir):
    return gaps(spark, sf_dir).dropna("any", subset=["o_totalprice", "o_custkey", "o_orderpriority"])


@query("p6_assign_where", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END "
       "AS o_orderstatus FROM orders")
def assign(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return col.assign_where(df, "o_orderstatus", F.col("o_totalprice") > 400000, "X").select(
        "o_orderkey", "o_orderstatus")


@query("p8_row_gate", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 20")
def gate(spark, sf_dir):
    """Counts of the sources that are large enough to train on."""
    df = table(spark, sf_dir, "orders")
    usable = [s for s in ("F", "O", "P", "Q") if col.enough_rows(df.where(F.col("o_orderstatus") == s), 20)]
    return (df.where(F.col("o_orderstatus").isin(usable)).groupBy("o_orderstatus")
            .agg(F.count(F.lit(1)).alias("n")))


V_RULES = [("l_quantity", True, 2, 48), ("l_discount", True, 0.01, None), ("l_tax", True, None, 0.07),
           ("l_shipmode", True, None, None), ("l_extendedprice", False, 2000, 90000)]
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_VIOLATED = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, field, rule FROM (
  SELECT *, 'l_quantity' AS field, 'ge 2' AS rule FROM lineitem WHERE l_quantity < 2
  UNION ALL SELECT *, 'l_quantity', 'le 48' FROM lineitem WHERE l_quantity > 48
  UNION ALL SELECT *, 'l_discount', 'ge 0.01' FROM lineitem WHERE l_discount < 0.01
  UNION ALL SELECT *, 'l_tax', 'le 0.07' FROM lineitem WHERE l_tax > 0.07
  UNION ALL SELECT *, 'l_shipmode', 'required' FROM lineitem
  UNION ALL SELECT *, 'l_extendedprice', 'ge 2000' FROM lineitem WHERE l_extendedprice < 2000
  UNION ALL SELECT *, 'l_extendedprice', 'le 90000' FROM lineitem WHERE l_extendedprice > 90000)"""


@query("v1_validate_records", """SELECT * FROM lineitem WHERE l_quantity BETWEEN 2 AND 48 AND l_discount >= 0.01
  AND l_tax <= 0.07 AND l_extendedprice BETWEEN 2000 AND 90000""")
def valid(spark, sf_dir):
    rules_here = [r for r in V_RULES if r[0] != "l_shipmode"]
    return validation.validate(table(spark, sf_dir, "lineitem"), rules_here)[0]


@query("v1_quarantine", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  (CASE WHEN l_quantity NOT BETWEEN 2 AND 48 THEN 1 ELSE 0 END + CASE WHEN l_discount < 0.01 THEN 1 ELSE 0 END
   + CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END
   + CASE WHEN l_extendedprice NOT BETWEEN 2000 AND 90000 THEN 1 ELSE 0 END) AS reasons
  FROM lineitem WHERE NOT (l_quantity BETWEEN 2 AND 48 AND l_discount >= 0.01 AND l_tax <= 0.07
  AND l_extendedprice BETWEEN 2000 AND 90000)""")
def quarantine(spark, sf_dir):
    rules_here = [r for r in V_RULES if r[0] != "l_shipmode"]
    bad = validation.validate(table(spark, sf_dir, "lineitem"), rules_here)[1]
    return bad.select(*_KEYS, F.size("violations").alias("reasons"))


@query("v1_split_sink", """SELECT ok AS valid, count(*) AS rows, CAST(sum(count(*)) OVER () AS BIGINT) AS observed FROM (SELECT l_quantity BETWEEN 2 AND 48
  AND l_discount >= 0.01 AND l_tax <= 0.07 AND l_extendedprice BETWEEN 2000 AND 90000 AS ok FROM lineitem) GROUP BY ok""")
def split_sink(spark, sf_dir):
    """Both parts written in one pass, each read back from its own folder; the write's own count of rows beside them."""
    lines, path = table(spark, sf_dir, "lineitem"), fresh_path(spark, "validated")
    seen = validation.write_validated(lines, [r for r in V_RULES if r[0] != "l_shipmode"], path)
    parts = validation.read_validated(spark, path, lines)
    counted = [part.agg(F.count(F.lit(1)).alias("rows")).withColumn("valid", F.lit(ok)) for part, ok in zip(parts, (True, False))]
    return counted[0].unionByName(counted[1]).withColumn("observed", F.lit(seen["rows"]).cast("long")).where("rows > 0")


@query("v1_violations_long", _VIOLATED)
def violations(spark, sf_dir):
    return validation.violations_long(table(spark, sf_dir, "lineitem"), V_RULES, _KEYS)


_FORM = [r for r in rules.FORM_RULES if r[0] in (
    "PreRwaist", "PreRsystolicfirst", "PreRdiastolicfirst", "PreBLPPBS", "PreBLFBS", "PreBLHBA1C",
    "PreBLCHOLESTEROL", "PreBLTRIGLYCERIDES")]


@query("v2_form_rules", f"WITH survey AS ({SURVEY_SQL}) " + " UNION ALL ".join(
    f"SELECT id, '{f}' AS field, '{name}' AS rule FROM survey WHERE \"{f}\" {test}"
    for f, _, lo, hi in _FORM
    for name, test in (("required", "IS NULL"), (f"ge {lo:g}", f"< {lo}"), (f"le {hi:g}", f"> {hi}"))))
def form_rules(spark, sf_dir):
    return validation.violations_long(survey(spark, sf_dir), _FORM, ["id"])


def _absent(field: str) -> str:
    if field in MEASURES:
        return f'"{field}" IS NULL'
    return f"coalesce(\"{field}\", '') = ''" if field in ANSWERS else "true"


@query("v2_all_form_rules", f"WITH survey AS ({SURVEY_SQL}) " + " UNION ALL ".join(
    f"SELECT id, '{f}' AS field, '{name}' AS rule FROM survey WHERE {test}"
    for f, _, lo, hi in rules.FORM_RULES
    for name, test in [("required", _absent(f)), *([(f"ge {lo:g}", f"\"{f}\" < {lo}"), (f"le {hi:g}", f"\"{f}\" > {hi}")] if f in MEASURES and lo is not None else [])]))
def all_form_rules(spark, sf_dir):
    """Every rule of the form; a field that the sheets lack is a violation of each."""
    return validation.violations_long(survey(spark, sf_dir), rules.FORM_RULES, ["id"])


@query("v3_parse_records", """SELECT event_id,
  CASE WHEN event_id % 50 = 7 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) END AS k,
  CASE WHEN event_id % 50 = 7 THEN NULL ELSE event_type END AS kind, event_id % 50 = 7 AS bad_record FROM events""")
def parse(spark, sf_dir):
    """Known fields only; every fiftieth record is broken on purpose and is flagged, not lost."""
    df = table(spark, sf_dir, "events")
    body = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "extra": 1, "kind": "'), F.col("event_type"),
                    F.when(F.pmod("event_id", F.lit(50)) == 7, "").otherwise('"}'))
    made = df.select("event_id", body.alias("body"))
    return validation.parse_records(made, "body", {"k": "int", "kind": "string"}).drop("body")


@query("j1_code_lookup", """SELECT s_suppkey, s_name, coalesce(n_name, 'Unknown') AS n_name FROM supplier
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON s_nationkey = n_nationkey""")
def code_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    dimension = nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return lookup.attach(table(spark, sf_dir, "supplier"), dimension, ["s_nationkey"], {"n_name": "Unknown"}).select(
        "s_suppkey", "s_name", "n_name")


_BAND_SQL = "CASE WHEN {0} < 5.7 THEN 'NORMAL' WHEN {0} < 6.5 THEN 'PRE_DIABETIC' WHEN {0} < 8.0 THEN 'DIABETIC' ELSE 'HIGH_RISK' END"


@query("j6_c7_advice", f"WITH survey AS ({SURVEY_SQL}), advice AS (SELECT * FROM (VALUES " + ", ".join(
    f"({text(b)}, {o}, {text(t)}, {text(x)})" for b, o, t, x in rules.advice_rows())
    + ") v(band, ord, title, \"text\")), banded AS (SELECT id, " + _BAND_SQL.format('"PreBLHBA1C"')
    + ' AS band FROM survey) SELECT id, banded.band, ord, title, "text" FROM banded JOIN advice USING (band)')
def advice(spark, sf_dir):
    banded = survey(spark, sf_dir).select("id", fn.risk_band(F.col("PreBLHBA1C")).alias("band"))
    return lookup.advise(banded, "band")


_CUSTOMER = {"c_custkey": "party_key", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance"}
_SUPPLIER = {"s_suppkey": "party_key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}


def _parties(spark, sf_dir):
    return {"customer": conform(table(spark, sf_dir, "customer"), renames=_CUSTOMER),
            "supplier": conform(table(spark, sf_dir, "supplier"), renames=_SUPPLIER)}


_PARTIES_SQL = """SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance,
  {segment} 'customer' AS source FROM customer UNION ALL
  SELECT s_suppkey, s_name, s_nationkey, s_acctbal, {empty} 'supplier' FROM supplier"""


@query("u1_s4_union_all", _PARTIES_SQL.format(segment="c_mktsegment,", empty="NULL,"))
def union_all(spark, sf_dir):
    return col.union_all(_parties(spark, sf_dir))


@query("u2_union_common", _PARTIES_SQL.format(segment="", empty=""))
def union_common(spark, sf_dir):
    return col.union_common(_parties(spark, sf_dir))


@query("s5_normalise_headers", "SELECT c_custkey AS cust_key, c_name AS full_name, c_acctbal AS acct_bal_2 FROM customer")
def headers(spark, sf_dir):
    odd = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" cust--key "), F.col("c_name").alias("full  name*"),
        F.col("c_acctbal").alias("__acct.(bal) 2"))
    return normalise_headers(odd)


@query("s6_rename_columns", "SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, "
       "c_mktsegment FROM customer")
def rename(spark, sf_dir):
    return conform(table(spark, sf_dir, "customer"), renames={**_CUSTOMER, "not_there": "x"})


@query("s7_resolve_column", "SELECT o_orderkey, o_totalprice AS target FROM orders")
def resolve(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "O_TotalPrice_USD")
    return df.select("o_orderkey", F.col(resolve_column(df, "totalprice")).alias("target"))


@query("u3_distinct_rows", "SELECT DISTINCT quality, toxic, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS g FROM labels")
def distinct(spark, sf_dir):
    """Nulls count as equal."""
    group = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.pmod("doc_id", F.lit(7)))
    return table(spark, sf_dir, "labels").select("quality", "toxic", group.alias("g")).dropDuplicates()


@query("u4_combos", """SELECT combo, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders JOIN (VALUES
  ('F', 'F'), ('O', 'O'), ('P', 'P'), ('F + O', 'F'), ('F + O', 'O'), ('F + P', 'F'), ('F + P', 'P'),
  ('O + P', 'O'), ('O + P', 'P'), ('F + O + P', 'F'), ('F + O + P', 'O'), ('F + O + P', 'P')) m(combo, source)
  ON o_orderstatus = source GROUP BY combo""")
def combos(spark, sf_dir):
    long = col.combos(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"])
    return long.groupBy("combo").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("u5_filter_steps", f"""WITH g AS ({GAPS_SQL}), s AS (SELECT count(*) AS n0,
  count(*) FILTER (WHERE o_totalprice IS NOT NULL) AS n1,
  count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL) AS n2,
  count(*) FILTER (WHERE o_totalprice > 1000 AND o_custkey > 100 AND o_totalprice < 300000) AS n3,
  count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL AND o_totalprice < 300000) AS n4 FROM g)
  SELECT 1 AS ordinal, 'target known' AS step, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS dropped FROM s UNION ALL
  SELECT 2, 'customer known', n1, n2, n1 - n2 FROM s UNION ALL
  SELECT 3, 'plausible', n2, n4, n2 - n4 FROM s""")
def accounting(spark, sf_dir):
    return col.filter_steps(gaps(spark, sf_dir), [
        ("target known", F.col("o_totalprice").isNotNull()), ("customer known", F.col("o_custkey").isNotNull()),
        ("plausible", F.col("o_totalprice") < 300000)])


@query("u5_write_filtered", f"""WITH g AS ({GAPS_SQL}), s AS (SELECT count(*) AS n0, count(o_totalprice) AS n1,
  count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL) AS n2 FROM g)
  SELECT 1 AS ordinal, 'target known' AS step, n0 AS rows_before, n1 AS rows_after, n0 - n1 AS dropped, n2 AS written FROM s UNION ALL
  SELECT 2, 'customer known', n1, n2, n1 - n2, n2 FROM s""")
def accounted_write(spark, sf_dir):
    """The filtered rows written, the account observed by that write, and the rows that the written table has."""
    path = fresh_path(spark, "filtered")
    account = col.write_filtered(gaps(spark, sf_dir), [
        ("target known", F.col("o_totalprice").isNotNull()), ("customer known", F.col("o_custkey").isNotNull())], path)
    return account.withColumn("written", F.lit(spark.read.parquet(path).count()))


@query("l1_order_by_metric", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1 ORDER BY mean")
def order_by(spark, sf_dir):
    return (table(spark, sf_dir, "orders").groupBy("o_orderpriority")
            .agg(F.round(F.avg("o_totalprice"), 4).alias("mean")).orderBy("mean"))


@query("l5_cap_rows", f"SELECT event_id, value FROM events ORDER BY {bucket_sql('event_id', 1, 100003)}, event_id LIMIT 500")
def cap(spark, sf_dir):
    """Sampling operator: 500 rows by spread key."""
    return col.cap_rows(table(spark, sf_dir, "events"), "event_id", 500, hashed=False).select("event_id", "value")


@query("l6_head_and_shape", """SELECT r.*, (SELECT count(*) FROM nation) AS total_rows, 3 AS total_columns
  FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5) r""")
def head(spark, sf_dir):
    return col.head_and_shape(table(spark, sf_dir, "nation"), "n_nationkey")


@query("a9_relative_frequency", f"""WITH g AS ({GAPS_SQL}) SELECT coalesce(o_orderpriority, 'Missing') AS o_orderpriority,
  count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY 1""")
def frequency(spark, sf_dir):
    return r6(relative_frequency(gaps(spark, sf_dir), "o_orderpriority"), "share")


@query("f5_group_rare", """WITH f AS (SELECT p_brand, count(*) * 1.0 / (SELECT count(*) FROM part) AS share FROM part
  GROUP BY 1) SELECT p_partkey, CASE WHEN share < 0.04 THEN 'Other' ELSE p_brand END AS p_brand
  FROM part JOIN f USING (p_brand)""")
def rare(spark, sf_dir):
    return group_rare(table(spark, sf_dir, "part"), "p_brand", threshold=0.04).select("p_partkey", "p_brand")


@query("a10_most_frequent", f"WITH g AS ({GAPS_SQL}) " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT o_orderstatus, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM g WHERE {c} "
    f"IS NOT NULL GROUP BY 1, 3 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, value) = 1)"
    for c in ("o_orderpriority", "o_custkey")))
def mode(spark, sf_dir):
    return most_frequent(gaps(spark, sf_dir), ["o_orderpriority", "o_custkey"], by=["o_orderstatus"])


@query("f12_explode_counts", f"""WITH survey AS ({SURVEY_SQL}), parts AS (
  SELECT DISTINCT id, try_cast(trim(x) AS INT) AS code FROM (
    SELECT id, unnest(string_split("PreRstaplefood", ',')) AS x FROM survey WHERE "PreRstaplefood" IS NOT NULL))
  SELECT {case_map('code', rules.CODEBOOK['staple'], "'—'")} AS label, count(*) AS n FROM parts
  WHERE code IS NOT NULL GROUP BY 1""")
def staples(spark, sf_dir):
    codes = survey(spark, sf_dir).select(F.explode(fn.split_multi(F.col("PreRstaplefood"))).alias("code"))
    return codes.groupBy(lookup.decode(F.col("code"), "staple").alias("label")).agg(F.count(F.lit(1)).alias("n"))


_BOOK = [("PreRmaritalcode", "marital"), ("PreRmildcode", "activity_frequency"), ("PostRgroupname", "care_plan"),
         ("PostRgroupname", "sex"), ("PostRgroupname", "residence")]


@query("f13_codebook", f"WITH survey AS ({SURVEY_SQL}) SELECT id, " + ", ".join(
    f'{case_map(f"""CAST("{c}" AS INT)""", rules.CODEBOOK[b], "chr(8212)")} AS {b}' for c, b in _BOOK) + " FROM survey")
def codebook(spark, sf_dir):
    return survey(spark, sf_dir).select("id", *[lookup.decode(F.col(c), b).alias(b) for c, b in _BOOK])
