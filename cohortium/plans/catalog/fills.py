"""Fills, neighbours and the fill tournament."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import fill as fl
from ...operators import tournament as tm
from ...operators.frequency import category_index, restore_labels
from ...operators.neighbours import NeighbourRegressor, fill_knn, fill_knn_category, nearest_donors
from ...operators.ranking import enrich
from ...operators.transform import add_split, standardise
from ..survey import GAPS_SQL, PLANTED_SQL, SURVEY_SQL, bucket_sql, gaps, planted, r6, split_sql, survey, table
from .registry import query


def _simple(strategy: str, value_sql: str):
    @query(f"i1_fill_{strategy}", f"""WITH g AS ({GAPS_SQL}) SELECT o_orderkey,
      round(coalesce(o_totalprice, {value_sql}), 4) AS o_totalprice FROM g""")
    def run(spark, sf_dir):
        _, filled = fl.fill(gaps(spark, sf_dir), ["o_totalprice"], strategy)
        return r6(filled.select("o_orderkey", "o_totalprice"), "o_totalprice", places=4)


_simple("mean", "(SELECT avg(o_totalprice) FROM g)")
_simple("median", "(SELECT median(o_totalprice) FROM g)")
_simple("constant", "0")


@query("i1_fill_mode", f"""WITH g AS ({GAPS_SQL}) SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority
  FROM g WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM g""")
def fill_mode(spark, sf_dir):
    return fl.fill(gaps(spark, sf_dir), ["o_orderpriority"], "mode")[1].select("o_orderkey", "o_orderpriority")


_HOLES = """SELECT p_partkey, CASE WHEN p_partkey * 7 % 11 <> 3 THEN p_retailprice END AS price,
  CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 13 <> 5 THEN CAST(p_partkey * 37 % 101 AS DOUBLE) END AS score,
  CASE WHEN p_partkey * 5 % 7 <> 2 THEN p_type END AS kind FROM part"""


def _holes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k, F.when(F.pmod(k * 7, F.lit(11)) != 3, F.col("p_retailprice")).alias("price"),
        F.col("p_size").cast("double").alias("size"),
        F.when(F.pmod(k, F.lit(13)) != 5, F.pmod(k * 37, F.lit(101)).cast("double")).alias("score"),
        F.when(F.pmod(k * 5, F.lit(7)) != 2, F.col("p_type")).alias("kind"))


def _square(x: str, y: str) -> str:
    return f"coalesce(({x} - {y}) * ({x} - {y}), 0)"


def _distance(pairs: list[tuple[str, str]]) -> str:
    """Missing-aware squared distance over shared features; null when nothing is shared."""
    shared = " + ".join(f"(({x} - {y}) IS NOT NULL)::INT" for x, y in pairs)
    total = " + ".join(_square(x, y) for x, y in pairs)
    return f"({total}) * (CAST({len(pairs)} AS DOUBLE) / nullif({shared}, 0))"


def _knn_sql(frame: str, key: str, target: str, features: list[str], k: int, condition: str = "") -> str:
    """(key, mean of the k nearest) for the rows of ``frame`` that miss the target."""
    d = _distance([(f"r.{f}", f"d.{f}") for f in features])
    return f"""SELECT rk AS {key}, list_aggregate([x.v FOR x IN best], 'avg') AS guess FROM (
      SELECT rk, min({{'d': dist, 'k': dk, 'v': v}}, {k}) AS best FROM (
        SELECT r.{key} AS rk, d.{key} AS dk, d.{target} AS v, {d} AS dist FROM {frame} r, {frame} d
        WHERE r.{target} IS NULL AND d.{target} IS NOT NULL {condition}) WHERE dist IS NOT NULL GROUP BY rk)"""


@query("i3_fill_knn", f"""WITH h AS ({_HOLES}), n AS ({_knn_sql('h', 'p_partkey', 'price', ['size', 'score'], 5)})
  SELECT p_partkey, round(coalesce(price, guess), 6) AS price FROM h LEFT JOIN n USING (p_partkey)""")
def knn(spark, sf_dir):
    filled = fill_knn(_holes(spark, sf_dir), "price", ["size", "score"], "p_partkey")
    return r6(filled.select("p_partkey", "price"), "price")


@query("i3_fill_knn_category", f"""WITH h AS ({_HOLES}), labels AS (
  SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS idx FROM (SELECT DISTINCT kind FROM h WHERE kind IS NOT NULL)),
  w AS (SELECT h.*, CAST(idx AS DOUBLE) AS idx FROM h LEFT JOIN labels USING (kind)),
  n AS ({_knn_sql('w', 'p_partkey', 'idx', ['size', 'score'], 5)})
  SELECT p_partkey, coalesce(w.kind, labels.kind) AS kind FROM w LEFT JOIN n USING (p_partkey)
  LEFT JOIN labels ON labels.idx = CAST(round_even(n.guess, 0) AS INT)""")
def knn_category(spark, sf_dir):
    return fill_knn_category(_holes(spark, sf_dir), "kind", ["size", "score"], "p_partkey").select("p_partkey", "kind")


@query("j5_nearest_donors", f"""WITH h AS ({_HOLES}) SELECT rk AS p_partkey, i AS place, best[i].k AS donor FROM (
  SELECT rk, min({{'d': dist, 'k': dk}}, 3) AS best FROM (SELECT r.p_partkey AS rk, d.p_partkey AS dk,
    {_distance([('r.size', 'd.size'), ('r.score', 'd.score')])} AS dist FROM h r, h d
    WHERE r.price IS NULL AND d.price IS NOT NULL) WHERE dist IS NOT NULL GROUP BY rk), unnest([1, 2, 3]) t(i)""")
def donors(spark, sf_dir):
    df = _holes(spark, sf_dir)
    found = nearest_donors(df.where("price IS NULL"), df.where("price IS NOT NULL"), "p_partkey", "price",
                           ["size", "score"], k=3)
    return found.select("p_partkey", F.posexplode("nearest").alias("place", "n")).select(
        "p_partkey", (F.col("place") + 1).alias("place"), F.col("n.donor").alias("donor"))


@query("t6_knn_regression", f"""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a,
  CAST(p_partkey * 37 % 101 AS DOUBLE) AS b, p_retailprice AS y, {split_sql('p_partkey')} AS split FROM part),
  m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM p WHERE split = 'train'),
  z AS (SELECT p_partkey, round((a - ma) / sa, 9) AS za, round((b - mb) / sb, 9) AS zb, y, split FROM p, m),
  h AS (SELECT *, CASE WHEN split = 'train' THEN y END AS t FROM z),
  n AS ({_knn_sql('h', 'p_partkey', 't', ['za', 'zb'], 7)})
  SELECT p_partkey, round(guess, 6) AS prediction FROM n""")
def knn_regression(spark, sf_dir):
    """Seven nearest training rows on standardised features, for the held-out rows."""
    k = F.col("p_partkey")
    df = add_split(table(spark, sf_dir, "part").select(
        k, F.col("p_size").cast("double").alias("a"), F.pmod(k * 37, F.lit(101)).cast("double").alias("b"),
        F.col("p_retailprice").alias("y")), "p_partkey", hashed=False)
    moments, _ = standardise(df.where("split = 'train'"), ["a", "b"])
    z = df.withColumns({f"z{c}": F.round((F.col(c) - F.lit(m)) / F.lit(s), 9) for c, (m, s) in moments.items()})
    model = NeighbourRegressor(["za", "zb"], "y", "p_partkey", k=7).fit(z.where("split = 'train'"))
    return r6(model.transform(z.where("split = 'test'")).select("p_partkey", "prediction"), "prediction")


# tournament on parts: two columns with a relation, hidden cells by key arithmetic
_M1, _M2 = bucket_sql("p_partkey", 1, 10), bucket_sql("p_partkey", 2, 10)
_MASKED = f"""SELECT p_partkey, CAST(p_size AS DOUBLE) AS t1, p_retailprice AS t2,
  CASE WHEN {_M1} <> 0 THEN CAST(p_size AS DOUBLE) END AS c1, CASE WHEN {_M2} <> 0 THEN p_retailprice END AS c2 FROM part"""


def _scored(name: str, ordinal: int, first: str, second: str, frame: str = "m") -> str:
    return (f"SELECT '{name}' AS strategy, {ordinal} AS ordinal, (count(*) FILTER (WHERE c1 IS NULL) + count(*) FILTER "
            f"(WHERE c2 IS NULL))::BIGINT AS cells, round(sqrt((coalesce(sum(power(t1 - {first}, 2)) FILTER (WHERE c1 IS NULL), 0) + "
            f"coalesce(sum(power(t2 - {second}, 2)) FILTER (WHERE c2 IS NULL), 0)) / (count(*) FILTER (WHERE c1 IS NULL) + "
            f"count(*) FILTER (WHERE c2 IS NULL))), 4) AS rmse FROM {frame}")


def _chained_sql(frame: str, name: str, rounds: int) -> str:
    """Queries up to ``name``: columns c1 and c2 of ``frame`` filled in turn by lines over each other, as g1 and g2.

    The column with fewer gaps is first; both orders are computed, and the gaps decide which one counts.
    """
    out = []
    for first, second in ((1, 2), (2, 1)):
        at = f"{name}_{first}"
        out.append(f"{at}_0 AS (SELECT *, coalesce(c1, (SELECT avg(c1) FROM {frame})) AS g1, coalesce(c2, (SELECT avg(c2) FROM {frame})) AS g2 FROM {frame})")
        step = 0
        for _ in range(rounds):
            for y, x in ((first, second), (second, first)):
                line = f"(SELECT regr_slope(c{y}, g{x}) AS s, regr_intercept(c{y}, g{x}) AS i FROM {at}_{step})"
                out.append(f"{at}_{step + 1} AS (SELECT {at}_{step}.* REPLACE (coalesce(c{y}, i + s * g{x}) AS g{y}) FROM {at}_{step}, {line})")
                step += 1
    gaps = f"(SELECT count(c1) >= count(c2) FROM {frame})"
    out.append(f"{name} AS (SELECT * FROM {name}_1_{step} WHERE {gaps} UNION ALL SELECT * FROM {name}_2_{step} WHERE NOT {gaps})")
    return ", ".join(out)


_SCORES = f"""WITH m AS ({_MASKED}), {_chained_sql('m', 'chained', 1)},
  n1 AS ({_knn_sql('m', 'p_partkey', 'c1', ['c2'], 5)}), n2 AS ({_knn_sql('m', 'p_partkey', 'c2', ['c1'], 5)}),
  k AS (SELECT m.*, n1.guess AS g1, n2.guess AS g2 FROM m LEFT JOIN n1 USING (p_partkey) LEFT JOIN n2 USING (p_partkey)),
  scores AS (
  {_scored('mean', 0, '(SELECT avg(c1) FROM m)', '(SELECT avg(c2) FROM m)')} UNION ALL
  {_scored('median', 1, '(SELECT median(c1) FROM m)', '(SELECT median(c2) FROM m)')} UNION ALL
  {_scored('knn', 2, 'coalesce(g1, (SELECT avg(c1) FROM m))', 'coalesce(g2, (SELECT avg(c2) FROM m))', 'k')} UNION ALL
  {_scored('chained', 3, 'g1', 'g2', 'chained')} UNION ALL
  {_scored('zero', 4, '0', '0')})"""


def _scores(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    return tm.score_strategies(df, ["size", "price"], "p_partkey", rounds=1, learner="ridge")


@query("i2_fill_tournament", f"{_SCORES} SELECT * FROM scores")
def tournament(spark, sf_dir):
    return r6(_scores(spark, sf_dir), "rmse", places=4)


@query("w7_tournament_winner", f"{_SCORES} SELECT strategy, rmse FROM scores ORDER BY rmse, ordinal LIMIT 1")
def winner(spark, sf_dir):
    return r6(tm.winner(_scores(spark, sf_dir)), "rmse", places=4)


@query("a15_masked_rmse", f"""WITH m AS (SELECT id, a, b, CASE WHEN {bucket_sql('id', 1, 10)} <> 0 THEN a END AS c1,
  CASE WHEN {bucket_sql('id', 2, 10)} <> 0 THEN b END AS c2 FROM ({PLANTED_SQL}))
  SELECT (count(*) FILTER (WHERE c1 IS NULL) + count(*) FILTER (WHERE c2 IS NULL))::BIGINT AS cells,
  round(sqrt((sum(power(a - (SELECT avg(c1) FROM m), 2)) FILTER (WHERE c1 IS NULL) + sum(power(b - (SELECT avg(c2) FROM m), 2))
  FILTER (WHERE c2 IS NULL)) / (count(*) FILTER (WHERE c1 IS NULL) + count(*) FILTER (WHERE c2 IS NULL))), 6) AS rmse FROM m""")
def masked_rmse(spark, sf_dir):
    masked = tm.mask_cells(planted(spark, sf_dir), ["a", "b"], "id")
    filled = tm.fill_with(masked, ["a", "b"], "id", "mean")
    return r6(tm.masked_rmse(filled, masked, ["a", "b"], "id", 10, False), "rmse")


_HOLED = f"""SELECT p_partkey, CAST(p_size AS DOUBLE) AS t1, p_retailprice AS t2, CASE WHEN {_M1} <> 0 THEN CAST(p_size AS DOUBLE) END AS c1,
  CASE WHEN {_M2} <> 0 THEN p_retailprice END AS c2 FROM part WHERE p_partkey % 9 <> 2 AND p_partkey % 8 <> 3"""


def _holed(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k, F.when(F.pmod(k, F.lit(9)) != 2, F.col("p_size")).cast("double").alias("size"),
        F.when(F.pmod(k, F.lit(8)) != 3, F.col("p_retailprice")).alias("price"))


@query("i2_full_tournament", f"""WITH m AS ({_HOLED}), {_chained_sql('m', 'chained', 1)}, s AS (
  {_scored('mean', 0, '(SELECT avg(c1) FROM m)', '(SELECT avg(c2) FROM m)')} UNION ALL
  {_scored('median', 1, '(SELECT median(c1) FROM m)', '(SELECT median(c2) FROM m)')} UNION ALL
  {_scored('chained', 2, 'g1', 'g2', 'chained')} UNION ALL {_scored('zero', 3, '0', '0')})
  SELECT *, 0::BIGINT AS nulls_left, (SELECT count(*) FROM part) AS rows_kept FROM s""")
def full_tournament(spark, sf_dir):
    """Strategies scored on the complete rows, the winner fitted on the whole table.

    Without knn, by lines and in one round; ``i2_full_tournament_knn`` has all strategies, ``i2_full_tournament_forest`` the forest.
    """
    df = _holed(spark, sf_dir)
    scores, filled = tm.fill_tournament(df, ["size", "price"], "p_partkey", ("mean", "median", "chained", "zero"), rounds=1,
                                        learner="ridge", hashed=False)
    left = filled.agg(F.count_if(F.col("size").isNull() | F.col("price").isNull()).alias("nulls_left"), F.count(F.lit(1)).alias("rows_kept")).first()
    return r6(scores.select("strategy", "ordinal", "cells", "rmse", F.lit(left[0]).cast("bigint").alias("nulls_left"),
                            F.lit(left[1]).cast("bigint").alias("rows_kept")), "rmse", places=4)


@query("i2_full_tournament_knn", f"""WITH m AS ({_HOLED}), {_chained_sql('m', 'chained', 1)},
  n1 AS ({_knn_sql('m', 'p_partkey', 'c1', ['c2'], 5)}), n2 AS ({_knn_sql('m', 'p_partkey', 'c2', ['c1'], 5)}),
  k AS (SELECT m.*, n1.guess AS g1, n2.guess AS g2 FROM m LEFT JOIN n1 USING (p_partkey) LEFT JOIN n2 USING (p_partkey)), s AS (
  {_scored('mean', 0, '(SELECT avg(c1) FROM m)', '(SELECT avg(c2) FROM m)')} UNION ALL
  {_scored('median', 1, '(SELECT median(c1) FROM m)', '(SELECT median(c2) FROM m)')} UNION ALL
  {_scored('knn', 2, 'coalesce(g1, (SELECT avg(c1) FROM m))', 'coalesce(g2, (SELECT avg(c2) FROM m))', 'k')} UNION ALL
  {_scored('chained', 3, 'g1', 'g2', 'chained')} UNION ALL {_scored('zero', 4, '0', '0')})
  SELECT *, 0::BIGINT AS nulls_left, (SELECT count(*) FROM part) AS rows_kept FROM s""")
def full_tournament_knn(spark, sf_dir):
    """All five strategies scored on the complete rows, the winner fitted on the whole table."""
    scores, filled = tm.fill_tournament(_holed(spark, sf_dir), ["size", "price"], "p_partkey", rounds=1, learner="ridge", hashed=False)
    left = filled.agg(F.count_if(F.col("size").isNull() | F.col("price").isNull()).alias("nulls_left"), F.count(F.lit(1)).alias("rows_kept")).first()
    return r6(scores.select("strategy", "ordinal", "cells", "rmse", F.lit(left[0]).cast("bigint").alias("nulls_left"),
                            F.lit(left[1]).cast("bigint").alias("rows_kept")), "rmse", places=4)


@query("i2_full_tournament_forest", f"""WITH m AS ({_HOLED}), n AS (SELECT (count(*) FILTER (WHERE c1 IS NULL) +
  count(*) FILTER (WHERE c2 IS NULL))::BIGINT AS cells FROM m)
  SELECT strategy, ordinal, cells, true AS scored, 0::BIGINT AS nulls_left, 0::BIGINT AS observed_changed,
  (SELECT count(*) FROM part) AS rows_kept
  FROM n, (VALUES ('mean', 0), ('median', 1), ('knn', 2), ('chained', 3), ('zero', 4)) t(strategy, ordinal)""")
def full_tournament_forest(spark, sf_dir):
    """The tournament as it is by default, with the forest and its rounds: what must hold for any learner."""
    df = _holed(spark, sf_dir)
    scores, filled = tm.fill_tournament(df, ["size", "price"], "p_partkey", hashed=False)
    both = filled.join(df.select("p_partkey", F.col("size").alias("size0"), F.col("price").alias("price0")), "p_partkey")
    changed = (F.col("size") != F.col("size0")) | (F.col("price") != F.col("price0"))
    left = both.agg(F.count_if(F.col("size").isNull() | F.col("price").isNull()), F.count_if(changed), F.count(F.lit(1))).first()
    return scores.select("strategy", "ordinal", "cells", F.col("rmse").isNotNull().alias("scored"), *(
        F.lit(n).cast("bigint").alias(name) for name, n in zip(("nulls_left", "observed_changed", "rows_kept"), left)))


_LINE = """WITH g AS (SELECT id, b, CASE WHEN id % 10 <> 4 THEN y END AS y FROM (""" + PLANTED_SQL + "))"


@query("i5_fill_chained_linear", f"""{_LINE}, m AS (SELECT regr_slope(y, b) AS s, regr_intercept(y, b) AS i FROM g)
  SELECT id, round(coalesce(y, i + s * b), 6) AS y FROM g, m""")
def chained_linear(spark, sf_dir):
    df = planted(spark, sf_dir).select("id", "b", F.when(F.pmod("id", F.lit(10)) != 4, F.col("y")).alias("y"))
    return r6(fl.fill_chained(df, ["y", "b"], learner="ridge").select("id", "y"), "y")


_TWO = f"""SELECT id, CASE WHEN id % 7 <> 0 THEN y END AS c1, CASE WHEN id % 3 <> 0 THEN a END AS c2 FROM ({PLANTED_SQL})"""


@query("i5_fill_chained_two_columns", f"""WITH m AS ({_TWO}), {_chained_sql('m', 'filled', 2)}
  SELECT id, round(g1, 8) AS y, round(g2, 8) AS a FROM filled""")
def chained_two(spark, sf_dir):
    """Two incomplete columns, each filled from the other, over two rounds."""
    df = planted(spark, sf_dir).select("id", F.when(F.pmod("id", F.lit(7)) != 0, F.col("y")).alias("y"),
                                       F.when(F.pmod("id", F.lit(3)) != 0, F.col("a")).alias("a"))
    return r6(fl.fill_chained(df, ["y", "a"], rounds=2, learner="ridge", tol=0.0), "y", "a", places=8)


@query("i4_fill_chained_forest", f"""WITH g AS (SELECT id, a, b, CASE WHEN id % 10 <> 4 THEN y END AS y,
  CASE WHEN id % 7 <> 1 THEN segment END AS segment FROM ({PLANTED_SQL}))
  SELECT count(*) AS rows, 0::BIGINT AS nulls_left, 0::BIGINT AS observed_changed, count(*) - count(y) AS filled_y,
  count(*) - count(segment) AS filled_segment, 5::BIGINT AS labels FROM g""")
def chained_forest(spark, sf_dir):
    """What must hold for any learner: all rows kept, no gap left, no observed cell changed."""
    df = planted(spark, sf_dir).select(
        "id", "a", "b", F.when(F.pmod("id", F.lit(10)) != 4, F.col("y")).alias("y"),
        F.when(F.pmod("id", F.lit(7)) != 1, F.col("segment")).alias("segment"))
    df = df.withColumns({"y0": F.col("y"), "s0": F.col("segment")})
    out = fl.fill_chained(df, ["a", "b", "y"], rounds=2, categorical=["segment"])
    changed = (F.col("y0") != F.col("y")) | (F.col("s0") != F.col("segment"))
    return out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("y").isNull() | F.col("segment").isNull()).alias("nulls_left"),
        F.count_if(changed).alias("observed_changed"), F.count_if(F.col("y0").isNull()).alias("filled_y"),
        F.count_if(F.col("s0").isNull()).alias("filled_segment"), F.count_distinct("segment").alias("labels"))


@query("i6_category_index", f"""WITH g AS ({GAPS_SQL}) SELECT o_orderkey, CASE WHEN o_orderpriority IS NOT NULL THEN
  CAST(dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST) - 1 AS INT) END AS idx,
  CASE WHEN o_orderpriority IS NOT NULL THEN o_orderpriority END AS restored FROM g""")
def index(spark, sf_dir):
    indexed, labels = category_index(gaps(spark, sf_dir), ["o_orderpriority"])
    named = restore_labels(indexed, F.col("o_orderpriority_idx"), labels, "o_orderpriority", "restored")
    return named.select("o_orderkey", F.col("o_orderpriority_idx").alias("idx"), "restored")


@query("i6_many_labels", """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN CAST(l_orderkey AS VARCHAR) END AS c
  FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN c IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY c NULLS LAST) - 1 AS INT) END AS idx,
  c AS restored FROM l""")
def index_of_many(spark, sf_dir):
    """A column whose labels grow with the table: indexed and restored by joins, none of them on the driver."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_orderkey").cast("string")).alias("c"))
    indexed, labels = category_index(lines, ["c"])
    return restore_labels(indexed, F.col("c_idx"), labels, "c", "restored").select(
        "l_orderkey", "l_linenumber", F.col("c_idx").alias("idx"), "restored")


@query("i7_fill_report", f"""WITH g AS ({GAPS_SQL}), t AS (SELECT o_orderstatus, (o_totalprice IS NULL)::INT + (o_custkey IS NULL)::INT AS b,
  (o_custkey IS NULL)::INT AS a FROM g), s AS (
  SELECT o_orderstatus AS source, sum(b)::BIGINT AS original_missing, sum(a)::BIGINT AS final_missing FROM t GROUP BY 1 UNION ALL
  SELECT 'ALL', sum(b)::BIGINT, sum(a)::BIGINT FROM t) SELECT *, round(CASE WHEN original_missing > 0 THEN
  (original_missing - final_missing) * 100.0 / original_missing ELSE 100 END, 4)::DOUBLE AS completion,
  'mean' AS method, 0 AS categorical FROM s""")
def report(spark, sf_dir):
    df = gaps(spark, sf_dir)
    _, after = fl.fill(df, ["o_totalprice"], "mean")
    return r6(fl.fill_report(df, after, "o_orderstatus", "mean", ["o_totalprice", "o_custkey"]), "completion", places=4)


@query("i8_enrich_targets", f"""WITH survey AS ({SURVEY_SQL}), t AS (
  SELECT greatest("PreRsystolicfirst", "PreRsystolicsecond") AS systolic FROM survey)
  SELECT count(*) AS rows, count(systolic) AS observed, 0::BIGINT AS nulls_left FROM t""")
def enriched(spark, sf_dir):
    """Rank the features, then fill the target from its nearest rows over the best half."""
    df = survey(spark, sf_dir).select(
        "id", F.greatest("PreRsystolicfirst", "PreRsystolicsecond").alias("systolic"), "PreBLFBS", "PreBLAge",
        "PreRwaist", "PreBLCHOLESTEROL")
    out = enrich(df.withColumn("s0", F.col("systolic")), ["systolic"], "id", trees=5, depth=4,
                 features=["PreBLFBS", "PreBLAge", "PreRwaist", "PreBLCHOLESTEROL"])
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count("s0").alias("observed"),
                   F.count_if(F.col("systolic").isNull()).alias("nulls_left"))
