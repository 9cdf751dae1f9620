"""Labels by range partitions, joint counts by partition, bounded one-hot."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortium.operators import frequency, ranking, transform


@pytest.mark.parametrize("limit", [0, 200_000])
def test_index_and_back_by_join(spark, monkeypatch, limit):
    """Also without a broadcast; two columns, nulls, empty texts, a label of most rows, a column without values."""
    monkeypatch.setattr(frequency, "BROADCAST_LABELS", limit)
    rng = np.random.default_rng(2)
    a = [None if u < 0.1 else "hot" if u < 0.7 else f"v{int(u * 1e4)}" for u in rng.random(3000)]
    b = [["", "B", "b", "\u00e4", None][i] for i in rng.integers(0, 5, 3000)]
    df = spark.createDataFrame(list(zip(range(3000), a, b, [None] * 3000)), "id int, a string, b string, none string")
    out, labels = frequency.category_index(df, ["a", "b", "none"])
    for c in "ab":
        out = frequency.restore_labels(out, F.col(c + "_idx") + 0.3, labels, c, c + "_back")
    got = out.orderBy("id").toPandas()
    assert list(got["id"]) == list(range(3000))
    for c, values in (("a", a), ("b", b)):
        order = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
        assert labels.sizes[c] == len(order)
        assert [None if pd.isna(i) else int(i) for i in got[c + "_idx"]] == [None if v is None else order[v] for v in values]
        assert [None if pd.isna(v) else v for v in got[c + "_back"]] == values
    assert got["none_idx"].isna().all()


def test_half_a_million_labels(spark):
    df = spark.range(500_000).select("id", F.format_string("k%07d", F.col("id") * 7919 % 500_009).alias("c"))
    out, labels = frequency.category_index(df, ["c"])
    assert labels.sizes == {"c": 500_000}
    least = out.agg(F.min("c_idx"), F.max("c_idx"), F.count_distinct("c_idx")).first()
    assert tuple(least) == (0, 499_999, 500_000)
    # the order of the labels is that of their indexes
    falls = out.select((F.col("c") > F.lag("c").over(Window.orderBy("c_idx"))).alias("up"))
    assert falls.where("NOT up").count() == 0


def test_one_hot_is_for_a_bounded_list(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="c"):
        transform.fit_preprocessor(df, ["x"], ["c"], max_labels=50)


def test_information_of_numbers_and_texts(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x, y = rng.integers(0, 5, n).astype(float), rng.normal(size=n)
    y = y + x
    t = np.array([["NA", "u", "v"][i] for i in rng.integers(0, 3, n)], object)
    x[rng.random(n) < 0.2] = np.nan
    t[rng.random(n) < 0.2] = None
    df = spark.createDataFrame([(None if np.isnan(a) else float(a), float(b), c) for a, b, c in zip(x, y, t)], "x double, y double, t string")
    got = {(r["target"], r["feature"]): r["mi"] for r in ranking.mutual_information(df, ["x", "t", "y"], ["y", "t"], bins=4).collect()}
    assert set(got) == {("y", "x"), ("y", "t"), ("t", "x"), ("t", "y")}
    label = ranking.bin_columns(df, ["x", "y", "t"], 4)
    binned = df.select(*[label[c].alias(c) for c in "xyt"]).toPandas()
    for (target, feature), mi in got.items():
        p = pd.crosstab(binned[feature], binned[target]).to_numpy() / n
        q = p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)
        assert mi == pytest.approx((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum(), abs=1e-9)
    empty = ranking.mutual_information(df.limit(0), ["x"], ["y"])
    assert empty.count() == 0
