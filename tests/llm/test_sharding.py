"""Cells of a number and what they are worth for skipping files."""

from pyspark.sql import functions as F

from cohortium.llm import sharding


def test_cells_are_ranges_of_equal_counts(spark):
    df = spark.range(0, 2_000_000, 500).select((F.col("id") * F.col("id")).alias("n"))
    cell = sharding.quantised_ranges(df, "n", 4)
    met = df.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows"), F.min("n").alias("lo"), F.max("n").alias("hi")).orderBy("cell").collect()
    assert [r["cell"] for r in met] == list(range(16))
    assert all(abs(r["rows"] - 250) <= 10 for r in met)
    assert all(a["hi"] < b["lo"] for a, b in zip(met, met[1:]))
    odd = spark.createDataFrame([(None,), (7,), (7,), (7,), (9,)], "n long")
    assert sorted(r[0] for r in odd.select(sharding.quantised_ranges(odd, "n", 2)).collect())[0] == 0
    empty = odd.limit(0)
    assert empty.select(sharding.quantised_ranges(empty, "n", 2)).collect() == []


def test_shards_bound_the_id_whatever_its_size(spark):
    """A range of ids far above 2**18 opens few shards; languages are bounded beside it."""
    df = spark.range(8000).select((F.col("id") * 700).alias("doc_id"), F.format_string("l%d", F.col("id") % 4).alias("lang"))
    cells = [sharding.quantised_text("lang"), sharding.quantised_ranges(df, "doc_id")]
    placed = sharding.hilbert_shards(df, 40, cells, carry=["lang"]).cache()
    shards = placed.groupBy("shard").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).collect()
    assert len(shards) == 40 and {r["n"] for r in shards} == {200}
    whole = 7999 * 700
    opened = [sum(r["lo"] <= at <= r["hi"] for r in shards) for at in range(0, whole, whole // 50)]
    assert sum(opened) / len(opened) < 10
    placed.unpersist()
