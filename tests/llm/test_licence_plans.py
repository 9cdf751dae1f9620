"""The fitted licence model is small tables; no plan of a scan carries their values or the fit's lineage."""

from cohortium.llm import licenses


def test_plan_of_a_scan_does_not_hold_the_model(spark):
    df = spark.createDataFrame([(i, f"plain line number {i} of the corpus") for i in range(40)] + [
        (40, "Licensed under the Apache License, Version 2.0."), (41, None)], "doc_id long, text string")
    model = licenses.fit(df)
    for table in (model.weights, model.templates):
        assert len(table._jdf.queryExecution().toString()) < 5000
    assert [(r["doc_id"], r["family"]) for r in licenses.licence_scan(df, model).collect()] == [(40, "Apache-2.0")]
