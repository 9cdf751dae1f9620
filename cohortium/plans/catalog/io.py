"""Sources, sinks, the cleaning run and the stream. Files are written from the given tables, then read back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ... import sources as so
from ...operators import models as md
from ...operators import scoring as sc
from ...operators.columns import union_all
from ...operators.evaluate import regression_metrics
from ...operators.transform import fit_preprocessor
from ...session import fresh_path
from ...streaming import scoring_stream
from .. import cleaning
from ..explaining import explain_models
from ..survey import PLANTED_SQL, SURVEY_SQL, planted, r6, survey, table
from .registry import query
from .scalars import SCALARS


# each source with columns of its own: another order, one too few, one too many
_LAYOUT = {"F": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
           "O": ["o_totalprice", "o_orderpriority", "o_orderkey"],
           "P": ["o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"]}
_ORDER = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _by_status(spark, sf_dir, fmt="csv"):
    """Orders in one folder per status."""
    root = fresh_path(spark, "orders")
    df = table(spark, sf_dir, "orders")
    for s, columns in _LAYOUT.items():
        so.write_table(df.where(F.col("o_orderstatus") == s).select(columns), f"{root}/{s}", overwrite=True, fmt=fmt)
    return root


@query("s1_csv_many_files", "SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus "
       "END AS status, o_orderstatus AS source FROM orders")
def many_files(spark, sf_dir):
    """Three sources are read, a fourth does not exist and is skipped."""
    root = _by_status(spark, sf_dir)
    frames, skipped = so.read_many(spark, {s: f"{root}/{s}" for s in ("F", "O", "P", "X")}, _ORDER)
    if list(skipped) != ["X"]:
        raise ValueError(f"skipped {skipped}")
    return union_all(frames).select("o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_orderstatus").alias("status"), "source")


@query("s2_path_fallback", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def fallback(spark, sf_dir):
    root = _by_status(spark, sf_dir, "parquet")
    path = so.first_existing(spark, [f"{root}/O_final_imputed", f"{root}/O", f"{root}/F"])
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice")


@query("s3_directory_scan", "SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS custkey, "
       "true AS tagged FROM orders")
def directory(spark, sf_dir):
    """Every CSV file below a folder, whatever its columns, tagged with its file name."""
    df = so.read_csv(spark, _by_status(spark, sf_dir), f"{_ORDER}, o_custkey bigint", glob="*.csv", tag="file", recursive=True)
    return df.select("o_orderkey", "o_totalprice", "o_orderpriority", F.col("o_custkey").alias("custkey"),
                     F.col("file").endswith(".csv").alias("tagged"))


@query("s9_sink_keeps_existing", "SELECT s_suppkey, s_name, 'first' AS version FROM supplier")
def sink(spark, sf_dir):
    """The second write finds the target and leaves it."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = so.suffixed(f"{fresh_path(spark, 'sink')}/suppliers.csv", "_cleaned")
    so.write_table(df.withColumn("version", F.lit("first")), path)
    so.write_table(df.withColumn("version", F.lit("second")), path)
    return spark.read.parquet(path)


@query("s10_metrics_export", f"""SELECT source, count(*) AS n, round(avg(abs(y - 2 * a)), 6) AS mae FROM ({PLANTED_SQL}) GROUP BY 1""")
def metrics_export(spark, sf_dir):
    """Metrics written partitioned by data set and read back."""
    df = planted(spark, sf_dir).withColumn("yhat", 2 * F.col("a"))
    path = fresh_path(spark, "metrics")
    so.write_table(regression_metrics(df, "y", "yhat", ["source"]), path, partition_by=["source"])
    return r6(spark.read.parquet(path).select("source", "n", "mae"), "mae")


@query("s11_metadata_export", "SELECT r.model, c.name AS \"column\", (SELECT count(*) FROM orders) AS rows FROM (VALUES ('line')) r(model), "
       "(VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) c(name)")
def metadata(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    path = so.write_metadata(spark, fresh_path(spark, "metadata"), df.columns, "line")
    listed = spark.read.schema("columns array<string>, model string").json(path)
    rows = df.agg(F.count(F.lit(1))).scalar()
    return listed.select("model", F.explode("columns").alias("column"), rows.alias("rows"))


@query("s12_model_round_trip", f"SELECT id, true AS same FROM ({PLANTED_SQL})")
def model_round_trip(spark, sf_dir):
    """A saved preprocessor and model score every row as before."""
    df = planted(spark, sf_dir)
    made = fit_preprocessor(df, ["a", "b"], ["segment"], [("segment", "b", "group_x_b")])
    model = md.boosted(trees=3, rate=0.5, label="y").fit(made.transform(df))
    path = fresh_path(spark, "model")
    so.save_model(PipelineModel([made, model]), path)
    before = sc.model_scorer(made, model)(df).withColumnRenamed("prediction", "before")
    after = so.load_pipeline(path).transform(before)
    return after.select("id", (F.col("before") == F.col("prediction")).alias("same"))


_CLEANED = {
    "PreRgender": "f2_normalize_category", "PreRarea": "f3_map_area", "PreReducation_ord": "f6_education_ordinal",
    "PreRpresentoccupation_grp": "f7_group_occupation", "PreRsleepquality_ord": "f6_sleep_ordinal",
    "PreRskipbreakfast_ord": "f6_diet_ordinal", "PreRmilk_ord": "f6_milk_ordinal", "PreRBMI": "m1_bmi",
    "PreWaisttoHipRatio": "m2_bounded_ratio", "systolic": "m3_row_max", "Diabetic_Duration(years)": "m4_duration",
    "Duration_Status": "m5_duration_status", "PreRdiafather": "f10_yes_no",
    "current_smoking": "m9_smoking_flag", "PreRmildactivityduration_mins": "f8_duration_minutes",
    "Physical activity_total_METSCORE_value": "m7_activity_score", "PhysicalActivity_Optimal": "m8_activity_optimal",
}


@query("clean_survey", f"WITH survey AS ({SURVEY_SQL}), c AS (SELECT id, {SCALARS['f4_correct_labels'][1]} AS marital, "
       + ", ".join(f'{SCALARS[s][1]} AS "{c}"' for c, s in _CLEANED.items())
       + " FROM survey), f AS (SELECT marital, count(*) * 1.0 / (SELECT count(*) FROM c) AS share FROM c GROUP BY 1) "
       "SELECT id, CASE WHEN share < 0.08 THEN 'Other' ELSE marital END AS \"PreRmaritalstatus\", "
       + ", ".join(f'"{c}"' for c in _CLEANED) + " FROM c JOIN f USING (marital)")
def clean(spark, sf_dir):
    """All cleaners in one plan, with rare marital answers grouped."""
    out = cleaning.clean_survey(survey(spark, sf_dir), rare_threshold=0.08)
    out = out.select("id", "PreRmaritalstatus", *[f"`{c}`" for c in _CLEANED])
    return r6(out, "PreRBMI", "PreWaisttoHipRatio", "Physical activity_total_METSCORE_value")


@query("prepare_and_complete_files", f"""WITH survey AS ({SURVEY_SQL}), p AS (SELECT source,
  ("PreBLFBS" IS NULL)::INT + ("PreRwaist" IS NULL)::INT AS holes FROM survey)
  SELECT source, sum(holes)::BIGINT AS original_missing, 0::BIGINT AS final_missing, CAST(100 AS DOUBLE) AS completion, 1 AS categorical
  FROM p GROUP BY 1""")
def prepare_files(spark, sf_dir):
    """CSV files cleaned, selected and written, then filled by chained equations; the report of the fill."""
    root = fresh_path(spark, "raw")
    df = survey(spark, sf_dir)
    for s in ("F", "O", "P"):
        so.write_table(df.where(F.col("source") == s), f"{root}/{s}.csv", overwrite=True, fmt="csv")
    keep = ["PreBLFBS", "PreRwaist", "PreBLHBA1C", "PreRgender", "PreRarea", "not_there"]
    written, _ = cleaning.prepare_files(spark, {s: f"{root}/{s}.csv" for s in ("F", "O", "P")}, f"{root}/prepared",
                                        keep=keep, overwrite=True, fill_targets=False)
    report = cleaning.complete_files(spark, written, f"{root}/final", keep[:3], ["PreRgender"], rounds=2, learner="ridge")
    return report.drop("method")


@query("explain_model_batch", f"""SELECT model, count(*) AS records, 2 AS features, round(avg(y), 6) AS expected_value
  FROM ({PLANTED_SQL}), (VALUES ('forest'), ('boosted')) m(model) GROUP BY 1""")
def explain_batch(spark, sf_dir):
    """Two models explained and exported; one summary line each. Trees fitted to all rows expect the mean."""
    df = planted(spark, sf_dir).withColumn("features", md.as_vector(["a", "b"])).withColumn("label", F.col("y"))
    runs = {name: (df, model.fit(df), ["a", "b"]) for name, model in (
        ("forest", md.forest(trees=1, depth=3).setBootstrap(False)), ("boosted", md.boosted(trees=3, depth=3, rate=0.5)))}
    return r6(explain_models(runs, fresh_path(spark, "explained"), "id", top=2), "expected_value")


_STREAM_RULES = [("value", True, 1, 400), ("event_type", True, None, None)]


@query("r1_scoring_stream", """WITH p AS (SELECT event_id, value BETWEEN 1 AND 400 AS valid,
  round(CAST(4.1370127 AS DOUBLE) + CAST(0.0231907713 AS DOUBLE) * value, 2) AS score FROM events)
  SELECT event_id, valid, CASE WHEN valid THEN score END AS score, CASE WHEN valid THEN CASE WHEN score < 5.7 THEN
  'Normoglycemia' WHEN score <= 6.4 THEN 'Prediabetes' ELSE 'Diabetes' END END AS post_category FROM p""")
def stream(spark, sf_dir):
    """Events read as a file stream, validated, scored and appended to a sink; the sink's content."""
    schema = table(spark, sf_dir, "events").schema
    arriving = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
                .withColumn("age", F.lit(50.0)))
    scored = scoring_stream.scored(arriving, _STREAM_RULES, sc.linear_scorer({"value": 0.0231907713}, 4.1370127),
                                   "value", "age")
    path = fresh_path(spark, "scores")
    running = scoring_stream.start(scored.select("event_id", "valid", "score", "post_category"), path,
                                   fresh_path(spark, "offsets"), once=True)
    running.awaitTermination()
    written = "event_id bigint, score double, post_category string, valid boolean"
    return spark.read.schema(written).parquet(path).select("event_id", "valid", "score", "post_category")
