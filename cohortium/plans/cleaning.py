"""Raw answer sheets to analysis columns, for a frame or for whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import rules
from ..operators.columns import keep_columns
from ..operators.fill import fill_chained, fill_report
from ..operators.frequency import group_rare
from ..operators.ranking import enrich
from ..session import stage
from ..sources import read_many, suffixed, to_number, write_table

_PAIRS = {"systolic": ("systolicfirst", "systolicsecond"), "diastolic": ("diastolicfirst", "diastolicsecond")}


def clean_survey(df: DataFrame, rare_threshold: float = 0.01, legacy: bool = False) -> DataFrame:
    """All cleaners whose columns exist. Which exist is read from the schema once, while the plan is built.

    Source columns keep their names where a cleaner replaces them; derived columns are added beside
    them. Apart from the one frequency count of the marital status, every step is narrow.
    """
    have = set(df.columns)
    out = {}

    def put(name, maker, *needs):
        if set(needs) <= have:
            out[name] = maker(*[F.col(c) for c in needs])
    put("PreRgender", fn.normalize_category, "PreRgender")
    put("PreRarea", fn.map_area, "PreRarea")
    put("PreRmaritalstatus", fn.correct_labels, "PreRmaritalstatus")
    put("PreReducation_ord", lambda c: fn.ordinal(c, rules.EDUCATION), "PreReducation")
    put("PreRpresentoccupation_grp", fn.group_occupation, "PreRpresentoccupation")
    put("PreRsleepquality_ord", lambda c: fn.ordinal(c, rules.SLEEP), "PreRsleepquality")
    for c in rules.DIET_COLUMNS:
        put(f"{c}_ord", lambda x: fn.ordinal(x, rules.DIET), c)
    put("PreRmilk_ord", lambda c: fn.ordinal(c, rules.MILK), "PreRmilk")
    put("PreRBMI", fn.bmi, "PreRheight", "PreRweight")
    put("PreWaisttoHipRatio", fn.bounded_ratio, "PreRwaist", "PreRhip")

    # the pair of the first visit, else that of the second
    for name, parts in _PAIRS.items():
        for visit in ("PreR", "PostR"):
            pair = [visit + p for p in parts]
            if set(pair) <= have:
                put(name, fn.row_max, *pair)
                break
    years = F.lit(0.0)
    for visit in ("Pre", "Post"):
        age, onset = f"{visit}BLAge", f"{visit}Rdiaage"
        if {age, onset} <= have:
            years = fn.duration(F.col(age), F.col(onset))
            out["postblage"] = F.col(age)
            break
    out["Diabetic_Duration(years)"] = years
    out["Duration_Status"] = fn.duration_status(years)

    flags = lambda names: [F.col(c) for c in names if c in have]
    out["current_smoking"] = fn.any_flag(flags(rules.SMOKING_YES_NO), flags(rules.SMOKING_COUNTS), legacy, legacy)
    out["current_alcohol"] = fn.any_flag(flags(rules.ALCOHOL_YES_NO), flags(rules.ALCOHOL_COUNTS), legacy, legacy)
    for c in [*rules.FAMILY_YES_NO, *rules.SMOKING_YES_NO, *rules.ALCOHOL_YES_NO]:
        put(c, lambda x: fn.yes_no(x, legacy), c)

    minutes = {k: fn.duration_minutes(F.col(c)) for k, c in rules.ACTIVITY_COLUMNS.items() if c in have}
    for k, c in rules.ACTIVITY_COLUMNS.items():
        if c in have:
            out[f"{c}_mins"] = minutes[k]
    score = fn.activity_score(minutes) if minutes else F.lit(0.0)
    out["Physical activity_total_METSCORE_value"] = score
    out["PhysicalActivity_Optimal"] = fn.activity_optimal(score)
    cleaned = df.withColumns(out)
    return group_rare(cleaned, "PreRmaritalstatus", rare_threshold) if "PreRmaritalstatus" in have else cleaned


def encode_sources(df: DataFrame, source: str, codes: dict = rules.SOURCE_CODES) -> DataFrame:
    """Codes instead of labels where the source has a map: {column: {pattern: {label: code}}}."""
    return df.withColumns({c: fn.encode_label(F.col(c), F.lit(source), maps)
                           for c, maps in codes.items() if c in df.columns})


NUMBERS = ["PreRheight", "PreRweight", "PreRwaist", "PreRhip", "PreBLAge", "PostBLAge", "PreRdiaage", "PostRdiaage",
           "PreBLPPBS", "PreBLFBS", "PreBLHBA1C", "PostBLHBA1C", "PreBLCHOLESTEROL", "PreBLTRIGLYCERIDES",
           *[v + p for v in ("PreR", "PostR") for pair in _PAIRS.values() for p in pair]]


def with_row_key(df: DataFrame, key: str = "row_key") -> DataFrame:
    """A key for rows that have none. It is written once, so later jobs all see the same key.

    Keys follow the order of a hash of the content, so that rows compare alike however the files are split; only equal rows
    can change places.
    """
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    hashed = df.withColumn("_content", F.xxhash64(content))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = hashed.repartitionByRange(parts, "_content").sortWithinPartitions("_content").drop("_content")
    return stage(placed.withColumn(key, F.monotonically_increasing_id()), "keyed")


def prepare_files(spark: SparkSession, paths: dict[str, str], folder: str, keep: list[str] | None = None,
                  suffix: str = "_selected_columns_cleaned", overwrite: bool = False, fill_targets: bool = True,
                  top: float = 0.5, features: list[str] | None = None, codes: dict = rules.SOURCE_CODES,
                  trees: int = 50, fmt: str = "parquet") -> tuple[dict[str, str], dict[str, str]]:
    """Read, clean, fill the target columns from the best features, encode, select, write.

    ``paths`` maps a source name to its files. Returns ({source: written path}, {source: why skipped}).
    """
    frames, skipped = read_many(spark, paths)
    written = {}
    for name, raw in frames.items():
        df = clean_survey(to_number(raw, NUMBERS))
        if fill_targets:
            df = with_row_key(df)
            pool = features or [c for c in NUMBERS if c in df.columns]
            targets = [t for t in rules.ENRICH_TARGETS if t in df.columns]
            df = enrich(df, targets, "row_key", top, trees=trees, features=[c for c in pool if c not in targets])
            df = df.drop("row_key")
        df = encode_sources(df, name, codes)
        if keep:
            df = keep_columns(df, keep)
        written[name] = write_table(df, suffixed(paths[name], suffix, folder), overwrite, fmt)
    return written, skipped


def complete_files(spark: SparkSession, paths: dict[str, str], folder: str, numeric: list[str],
                   categorical: list[str] = (), rounds: int = 10, learner: str = "forest") -> DataFrame:
    """Chained fill of each prepared source, written beside it; returns the fill report."""
    reports = []
    method = f"chained equations, {learner}"
    for name, path in paths.items():
        before = spark.read.parquet(path)
        cols = [c for c in numeric if c in before.columns]
        texts = [c for c in categorical if c in before.columns]
        before = to_number(before, cols)
        done = write_table(fill_chained(before, cols, rounds, learner, texts),
                           suffixed(path, "_final_imputed", folder), overwrite=True)
        after = spark.read.parquet(done)
        tag = lambda df: df.withColumn("source", F.lit(name))
        reports.append(fill_report(tag(before), tag(after), "source", method, [*cols, *texts], len(texts))
                       .where("source <> 'ALL'"))
    merged = reports[0]
    for r in reports[1:]:
        merged = merged.unionByName(r)
    return merged
