"""Scoring of records as they arrive. Stateless: the batch functions are used unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import Scorer, clinical_lines, score
from ..operators.validation import with_violations


def scored(stream: DataFrame, rules: list[tuple], scorer: Scorer, pre: str, age: str) -> DataFrame:
    """Valid records with score, band and report lines; failing ones keep their reasons and get no score."""
    checked = with_violations(stream, rules)
    done = clinical_lines(score(checked, scorer), pre, "score", age)
    ok = F.size("violations") == 0
    made = [c for c in done.columns if c not in checked.columns]
    return done.withColumns({c: F.when(ok, F.col(c)) for c in made}).withColumn("valid", ok)


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Appends to valid=true / valid=false folders. The checkpoint makes the file sink exactly-once."""
    writer = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
              .partitionBy("valid").outputMode("append"))
    return (writer.trigger(availableNow=True) if once else writer).start()
