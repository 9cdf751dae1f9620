"""Scores, clinical reading, what-if, sweeps and the record narrative."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from .. import rules

Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(coefficients: dict[str, float], intercept: float) -> Scorer:
    """Scorer of a fixed line over plain columns."""
    def score(df: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for c, b in coefficients.items():
            total = total + F.lit(float(b)) * F.col(c)
        return df.withColumn("prediction", total)
    return score


def model_scorer(preprocessor, model) -> Scorer:
    """Scorer of a fitted preprocessor and model; working columns do not leave it."""
    def score(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != "prediction"]
        return model.transform(preprocessor.transform(df.select(*keep))).select(*keep, "prediction")
    return score


def score(df: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """Prediction at two places, with risk band and confidence."""
    scored = scorer(df)
    rounded = F.round("prediction", 2)
    return (scored.withColumn(name, rounded).withColumn("risk_band", fn.risk_band(F.col("prediction")))
            .withColumn("confidence", fn.risk_confidence(F.col("prediction"))).drop("prediction"))


def clinical_lines(df: DataFrame, pre: str, post: str, age: str) -> DataFrame:
    """Adds delta, categories, trajectory, response, target and the three report lines."""
    before, after, years = F.col(pre), F.col(post), F.col(age)
    delta = F.round(before - after, 2)
    return df.withColumns({
        "delta": delta,
        "pre_category": fn.glycaemic_category(before),
        "post_category": fn.glycaemic_category(after),
        "trajectory": fn.trajectory(before, after),
        "response": fn.response_class(before, delta),
        "attainment": fn.target_attainment(before, after, years),
        "outcome_line": fn.outcome_line(before, after),
        "response_line": fn.response_line(before, delta),
        "target_line": fn.target_line(before, after, years),
    })


def _scenario_array(scenarios: list[tuple]) -> Column:
    """The scenarios that apply to a record, as an array: the table is a literal, so nothing is joined."""
    items = [F.when(F.col(field) == old, F.struct(
        F.lit(i).alias("scenario_id"), F.lit(field).alias("field"), F.lit(float(new)).alias("new_value"),
        F.lit(title).alias("title"), F.lit(text).alias("description"), F.lit(a).alias("original_value"),
        F.lit(b).alias("suggested_value"))) for i, field, old, new, title, text, a, b in scenarios]
    return F.filter(F.array(*items), lambda s: s.isNotNull())


def _changed(df: DataFrame, fields: list[str], change: Callable[[str], Column]) -> DataFrame:
    return df.withColumns({f: change(f).cast(df.schema[f].dataType) for f in fields})


def what_if(df: DataFrame, scorer: Scorer, scenarios: list[tuple] = rules.SCENARIOS) -> DataFrame:
    """One row per record and applicable scenario, rescored: original, modified, delta, improvement."""
    fields = sorted({s[1] for s in scenarios})
    base = scorer(df).withColumn("original", F.round("prediction", 2)).drop("prediction")
    each = base.withColumn("_s", F.explode(_scenario_array(scenarios)))
    moved = _changed(each, fields, lambda f: F.when(F.col("_s.field") == f, F.col("_s.new_value")).otherwise(F.col(f)))
    scored = scorer(moved).withColumn("modified", F.round("prediction", 2)).drop("prediction")
    gain = F.col("original") - F.col("modified")
    return (scored.withColumn("delta", F.round(gain, 2))
            .withColumn("improvement_pct", fn.improvement_pct(F.col("original"), gain))
            .select("*", "_s.*").drop("_s"))


def best_scenario(scenarios: DataFrame, key: list[str], intervention: str = "PostRgroupname") -> DataFrame:
    """Per record: an intervention first, then the largest improvement, then the first scenario."""
    first = F.col("field") == intervention
    order = F.struct(F.when(first, 0).otherwise(1).alias("a"),
                     F.when(first, 0.0).otherwise(-F.col("delta")).alias("b"), F.col("scenario_id").alias("c"))
    picked = F.struct("scenario_id", "field", "title", "original", "modified", "delta", "improvement_pct")
    return scenarios.groupBy(*key).agg(F.min_by(picked, order).alias("b")).select(*key, "b.*")


def combined(df: DataFrame, scorer: Scorer, scenarios: list[tuple] = rules.SCENARIOS) -> DataFrame:
    """Records with two or more applicable scenarios, rescored with all changes at once."""
    fields = sorted({s[1] for s in scenarios})
    base = scorer(df).withColumn("original", F.round("prediction", 2)).drop("prediction")
    met = base.withColumn("_s", _scenario_array(scenarios)).where(F.size("_s") >= 2)

    def last_change(f):
        mine = F.filter("_s", lambda s: s["field"] == f)
        return F.coalesce(F.try_element_at(mine, F.lit(-1))["new_value"], F.col(f).cast("double"))
    scored = scorer(_changed(met, fields, last_change).withColumn("changes", F.size("_s")).drop("_s"))
    return (scored.withColumn("combined", F.round("prediction", 2)).drop("prediction")
            .withColumn("combined_band", fn.risk_band(F.col("combined"))))


def sweep(df: DataFrame, scorer: Scorer, grid: dict[str, list]) -> DataFrame:
    """Every record scored at every grid point, with the change from its own score and the gauge position."""
    out = scorer(df).withColumn("baseline", F.round("prediction", 2)).drop("prediction")
    for field, values in grid.items():
        out = out.withColumn(field, F.explode(F.array(*[F.lit(v) for v in values])))
    scored = scorer(out).withColumn("simulated", F.round("prediction", 2)).drop("prediction")
    return (scored.withColumn("change", F.round(F.col("simulated") - F.col("baseline"), 2))
            .withColumn("gauge", fn.gauge(F.col("simulated"))))


def _shown(df: DataFrame, c: str, how: str, extra: str) -> Column:
    """Text of one narrative value; a column that is absent or null has a stand-in."""
    present = c in df.columns
    if how == "yes":
        return F.when(F.col(c).cast("double") != 0, "Yes").otherwise("No") if present else F.lit("No")
    stand_in = F.lit("?" if how == "score" else "N/A")
    if how == "code":
        label = fn.lookup(F.col(c).cast("int"), rules.CODEBOOK[extra]) if present else stand_in
        return F.coalesce(label, stand_in)
    return F.concat(F.coalesce(F.col(c).cast("string"), stand_in) if present else stand_in, F.lit(extra))


def narrative(df: DataFrame, name: str = "narrative") -> DataFrame:
    """Multi-section text of one record: profile, score, factors and scenarios.

    Reads ``score``, ``risk_band``, ``confidence``, ``top`` (factors) and ``scenarios`` (array of
    title, original, modified, delta, description), ``combined`` and ``combined_band`` where they exist.
    """
    blocks = [F.concat_ws("\n", F.lit(f"{title}:"), *[
        F.concat(F.lit(f"  - {label}: "), _shown(df, c, how, extra)) for label, c, how, extra in lines])
        for title, lines in rules.NARRATIVE_SECTIONS]
    items = {
        "top": lambda f: F.concat(F.lit("  - "), f["feature"], F.lit(" | "), f["direction"], F.lit(" | "),
                                  f["interpretation"]),
        "scenarios": lambda s: F.concat(
            F.lit("  - "), s["title"], F.lit(": "), s["original"].cast("string"), F.lit(" -> "),
            s["modified"].cast("string"), F.lit(" (delta: "), fn.signed(s["delta"]), F.lit(") | "), s["description"]),
    }
    for c, (title, empty) in rules.NARRATIVE_LISTS.items():
        body = F.lit(empty)
        if c in df.columns:
            body = F.when(F.size(c) > 0, F.array_join(F.transform(c, items[c]), "\n")).otherwise(empty)
        if c == "scenarios" and "combined" in df.columns:
            before, between, after = map(F.lit, rules.NARRATIVE_COMBINED)
            line = F.concat(F.lit("\n"), before, F.col("combined").cast("string"), between, F.coalesce("combined_band", F.lit("?")), after)
            body = F.concat(body, F.coalesce(line, F.lit("")))
        blocks.append(F.concat(F.lit(f"{title}:\n"), body))
    return df.withColumn(name, F.concat_ws("\n\n", F.lit(rules.NARRATIVE_HEAD), *blocks, F.lit(rules.NARRATIVE_FOOT)))
