"""Derived measures and bands, Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import lookup, signed, yes_no


def clamp_to_null(c: Column, low: float, high: float) -> Column:
    """Null outside the open interval."""
    return F.when((c > low) & (c < high), c)


def bmi(height_cm: Column, weight_kg: Column) -> Column:
    metres = height_cm.cast("double") / 100
    value = F.try_divide(weight_kg.cast("double"), metres * metres)
    return F.when((height_cm > 0) & (weight_kg > 0), clamp_to_null(value, 10, 100))


def bounded_ratio(a: Column, b: Column, low: float = 0.3, high: float = 3.0) -> Column:
    value = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when((a > 0) & (b > 0), clamp_to_null(value, low, high))


def row_max(*cols: Column) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def duration(age: Column, onset: Column, low: float = 0, high: float = rules.DURATION_MAX_YEARS,
             default: float = 0) -> Column:
    years = (age - onset).cast("double")
    return F.when(years.between(low, high), years).otherwise(F.lit(float(default)))


def duration_status(years: Column, known_above: float = rules.DURATION_KNOWN_YEARS) -> Column:
    return F.when(years > known_above, "known diabetes").otherwise("newly diagnosed")


def duration_by_codebook(age: Column, onset: Column, year: int = 2013) -> Column:
    """Onset up to 10 is a duration already, above 1900 a calendar year, else an age."""
    return (F.when(onset.isNull(), F.lit(0.0))
            .when(onset <= 10, onset.cast("double"))
            .when(onset > 1900, (F.lit(year) - onset).cast("double"))
            .otherwise((age - onset).cast("double")))


def activity_score(minutes: dict[str, Column], weights: dict = rules.ACTIVITY_WEIGHTS) -> Column:
    """Weekly score; unknown minutes (-1 or null) count as 0."""
    known = {k: F.greatest(c, F.lit(0)).cast("double") for k, c in minutes.items()}
    return reduce(lambda a, b: a + b, [F.lit(weights[k]) * c * 7 for k, c in known.items()])


def activity_optimal(score: Column, threshold: float = rules.ACTIVITY_OPTIMAL) -> Column:
    return F.when(score >= threshold, "Yes").otherwise("No")


def any_flag(yes_no_cols: list[Column], count_cols: list[Column] = (), legacy_zero: bool = False, legacy: bool = False) -> Column:
    """1 if anything says yes, 0 if something is known, else null.

    A count that is present means yes. With ``legacy_zero`` an absent count means a known no; ``legacy`` is that of ``yes_no``.
    """
    absent = 0 if legacy_zero else None
    flags = [yes_no(c, legacy) for c in yes_no_cols]
    flags += [F.when(c.isNotNull(), 1).otherwise(absent) for c in count_cols]
    return row_max(*flags) if flags else F.lit(None).cast("int")


def band(c: Column, edges: list, labels: list, right_closed: bool = False) -> Column:
    """Label of the first edge above the value; the last label has no edge. Null stays null."""
    result = F.when(c.isNull(), None)
    for edge, label in zip(edges, labels):
        result = result.when(c <= edge if right_closed else c < edge, label)
    return result.otherwise(labels[-1]) if len(labels) > len(edges) else result


def stress_band(c: Column) -> Column:
    edges, labels = zip(*rules.STRESS_BANDS)
    return F.when(c >= 0, band(c, edges, labels, right_closed=True))


def risk_band(c: Column) -> Column:
    return band(c, [r[0] for r in rules.RISK_BANDS[:-1]], [r[1] for r in rules.RISK_BANDS])


def risk_confidence(c: Column) -> Column:
    return band(c, [r[0] for r in rules.RISK_BANDS[:-1]], [r[2] for r in rules.RISK_BANDS])


def glycaemic_category(c: Column) -> Column:
    normal, pre, diabetes = rules.CATEGORY_ORDER
    return (F.when(c < rules.GLYCAEMIC_NORMAL_BELOW, normal)
            .when(c <= rules.GLYCAEMIC_PRE_UP_TO, pre)
            .when(c.isNotNull(), diabetes))


def trajectory(pre: Column, post: Column) -> Column:
    order = {name: i for i, name in enumerate(rules.CATEGORY_ORDER)}
    before, after = (lookup(glycaemic_category(c), order) for c in (pre, post))
    return (F.when(after < before, "Regression").when(after == before, "Persistence")
            .when(after > before, "Progression"))


def outcome_line(pre: Column, post: Column) -> Column:
    return F.concat(F.lit("Predicted outcome: "), glycaemic_category(pre), F.lit(" → "),
                    glycaemic_category(post), F.lit(" ("), trajectory(pre, post), F.lit(")"))


def response_class(pre: Column, delta: Column) -> Column:
    result = F.when(glycaemic_category(pre) != "Diabetes", None)
    for edge, label in rules.RESPONSE_CLASSES[:-1]:
        result = result.when(delta >= edge, label)
    return result.when(delta.isNotNull(), rules.RESPONSE_CLASSES[-1][1])


def response_line(pre: Column, delta: Column) -> Column:
    return F.concat(F.lit("Predicted response: "), response_class(pre, delta), F.lit(" (ΔHbA1c "),
                    signed(delta), F.lit(")"))


def target_value(age: Column) -> Column:
    return F.when(age < 65, 7.0).otherwise(7.5)


def target_attainment(pre: Column, post: Column, age: Column) -> Column:
    """Only for a diabetic start above 7.0; both values are compared at one place."""
    target = target_value(age)
    at_start, at_end = F.round(pre, 1) <= target, F.round(post, 1) <= target
    outcome = (F.when(at_start & at_end, "At target").when(at_start, "Above target")
               .when(at_end, "Achieved target").otherwise("Not achieved"))
    return F.when((glycaemic_category(pre) == "Diabetes") & (pre > 7.0) & post.isNotNull(), outcome)


def target_line(pre: Column, post: Column, age: Column) -> Column:
    return F.concat(F.lit("Glycemic control target: ≤"), F.format_string("%.1f", target_value(age)),
                    F.lit("% (age "), F.rint(age).cast("int").cast("string"), F.lit(") | "),
                    target_attainment(pre, post, age))


def improvement_pct(original: Column, delta: Column) -> Column:
    return F.when(original > 0, F.round(delta / original * 100, 2)).otherwise(F.lit(0.0))


def class_index(c: Column, classes: int) -> Column:
    """Nearest valid class of a fractional index; halves go to the even class."""
    return F.greatest(F.least(F.rint(c), F.lit(classes - 1.0)), F.lit(0.0)).cast("int")


def interaction(indicator: Column, marker: Column) -> Column:
    return indicator.cast("double") * marker


def gauge(c: Column) -> Column:
    return F.least((c - 3) / 13 * 100, F.lit(100.0))
