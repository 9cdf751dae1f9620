"""Text and category functions, Column -> Column, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def lookup(key: Column, mapping: dict) -> Column:
    """Value of ``key`` in a small literal map, null on a miss."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


# every character Unicode counts as white space
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def clean_text(c: Column) -> Column:
    """Strip all surrounding whitespace (a plain ``trim`` would only strip spaces)."""
    return F.btrim(c.cast("string"), F.lit(WHITESPACE))


def normalize_category(c: Column, mapping: dict = rules.GENDER, missing: str = "Missing",
                       other: str = "Other") -> Column:
    """Label of a dirty spelling; missing words and unknown words get labels of their own."""
    text = F.lower(clean_text(c))
    return F.when(text.isNull() | text.isin(*rules.MISSING_TOKENS), missing).otherwise(
        F.coalesce(lookup(F.replace(text, F.lit(" "), F.lit("")), mapping), F.lit(other)))


def map_area(c: Column, as_numeric: bool = False) -> Column:
    label = lookup(F.lower(clean_text(c)), rules.AREA)
    if as_numeric:
        return F.coalesce(lookup(label, rules.AREA_CODE), F.lit(-1))
    return F.coalesce(label, F.lit("Missing"))


def correct_labels(c: Column, corrections: dict = rules.MARITAL_CORRECTIONS, missing: str = "Missing") -> Column:
    """Lower case, single spaces, spelling corrections; other labels stay lower case."""
    text = F.regexp_replace(F.lower(clean_text(c)), r"(?U)\s+", " ")
    return F.coalesce(lookup(text, corrections), text, F.lit(missing))


def ordinal(c: Column, mapping: dict, unknown: int = -1) -> Column:
    return F.coalesce(lookup(F.lower(clean_text(c)), mapping), F.lit(unknown))


def group_occupation(c: Column, mapping: dict = rules.OCCUPATION) -> Column:
    text = clean_text(c)
    return F.when(text.isNull(), "Missing").otherwise(
        F.coalesce(lookup(F.lower(text), mapping), F.lit("Other")))


def duration_minutes(c: Column, unknown: int = -1) -> Column:
    text = F.replace(F.lower(clean_text(c)), F.lit(" "), F.lit(""))
    return F.coalesce(lookup(text, rules.ACTIVITY_MINUTES), F.lit(unknown))


def code_minutes(c: Column, unknown: int = -1) -> Column:
    return F.coalesce(lookup(c.cast("int"), rules.ACTIVITY_CODE_MINUTES), F.lit(unknown))


def yes_no(c: Column, legacy: bool = False) -> Column:
    """1, 0 or null, by the letters and digits of the text.

    A number equal to 1 or 0 counts as such, however it is written. ``legacy`` leaves that test out
    and reads 1.0 by its digits alone, which makes it 0.
    """
    text = F.lower(clean_text(c))
    result = F.when(text.isNull() | text.isin(*rules.MISSING_TOKENS), None)
    if not legacy:
        result = result.when(text.rlike(r"^[+]?0*1([.]0*)?$"), 1).when(text.rlike(r"^[+-]?(0+([.]0*)?|[.]0+)$"), 0)
    other = "[^a-z0-9]*"
    yes = f"^{other}y{other}e{other}s|^{other}y{other}$|1{other}$"
    no = f"^{other}n{other}o|^{other}n{other}$|0{other}$"
    return result.when(text.rlike(yes), 1).when(text.rlike(no), 0)


def null_tokens(c: Column, tokens: tuple = rules.NULL_TOKENS) -> Column:
    """Null for words that mean null."""
    text = c.cast("string")
    return F.when(~F.lower(text).isin(*tokens), text)


def split_multi(c: Column, sep: str = ",") -> Column:
    """Distinct integer codes of a cell such as ``1,3``; parts that are no numbers are left out."""
    codes = F.transform(F.split(c.cast("string"), sep), lambda x: F.trim(x).try_cast("int"))
    return F.array_distinct(F.filter(codes, lambda x: x.isNotNull()))


def readable_name(feature: Column, names: dict = rules.READABLE_NAMES) -> Column:
    base = F.regexp_replace(feature, r"_[0-9.]+$", "")
    return F.coalesce(lookup(base, names), F.initcap(F.replace(base, F.lit("_"), F.lit(" "))))


def intensity(impact: Column) -> Column:
    result = None
    for edge, word in rules.INTENSITY[:-1]:
        test = F.abs(impact) > edge
        result = F.when(test, word) if result is None else result.when(test, word)
    return result.otherwise(rules.INTENSITY[-1][1])


def interpretation(name: Column, impact: Column, outcome: str = "predicted HbA1c") -> Column:
    verb = F.when(impact > 0, "increases").otherwise("decreases")
    return F.concat_ws(" ", name, intensity(impact), verb, F.lit(outcome))


def signed(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%+.2f", c))


def encode_label(c: Column, source: Column, maps: dict) -> Column:
    """Code of a label by the first source pattern that the source name contains.

    No pattern fits: unchanged. Pattern fits but label has no code: null.
    """
    result = None
    for pattern, codes in maps.items():
        value = lookup(c, {k: str(v) for k, v in codes.items()})
        test = source.contains(pattern)
        result = F.when(test, value) if result is None else result.when(test, value)
    return result.otherwise(c)
