"""Predicates, conversions and arithmetic used by cohort and feature plans.

NULL is the only missing value: finite() folds NaN and infinities to NULL once, at the entry of the
statistics operators. All functions keep NULL unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that read as a number in full; a Spark cast alone also takes Java suffixes such as 20d.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _seconds(hours: float) -> Column:
    whole = round(hours * 3600)
    return F.expr(f"INTERVAL '{whole}' SECOND") if whole >= 0 else F.expr(f"INTERVAL '-{-whole}' SECOND")


def any_like(label: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive LIKE with any of the patterns."""
    return reduce(lambda a, b: a | b, [F.lower(label).like(p.lower()) for p in patterns])


def none_like(label: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive LIKE with none of the patterns; NULL for a NULL label."""
    return reduce(lambda a, b: a & b, [~F.lower(label).like(p.lower()) for p in patterns])


def classify(text: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The class of the first rule with a matching pattern, in the given order; else NULL."""
    out = F.lit(None).cast("string")
    for patterns, name in reversed(rules):
        out = F.when(any_like(text, patterns), name).otherwise(out)
    return out


def within(value: Column, low: float | None, high: float | None) -> Column:
    """Not NULL and low <= value <= high; None leaves a side open."""
    test = value.isNotNull()
    if low is not None:
        test = test & (value >= low)
    if high is not None:
        test = test & (value <= high)
    return test


def in_window(ts: Column, t0: Column, low_hours: float, high_hours: float, closed: str = "[)") -> Column:
    """ts lies between t0 + low_hours and t0 + high_hours; closed names the brackets."""
    low, high = t0 + _seconds(low_hours), t0 + _seconds(high_hours)
    return (ts >= low if closed[0] == "[" else ts > low) & (ts <= high if closed[1] == "]" else ts < high)


def keep_unless(condition: Column) -> Column:
    """NOT condition where an undefined condition keeps the row (data-frame semantics, not SQL's)."""
    return ~F.coalesce(condition, F.lit(False))


def text_to_double(text: Column) -> Column:
    """NULL where the text is no number."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def number_in_text(text: Column) -> Column:
    """The text as a number, else the first number in it, else NULL."""
    return F.coalesce(text_to_double(text), F.regexp_extract(text, r"([0-9]+\.?[0-9]*)", 1).try_cast("double"))


# Mass units and their size in mg; the longest unit text that a dose unit contains decides.
MG_PER_UNIT = {"mcg": 0.001, "µg": 0.001, "ug": 0.001, "mg": 1.0, "g": 1000.0}


def dose_in_mg(dose: Column, unit: Column) -> tuple[Column, Column]:
    """(milligrams, is_unparsed). An unknown or NULL unit counts as mg only if the unit is NULL or empty."""
    value, name = number_in_text(dose), F.lower(F.trim(unit))
    mg = F.when(name.isNull() | (name == ""), value)
    for text, size in MG_PER_UNIT.items():
        mg = mg.when(name.contains(text), value * size)
    return mg, (mg.isNull()).cast("int")


def daily_dose(mg: Column, per_day: Column) -> Column:
    """Single dose times doses a day where that is known."""
    return F.when(per_day.isNotNull(), mg * per_day).otherwise(mg)


def factor_of(key: Column, factors: Mapping[str, float]) -> Column:
    """A constant by key; NULL for unknown keys."""
    pairs = [x for k, v in factors.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.try_element_at(F.create_map(*pairs), key)


def shift(ts: Column, hours: float) -> Column:
    return ts + _seconds(hours)


def hours_between(later: Column, earlier: Column) -> Column:
    """Elapsed hours, with the sign of later - earlier."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def day_distance(date: Column, target: Column) -> tuple[Column, Column]:
    """(absolute days, 1 if date is after target)."""
    days = F.datediff(F.to_date(date), F.to_date(target))
    return F.abs(days), (days > 0).cast("int")


def age_at(anchor_age: Column, anchor_year: Column, ts: Column) -> Column:
    """Age in the year of ts, within 0 and 120; NULL stays NULL."""
    return clip(anchor_age + F.year(ts) - anchor_year, 0, 120)


def pounds_to_kg(x: Column) -> Column:
    return x * 0.45359237


def inches_to_cm(x: Column) -> Column:
    return x * 2.54


def fahrenheit_to_celsius(x: Column) -> Column:
    return (x - 32.0) * 5.0 / 9.0


def bmi(kg: Column, cm: Column) -> Column:
    """NULL unless both are positive."""
    return F.when((kg > 0) & (cm > 0), kg / F.pow(cm / 100.0, F.lit(2.0)))


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    """Within [low, high]; NULL stays NULL (least and greatest alone would skip it)."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def has(value: Column) -> Column:
    return value.isNotNull().cast("int")


def either(a: Column, b: Column) -> Column:
    """1 if either 0/1 flag is 1, NULL counting as 0."""
    return (F.coalesce(a == 1, F.lit(False)) | F.coalesce(b == 1, F.lit(False))).cast("int")


def sigmoid(x: Column, limit: float | None = None) -> Column:
    x = clip(x, -limit, limit) if limit else x
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def finite(x: Column) -> Column:
    """NaN and infinities to NULL."""
    x = x.cast("double")
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)
