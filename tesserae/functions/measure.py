"""Measurements: struct<value, ci_lo, ci_hi, unit> and column helpers over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of every comparison with a limit.
EPS = 1e-9


def measurement(value: Column, lo: Column, hi: Column, unit: str) -> Column:
    return F.struct(value.alias("value"), lo.alias("ci_lo"), hi.alias("ci_hi"), F.lit(unit).alias("unit"))


def symmetric(value: Column, half: Column, unit: str = "m") -> Column:
    return measurement(value, value - F.abs(half), value + F.abs(half), unit)


def relative(value: Column, fraction: Column, unit: str = "m") -> Column:
    return symmetric(value, F.abs(value) * F.abs(fraction), unit)


def half_width(m: Column) -> Column:
    return (m["ci_hi"] - m["ci_lo"]) / 2


def relative_half_width(m: Column) -> Column:
    return F.when(m["value"] != 0, half_width(m) / F.abs(m["value"]))


def contains(m: Column, truth: Column) -> Column:
    return truth.between(m["ci_lo"] - EPS, m["ci_hi"] + EPS)


def is_valid(m: Column) -> Column:
    return (m["ci_lo"] <= m["ci_hi"]) & m["value"].between(m["ci_lo"], m["ci_hi"])


def rescaled(m: Column, factor: Column) -> Column:
    """The interval widened about its value; a factor of 1 keeps an asymmetric interval."""
    half = half_width(m) * factor
    wide = F.struct(m["value"].alias("value"), (m["value"] - half).alias("ci_lo"), (m["value"] + half).alias("ci_hi"), m["unit"].alias("unit"))
    return F.when(factor == 1.0, m).otherwise(wide)


def within(predicted: Column, truth: Column, absolute: Column, rel: Column) -> Column:
    """|error| no more than the larger of an absolute and a relative limit."""
    return F.abs(predicted - truth) <= F.greatest(absolute, rel * F.abs(truth)) + EPS


def relative_error(predicted: Column, truth: Column) -> Column:
    return F.try_divide(F.abs(predicted - truth), F.abs(truth))


def half_even(value: Column, places: int) -> Column:
    """Rounded to so many places, halves to the even neighbour."""
    return F.bround(value, places)


def in_quadrature(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def view_uncertainty(agreement: Column, views: Column, best: float = 0.05, worst: float = 0.15) -> Column:
    """Relative uncertainty that falls as views agree; one view has the worst."""
    return F.when(views <= 1, F.lit(worst)).otherwise(F.greatest(F.lit(best), F.least(F.lit(worst), worst - agreement * (worst - best))))
