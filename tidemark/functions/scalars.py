"""Numeric shaping, state thresholds and report formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Round for display and comparison; adding zero folds -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite(c: Column, fallback: float = 0.0) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(float(fallback)))


def clip(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(finite(c), F.lit(float(low))), F.lit(float(high)))


def logistic(score: Column, slope: float = 2.6) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(slope) * score))


def signal_state(score: Column) -> Column:
    """Map a composite score to its candidate state."""
    return (
        F.when(score >= 0.38, "ENTRY_CANDIDATE")
        .when(score >= 0.14, "WATCH")
        .when(score > -0.18, "NO_ACTION")
        .when(score > -0.38, "REDUCE_CANDIDATE")
        .otherwise("EXIT_CANDIDATE")
    )


def close_to(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-6) -> Column:
    bound = F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.abs(a - b) <= bound


def show_number(c: Column, digits: int = 2) -> Column:
    """Thousands separators and fixed digits; a dash for anything not finite."""
    rounded = F.round(c, digits)
    return F.when(
        is_finite(c), F.format_number(F.when(rounded == 0, F.lit(0.0)).otherwise(rounded), digits)
    ).otherwise(F.lit("—"))


def show_percent(c: Column, digits: int = 1) -> Column:
    return F.when(is_finite(c), F.concat(show_number(c * 100, digits), F.lit("%"))).otherwise(
        F.lit("—")
    )


def show_time(c: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit("—"))
