"""The clock model: when a fact happened, was published, first seen, available, and as-of."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCKS = ("event_time", "published_at", "first_seen_at", "available_at", "as_of")
ALL_CLOCKS = (*CLOCKS, "ingested_at")


class LookaheadError(ValueError):
    """A decision would have used something not yet knowable."""


def cutoff(value: datetime, naive: str = "reject") -> Column:
    """A literal decision time. ``naive`` is ``reject`` (default) or ``utc``."""
    if value.tzinfo is None:
        if naive != "utc":
            raise LookaheadError("decision time needs a time zone")
        value = value.replace(tzinfo=timezone.utc)
    text = value.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")
    return F.lit(text + "Z").cast("timestamp")


def minutes(n: float) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {int(round(n * 60))})")


def any_missing(clocks: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in clocks])


def known_at(clocks: Sequence[str] = CLOCKS) -> Column:
    """Latest of the clocks; NULL as soon as one of them is missing."""
    return F.when(~any_missing(clocks), F.greatest(*[F.col(c) for c in clocks]))


def require_clocks(df: DataFrame, clocks: Sequence[str]) -> None:
    missing = sorted(set(clocks) - set(df.columns))
    if missing:
        raise LookaheadError(f"input lacks clock columns: {missing}")


def point_in_time_slice(
    df: DataFrame, decision_time: datetime, clocks: Sequence[str] = CLOCKS, strict: bool = True
) -> DataFrame:
    """Rows whose clocks are all at or before the decision time.

    Every clock is compared on its own so the predicates reach the Parquet scan. In strict mode a
    row with a missing clock fails the job instead of silently disappearing.
    """
    require_clocks(df, clocks)
    at = cutoff(decision_time)
    if not strict:
        return reduce(lambda d, c: d.filter(F.col(c) <= at), clocks, df)
    sliced = reduce(lambda d, c: d.filter(F.col(c).isNull() | (F.col(c) <= at)), clocks, df)
    guard = F.when(any_missing(clocks), F.raise_error(F.lit("missing clock")).cast("boolean"))
    return sliced.filter(F.coalesce(guard, F.lit(True)))


def clock_violations(
    df: DataFrame, decision_time: datetime, clocks: Sequence[str] = CLOCKS
) -> DataFrame:
    """One row per clock with the number of rows that are missing it or lie in the future."""
    require_clocks(df, clocks)
    at = cutoff(decision_time)
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in clocks],
        *[F.count_if(F.col(c) > at).alias(f"f_{c}") for c in clocks],
    )
    rows = [
        F.struct(F.lit(c).alias("clock"), F.col(f"m_{c}").alias("missing"),
                 F.col(f"f_{c}").alias("future"))
        for c in clocks
    ]
    return counts.select(F.inline(F.array(*rows)))


def assert_point_in_time(df: DataFrame, decision_time: datetime, clocks=CLOCKS) -> None:
    bad = clock_violations(df, decision_time, clocks).filter("missing + future > 0").collect()
    if bad:
        raise LookaheadError(f"not knowable at the decision time: {[r.clock for r in bad]}")


def causal_rows(
    df: DataFrame, delay_minutes: float = 30, clocks: Sequence[str] = CLOCKS
) -> DataFrame:
    """Rows known no later than their own event time plus a delay."""
    require_clocks(df, clocks)
    return df.filter(known_at(clocks) <= F.col("event_time") + minutes(delay_minutes))


def execution_mask(
    df: DataFrame, columns: Sequence[str], delay_minutes: float = 30, clocks=CLOCKS
) -> DataFrame:
    """Keep every row, but blank the listed columns of rows known too late to trade on."""
    known = F.coalesce(
        known_at(clocks) <= F.col("event_time") + minutes(delay_minutes), F.lit(False)
    )
    return df.withColumns({c: F.when(known, F.col(c)) for c in columns}).withColumn(
        "execution_known", known
    )
