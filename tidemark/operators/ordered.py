"""Ordered operators that stay parallel inside one hot key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a key is split:

* running values (sums, products, maxima, last known) are two-level scans: one small aggregate per
  (key, bucket), a prefix over the buckets, and a window inside each bucket;
* trailing and leading frames run over chunks of consecutive ordinals, where the rows a frame may
  look back on (or ahead to) are copied into the neighbouring chunk.

``bucket`` is any expression that never decreases along the order, for example a month. Where the data
give none that splits evenly, ``range_buckets`` deals the rows by sampled ranges of the order itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

CHUNK = 4096


@dataclass(frozen=True)
class Running:
    """``kind`` is sum, product, max, min or last (last non-null); exclusive skips the own row."""

    kind: str
    column: Column
    exclusive: bool = False


_TOTAL = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}


def month(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c)


def _inside(spec: Running, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if spec.exclusive else 0)
    if spec.kind == "last":
        return F.last(spec.column, ignorenulls=True).over(frame)
    return _TOTAL[spec.kind](spec.column).over(frame)


def _join_levels(kind: str, before: Column, within: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(within, F.lit(0))
    if kind == "product":
        return F.coalesce(before, F.lit(1.0)) * F.coalesce(within, F.lit(1.0))
    if kind == "max":
        return F.greatest(before, within)
    if kind == "min":
        return F.least(before, within)
    return F.coalesce(within, before)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    measures: dict[str, Running],
    reverse: bool = False,
) -> DataFrame:
    """Add running measures along ``order`` within ``keys``; ``order`` must be total.

    The input is read twice (bucket totals, rows), so nest scans over staged tables only.
    """
    tagged = df.withColumn("_bucket", bucket)
    key_order = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if reverse else F.max_by
    totals = []
    for name, m in measures.items():
        if m.kind == "last":
            totals.append(pick(m.column, F.when(m.column.isNotNull(), key_order)).alias(f"_t_{name}"))
        else:
            totals.append(_TOTAL[m.kind](m.column).alias(f"_t_{name}"))
    arrange = (lambda c: F.col(c).desc_nulls_last()) if reverse else (
        lambda c: F.col(c).asc_nulls_first()
    )
    across = Window.partitionBy(*keys, F.lit(0)).orderBy(arrange("_bucket"))
    levels = tagged.groupBy(*keys, "_bucket").agg(*totals)
    levels = levels.select(
        *keys,
        "_bucket",
        *[
            _inside(Running(m.kind, F.col(f"_t_{n}"), True), across).alias(f"_p_{n}")
            for n, m in measures.items()
        ],
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*[arrange(c) for c in order])
    scanned = tagged.join(levels, [*keys, "_bucket"], "left").withColumns(
        {f"_w_{n}": _inside(m, within) for n, m in measures.items()}
    )
    combined = {
        n: _join_levels(m.kind, F.col(f"_p_{n}"), F.col(f"_w_{n}")) for n, m in measures.items()
    }
    kept = [c for c in df.columns if c not in combined]
    return scanned.select(*kept, *[c.alias(n) for n, c in combined.items()])


PART = "_part"


def range_buckets(df: DataFrame, order: Sequence[str], number: int | None = None) -> DataFrame:
    """The rows, written once, with ``PART``: a range of ``order`` from sampled splitters.

    As a bucket it follows the data: no range holds much more than its share unless one value does.
    """
    dealt = df.repartitionByRange(*order) if number is None else df.repartitionByRange(number, *order)
    return cut_lineage(dealt.withColumn(PART, F.spark_partition_id()))


def ordinals(df, keys, order, bucket, name: str = "ordinal") -> DataFrame:
    """Exact 1-based row number along a total order."""
    return running(df, keys, order, bucket, {name: Running("sum", F.lit(1).cast("bigint"))})


def frames(
    df: DataFrame,
    keys: Sequence[str],
    steps: Sequence[Callable[[object], dict[str, Column]]],
    back: int,
    ahead: int = 0,
    ordinal: str = "ordinal",
    size: int = CHUNK,
) -> DataFrame:
    """Evaluate row frames that reach at most ``back`` rows back and ``ahead`` rows forward.

    ``steps`` are applied in turn, each receiving the window, so a step may use the columns of the
    one before; ``back`` and ``ahead`` must cover the whole chain.
    """
    position = F.col(ordinal) - 1
    first = F.floor(F.greatest(position - ahead, F.lit(0)) / size)
    final = F.floor((position + back) / size)
    spread = df.withColumn("_own", F.floor(position / size)).withColumn(
        "_chunk", F.explode(F.sequence(first, final))
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy(ordinal)
    for step in steps:
        spread = spread.withColumns(step(window))
    return spread.filter(F.col("_own") == F.col("_chunk")).drop("_own", "_chunk")


def frame_median(value: Column, frame) -> Column:
    """Exact median over a bounded row frame; sorting a short array beats a value histogram."""
    seen = F.sort_array(F.collect_list(value).over(frame))
    size = F.size(seen)
    low = F.try_element_at(seen, F.floor((size + 1) / 2).cast("int"))
    high = F.try_element_at(seen, F.floor(size / 2 + 1).cast("int"))
    return F.when(size > 0, (low + high) / 2.0)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last ``n`` rows per key; small ``n`` are cut map-side before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    bucket: Callable[[Column], Column] = month,
    forward: bool = False,
    strict: bool = False,
    ties: Sequence[str] = (),
    spread: bool = False,
) -> DataFrame:
    """Attach to each left row the nearest right row at or before (after) its time.

    ``strict`` excludes equal times. Both sides are merged and scanned, so nothing is compared
    pairwise. ``ties`` order right rows of equal time; the nearest in that order wins. ``spread`` takes
    ranges of the times themselves as buckets, for keys too few or too crowded for calendar ones.
    """
    right_first = forward != (not strict)
    right_side, left_side = (0, 1) if right_first else (1, 0)
    payload = F.struct(*[F.col(v) for v in values])
    rows = right.select(
        *keys,
        F.col(right_time).alias("_time"),
        F.lit(right_side).alias("_side"),
        *[F.col(t).alias(f"_tie_{t}") for t in ties],
        payload.alias("_value"),
        F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    tie_types = {f.name: f.dataType for f in right.schema.fields}
    wanted = left.select(
        *keys,
        F.col(left_time).alias("_time"),
        F.lit(left_side).alias("_side"),
        *[F.lit(None).cast(tie_types[t]).alias(f"_tie_{t}") for t in ties],
        F.lit(None).cast(rows.schema["_value"].dataType).alias("_value"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    both, order = rows.unionByName(wanted), ["_time", "_side", *[f"_tie_{t}" for t in ties]]
    merged = running(
        range_buckets(both, [*keys, "_time", "_side"]) if spread else both,
        keys,
        order,
        F.col(PART) if spread else bucket(F.col("_time")),
        {"_hit": Running("last", F.col("_value"))},
        reverse=forward,
    )
    return merged.filter(F.col("_row").isNotNull()).select("_row.*", *[
        F.col(f"_hit.{v}").alias(v) for v in values
    ])


def latest_version(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = ("available_at", "first_seen_at", "revision"),
) -> DataFrame:
    """Keep, per key, the row that is last by ``order`` (a combinable aggregate, not a window)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


Cells = tuple[np.ndarray, np.ndarray]


def array_steps() -> SimpleNamespace:
    """Row frames over the consecutive rows of one key, as arrays of values and of which are known.

    The array form of the frames a window has: unknown values don't count, results without enough known
    values are unknown. Each frame is summed on its own from its oldest value on, as a window does, so nothing
    carries over.
    Nested functions travel to the executors by value; the library need not be installed there.
    """

    def lag(x: Cells, n: int) -> Cells:
        """The value ``n`` rows back, or ahead where ``n`` is negative."""
        values, known = np.zeros(len(x[0])), np.zeros(len(x[0]), bool)
        to, since = (slice(n, None), slice(0, -n or None)) if n >= 0 else (slice(0, n), slice(-n, None))
        values[to], known[to] = x[0][since], x[1][since]
        return values, known

    def change(x: Cells, strict: bool = False) -> Cells:
        """Relative change from the row before; from zero it is unknown, or an error if ``strict``."""
        before, known = lag(x, 1)
        known = known & x[1]
        if strict and (known & (before == 0)).any():
            raise ZeroDivisionError("a change from zero")
        known = known & (before != 0)
        return np.where(known, x[0] / np.where(known, before, 1.0) - 1, 0.0), known

    def counts(known: np.ndarray, n: int) -> np.ndarray:
        count = np.cumsum(known)
        count[n:] = count[n:] - count[:-n]
        return count

    def mean(x: Cells, n: int) -> Cells:
        values, total, size = np.where(x[1], x[0], 0.0), np.zeros(len(x[0])), len(x[0])
        for k in reversed(range(min(n, size))):
            total[k:] += values[:size - k]
        count = counts(x[1], n)
        return total / np.maximum(count, 1), count > 0

    def sd(x: Cells, n: int) -> Cells:
        """Sample standard deviation, from each frame's own mean."""
        middle, size = mean(x, n)[0], len(x[0])
        values, weight, spread = np.where(x[1], x[0], 0.0), x[1].astype(float), np.zeros(size)
        for k in reversed(range(min(n, size))):
            off = values[:size - k] - middle[k:]
            off *= off
            off *= weight[:size - k]
            spread[k:] += off
        count = counts(x[1], n)
        return np.sqrt(spread / np.maximum(count - 1, 1)), count > 1

    def median(x: Cells, n: int) -> Cells:
        padded = np.concatenate([np.full(n - 1, np.nan), np.where(x[1], x[0], np.nan)])
        ordered = np.sort(np.lib.stride_tricks.sliding_window_view(padded, n), axis=1)
        count = counts(x[1], n)
        row, last = np.arange(len(count)), n - 1
        low = ordered[row, np.clip((count + 1) // 2 - 1, 0, last)]
        high = ordered[row, np.clip(count // 2, 0, last)]
        return (low + high) / 2.0, count > 0

    return SimpleNamespace(lag=lag, change=change, mean=mean, sd=sd, median=median)


def array_frames(
    df: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    compute: Callable[[SimpleNamespace, dict[str, Cells]], dict[str, Cells]],
    outputs: Sequence[str],
    back: int,
    ahead: int = 0,
    ordinal: str = "ordinal",
    size: int = CHUNK,
) -> DataFrame:
    """``frames`` for long frames: a window sums every frame anew row by row, arrays do a chunk at once.

    ``compute`` gets the ``inputs`` (numbers) of a chunk and the rows a frame may reach, and returns
    ``outputs`` (doubles). Groups are chunks, so they stay bounded however many rows a key has.
    """
    position = F.col(ordinal) - 1
    first = F.floor(F.greatest(position - ahead, F.lit(0)) / size)
    final = F.floor((position + back) / size)
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, final)))
    kept, steps = df.columns, array_steps()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ordinal)
        cells = {}
        for name in inputs:
            column = table[name].cast(pa.float64())
            known = column.is_valid().to_numpy()
            cells[name] = (column.fill_null(0.0).to_numpy(), known)
        with np.errstate(all="ignore"):
            out = compute(steps, cells)
        at = table[ordinal].to_numpy()
        own = np.flatnonzero((at - 1) // size == table["_chunk"][0].as_py())
        mine = table.select(kept).take(pa.array(own))
        for name in outputs:
            values, known = out[name]
            mine = mine.append_column(name, pa.array(values[own], pa.float64(), mask=~known[own]))
        return mine

    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in df.schema]
        + [T.StructField(name, T.DoubleType()) for name in outputs]
    )
    return spread.groupBy(*keys, "_chunk").applyInArrow(run, schema)
