"""Portfolio state, valuation, corporate actions, next-bar fills and reconciliation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clocks import CLOCKS, cutoff, known_at, minutes
from tidemark.functions.hashing import SEPARATOR, content_key, escaped
from tidemark.functions.scalars import close_to, is_finite
from tidemark.operators.crosssection import concentration_rules
from tidemark.operators.ordered import Running, asof, latest_version, month, running
from tidemark.session import cut_lineage

# The open lies 5 h 30 min before the bar's event time; entitlement one minute earlier.
OPEN_BEFORE_EVENT = 330
ENTITLED_BEFORE_EVENT = 331
KEY = ["portfolio_id"]
HELD = ["portfolio_id", "instrument_id"]


def through(entries: DataFrame, at: datetime | None) -> DataFrame:
    return entries if at is None else entries.filter(F.col("occurred_at") <= cutoff(at, "utc"))


def cash_and_fees(entries: DataFrame, at: datetime | None = None) -> DataFrame:
    return through(entries, at).groupBy(*KEY).agg(
        F.coalesce(F.sum("cash_delta"), F.lit(0.0)).alias("cash"),
        F.coalesce(F.sum("fee_amount"), F.lit(0.0)).alias("total_fees"),
        F.sum(F.when(F.col("entry_type") == "OPENING_CASH", F.col("cash_delta"))).alias("opening"),
    )


def positions(entries: DataFrame, at: datetime | None = None) -> DataFrame:
    """Quantity per held instrument; dust below 1e-9 is no position."""
    return (
        through(entries, at).filter(F.col("instrument_id").isNotNull()).groupBy(*HELD)
        .agg(F.sum("quantity_delta").alias("quantity")).filter(F.abs("quantity") > 1e-9)
    )


def average_cost(fills: DataFrame, held: DataFrame) -> DataFrame:
    """Cost of the fills (NULL without any) and what a unit of the holding cost; NULL keys are a key like any other."""
    cost = fills.groupBy(*HELD).agg(F.sum(F.col("gross_amount") + F.col("fee")).alias("cost"))
    same = [held[k].eqNullSafe(cost[k]) for k in HELD]
    return held.join(cost, same[0] & same[1], "left").select(
        *[held[k] for k in HELD], "quantity", "cost",
        F.coalesce(F.try_divide("cost", "quantity"), F.lit(0.0)).alias("average_cost"),
    )


def position_at(requests: DataFrame, entries: DataFrame, time: str) -> DataFrame:
    """Quantity held at a time (entries at that time included), for (portfolio, instrument) rows."""
    trades = entries.filter(F.col("instrument_id").isNotNull()).groupBy(*HELD, "occurred_at").agg(
        F.sum("quantity_delta").alias("_q")
    )
    held = running(
        trades, HELD, ["occurred_at"], month("occurred_at"),
        {"quantity": Running("sum", F.col("_q"))},
    )
    out = asof(requests, held, HELD, time, "occurred_at", ["quantity"])
    return out.withColumn("quantity", F.coalesce("quantity", F.lit(0.0)))


#: Portfolios that are marked together, so that a price is sent to their task once.
TOGETHER = 256


def nav_rows(entries: DataFrame, bars: DataFrame, at: datetime) -> DataFrame:
    """What a year of a group of portfolios is marked by, written once: prices and, per portfolio, what it had and books.

    Columns are ``part`` (group), ``block`` (year), the portfolio (NULL for a price), the instrument (NULL for cash),
    ``t`` in microseconds (NULL for what holds when the block begins), ``v`` (price or quantity), ``cash`` and ``peak``.
    Only instruments held at ``at`` are marked, in the past as well; a price is sent once to a group, not to each holder.
    """
    c = F.col
    booked = through(entries, at).filter(c("portfolio_id").isNotNull())
    held = cut_lineage(positions(booked).select(*HELD))
    groups = max(1, math.ceil(held.select(*KEY).distinct().count() / TOGETHER))
    part = F.pmod(F.xxhash64("portfolio_id"), F.lit(groups)).cast("int").alias("part")
    wanted = held.select("instrument_id").distinct()
    slim = bars.select("instrument_id", "event_time", "available_at", "first_seen_at", "revision",
                       "close", "fx_rate").join(wanted, "instrument_id", "left_semi")
    known = latest_version(slim, ["instrument_id", "event_time"]).select(
        "instrument_id", c("event_time").alias("_t"), "close", "fx_rate"
    )
    # Prices are carried forward once per instrument, not once per holder.
    carried = running(
        known, ["instrument_id"], ["_t"], month("_t"),
        {"p": Running("last", c("close")), "f": Running("last", c("fx_rate"))},
    )
    prices = cut_lineage(carried.select(
        "instrument_id", F.year("_t").alias("block"), F.unix_micros("_t").alias("t"),
        F.coalesce(c("p") * c("f"), F.lit(0.0)).alias("v"),
    ))
    blocks = cut_lineage(prices.select("block").distinct())
    ends = prices.groupBy("instrument_id", "block").agg(F.max_by("v", "t").alias("v"))
    before = Window.partitionBy("instrument_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opening = wanted.crossJoin(blocks).join(ends, ["instrument_id", "block"], "left").select(
        "instrument_id", "block", F.lit(None).cast("bigint").alias("t"), F.last("v", ignorenulls=True).over(before).alias("v")
    ).filter(c("v").isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    id_type = entries.schema["portfolio_id"].dataType
    marks = held.select(part, "instrument_id").distinct().join(prices.unionByName(opening), "instrument_id").select(
        "part", "block", none(id_type).alias("portfolio_id"), "instrument_id", "t", "v", F.lit(0.0).alias("cash")
    )
    # Quantities count where the instrument is held at the end, cash always.
    changes = booked.join(held.withColumn("_held", F.lit(True)), HELD, "left").select(
        part, F.year("occurred_at").alias("block"), "portfolio_id",
        F.when(c("_held"), c("instrument_id")).alias("instrument_id"), F.unix_micros("occurred_at").alias("t"),
        F.when(c("_held"), F.coalesce("quantity_delta", F.lit(0.0))).otherwise(0.0).alias("v"),
        F.coalesce("cash_delta", F.lit(0.0)).alias("cash"),
    )
    changes = cut_lineage(changes.join(held.select(*KEY).distinct(), KEY, "left_semi"))
    sums = changes.groupBy("part", "portfolio_id", "instrument_id", "block").agg(F.sum("v").alias("v"), F.sum("cash").alias("cash"))
    later = sums.withColumnRenamed("block", "_from").crossJoin(blocks).filter("block > _from").drop("_from")
    every = held.select(part, *HELD).crossJoin(blocks).withColumns({"v": F.lit(0.0), "cash": F.lit(0.0)})
    had = later.unionByName(every).groupBy("part", "block", *HELD).agg(F.sum("v").alias("v"), F.sum("cash").alias("cash"))
    rows = marks.unionByName(changes).unionByName(had.withColumn("t", none("bigint")))
    return cut_lineage(rows.withColumn("peak", none("double")))


def _mark(kind: str, at_least: int = 1 << 14):
    """Fold over rows of ``nav_rows`` by (part, block, portfolio, instrument, t): navs, or each block's top, end or fall.

    Held are the prices of one block of one group, and one portfolio's rows in it.
    """
    start = -(1 << 62)

    def navs(prices: dict, lots: dict, booked: list) -> tuple[np.ndarray, np.ndarray]:
        seen = [prices[i][0] for i in lots if i in prices]
        times = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
        times = times[times > start]
        nav = np.zeros(len(times))
        if len(times):
            level = lambda ts, vs: np.concatenate([[0.0], vs])[np.searchsorted(ts, times, "right")]
            for i, (ts, qs) in lots.items():
                if i in prices:
                    nav += level(np.array(ts), np.cumsum(qs)) * level(*prices[i])
            booked.sort(key=lambda x: x[0])
            nav += level(np.array([x[0] for x in booked]), np.cumsum([x[1] for x in booked]))
        return times, nav

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, kinds = [], 0, None
        prices, lots, booked, peak = {}, {}, [], None
        group = owner = None

        def close() -> None:
            nonlocal size, peak
            if owner is not None:
                times, nav = navs(prices, lots, booked)
                if len(times) and kind == "nav":
                    out.append((np.full(len(times), len(owners)), times, nav))
                    owners.append(owner)
                    size += len(times)
                elif len(times):
                    top = np.maximum.accumulate(nav if peak is None else np.maximum(nav, peak))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        fall = (nav / top - 1)[top != 0]
                    least = np.fmin.reduce(fall) if len(fall) else None
                    out.append((group[1], int(times[-1]), float(nav[-1]), float(top[-1]), None if least is None else float(least)))
                    owners.append(owner)
                    size += 1
            lots.clear()
            booked.clear()
            peak = None

        def batch_of() -> pa.RecordBatch:
            if kind == "nav":
                index, times, nav = (np.concatenate([o[k] for o in out]) for k in range(3))
                return pa.RecordBatch.from_arrays(
                    [pa.array(owners, kinds).take(pa.array(index)), pa.array(times), pa.array(nav)], ["portfolio_id", "t", "nav"])
            types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(owners, kinds), *[pa.array(x, t) for x, t in zip(zip(*out), types)]],
                ["portfolio_id", "block", "t", "nav", "top", "fall"])

        owners: list = []
        for batch in batches:
            kinds = batch.schema.field("portfolio_id").type
            for own_part, block, who, what, t, v, cash, high in zip(*[x.to_pylist() for x in batch.columns]):
                if (own_part, block) != group or who != owner:
                    close()
                    if owner is None and who is not None and (own_part, block) == group:
                        prices = {i: (np.array(x[0]), np.array(x[1])) for i, x in prices.items()}
                    if (own_part, block) != group:
                        group, prices = (own_part, block), {}
                    owner = who
                    if size >= at_least:
                        yield batch_of()
                        out.clear()
                        owners.clear()
                        size = 0
                t = start if t is None else t
                if who is None:
                    ts, vs = prices.setdefault(what, ([], []))
                    ts.append(t)
                    vs.append(v)
                elif high is not None:
                    peak = high
                else:
                    if what is not None:
                        ts, qs = lots.setdefault(what, ([], []))
                        ts.append(t)
                        qs.append(v)
                    booked.append((t, cash))
        close()
        if size:
            yield batch_of()

    return fold


def _marked(rows: DataFrame, kind: str) -> DataFrame:
    order = ["part", "block", "portfolio_id", "instrument_id", "t"]
    ordered = rows.select(*order, "v", "cash", "peak").repartition("part", "block").sortWithinPartitions(*order)
    who = rows.schema["portfolio_id"].dataType.simpleString()
    rest = "t long, nav double" if kind == "nav" else "block int, t long, nav double, top double, fall double"
    return ordered.mapInArrow(_mark(kind), f"portfolio_id {who}, {rest}")


def nav_history(entries: DataFrame, bars: DataFrame, at: datetime) -> DataFrame:
    """Net asset value per portfolio at every bar time of the instruments it holds at ``at``.

    Groups of portfolios are marked a year at a time from the prices sent to the group, so neither holders and bars
    nor times and holdings are paired in a table; what a year begins with are sums over the years before.
    """
    return _marked(nav_rows(entries, bars, at), "nav").select(
        *KEY, F.timestamp_micros("t").alias("valuation_time"), "nav"
    )


def nav_track(entries: DataFrame, bars: DataFrame, at: datetime) -> DataFrame:
    """Per portfolio: last valuation time and value, and the deepest fall below the highest value so far.

    Each year's highest value comes first; then years are marked again, given the highest value before them.
    """
    c = F.col
    rows = nav_rows(entries, bars, at)
    years = cut_lineage(_marked(rows, "top").drop("fall"))
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = years.select(*KEY, "block", F.max("top").over(before).alias("peak")).filter(c("peak").isNotNull())
    part = rows.filter(c("portfolio_id").isNotNull()).select("part", *KEY).distinct()
    again = rows.unionByName(tops.join(part, KEY), allowMissingColumns=True)
    return _marked(again, "fall").groupBy(*KEY).agg(
        F.timestamp_micros(F.max("t")).alias("valuation_time"), F.max_by("nav", "t").alias("marked_nav"),
        F.min("fall").alias("max_drawdown"),
    )


def valuation(
    entries: DataFrame, bars: DataFrame, at: datetime, stale_after_minutes: int | None = None
) -> DataFrame:
    """Per portfolio: cash, NAV, drawdown and whether a complete, fresh, positive mark exists.

    NAV is NULL unless every held instrument has its latest bar at one common time. A portfolio
    without positions is worth its cash.
    """
    c, now = F.col, cutoff(at, "utc")
    track = nav_track(entries, bars, at)
    newest = bars.groupBy("instrument_id").agg(
        F.max("event_time").alias("last_time"),
        F.max_by(
            F.struct("close", "fx_rate", F.least("event_time", "available_at", "as_of").alias("old"),
                     F.greatest("published_at", "first_seen_at", "available_at", "as_of").alias("kn")),
            F.struct("event_time", "available_at", "first_seen_at", "revision"),
        ).alias("l"),
    )
    usable = (
        is_finite(c("l.close")) & is_finite(c("l.fx_rate")) & (c("l.close") > 0)
        & (c("l.fx_rate") > 0) & (c("l.kn") >= c("last_time"))
    )
    if stale_after_minutes is not None:
        usable = usable & (now - c("l.old") <= minutes(stale_after_minutes))
    held = positions(entries, at).join(newest, "instrument_id", "left")
    marks = held.groupBy(*KEY).agg(
        F.count("*").alias("holdings"),
        (F.min("last_time").eqNullSafe(F.max("last_time")) & F.bool_and(c("last_time").isNotNull()))
        .alias("common_time"),
        F.bool_and(F.coalesce(usable, F.lit(False))).alias("usable"),
    )
    out = cash_and_fees(entries, at).join(marks, KEY, "left").join(track, KEY, "left")
    flat = c("holdings").isNull()
    ok = F.coalesce(c("common_time") & c("usable"), F.lit(False))
    return out.withColumns(
        {
            "nav": F.when(flat, c("cash")).when(ok, c("marked_nav")),
            "max_drawdown": F.when(flat, 0.0).otherwise(c("max_drawdown")),
            "available": flat | ok,
        }
    )


def portfolio_gate(
    entries: DataFrame, bars: DataFrame, instruments: DataFrame, limits, at: datetime,
    stale_after_minutes: int | None = None, initial_cash: float = 1_000_000.0,
) -> DataFrame:
    """Risk codes per portfolio, and a hash of what they were decided by.

    A book without positions is judged by its cash alone, and only if it was ever opened. Otherwise NAV and
    drawdown come from the valuation; holdings missing from the instrument master stop the check of
    concentration. An opening of nothing counts as ``initial_cash``. A book whose highest value never left zero has
    no drawdown: that makes its valuation unavailable, but what its NAV alone decides is judged as ever.
    """
    c = F.col
    valued = cut_lineage(valuation(entries, bars, at, stale_after_minutes))
    marks = bars.groupBy("instrument_id").agg(
        F.max_by(c("close") * c("fx_rate"),
                 F.struct("event_time", "available_at", "first_seen_at", "revision")).alias("_px")
    )
    master = instruments.select("instrument_id", "asset_class", "industry", "region",
                                F.lit(True).alias("_known"))
    holdings = cut_lineage(
        positions(entries, at).join(marks, "instrument_id", "left")
        .join(valued.select(*KEY, "nav"), KEY).join(master, "instrument_id", "left")
        .withColumn("weight", F.try_divide(c("quantity") * c("_px"), c("nav")))
    )
    unknown = holdings.groupBy(*KEY).agg(F.bool_or(c("_known").isNull()).alias("_unknown"))
    breaches = concentration_rules(holdings, KEY, limits).groupBy(*KEY).agg(
        # At most one entry per breached cap: 1 / smallest cap per level bounds the list.
        F.array_sort(F.collect_list(F.struct("level", "rule"))).alias("_b")
    )
    flat, marked, fell = c("holdings").isNull(), c("nav").isNotNull(), c("max_drawdown").isNotNull()
    funds = F.when(flat, c("opening")).otherwise(
        F.when(F.coalesce("opening", F.lit(0.0)) == 0, F.lit(initial_cash)).otherwise(c("opening"))
    )
    priced = F.when(flat, c("opening").isNotNull()).otherwise(marked)
    lost = F.try_divide(c("nav"), c("_funds")) - 1 <= -limits.max_loss
    held = ~flat & marked
    named = F.transform(
        F.coalesce("_b", F.array().cast("array<struct<level:int,rule:string>>")),
        lambda x: F.concat(F.lit("PORTFOLIO_"), x["rule"]),
    )
    no_codes = F.array().cast("array<string>")
    rules = F.concat(
        F.array_compact(F.array(
            F.when(~flat & ~(marked & fell), "PORTFOLIO_VALUATION_UNAVAILABLE"),
            F.when(priced & (c("_funds") <= 0), "PORTFOLIO_OPENING_CAPITAL_INVALID"),
            F.when(priced & (c("_funds") > 0) & lost, "PORTFOLIO_MAX_SIMULATION_LOSS"),
            F.when(held & (c("max_drawdown") <= -limits.max_drawdown), "PORTFOLIO_MAX_DRAWDOWN"),
            F.when(held & c("_unknown"), "PORTFOLIO_INSTRUMENT_MASTER_MISSING"),
        )),
        F.when(held & ~c("_unknown"), named).otherwise(no_codes),
    )
    bounds = [limits.max_loss, limits.max_drawdown]
    caps = [limits.single_cap, limits.asset_class_cap, limits.industry_cap, limits.region_cap, limits.cash_floor]
    text = lambda xs: F.lit("|".join(repr(float(x)) for x in xs))
    context = F.sha2(F.concat_ws(
        SEPARATOR, F.array_join(F.transform("rules", escaped), SEPARATOR),
        F.when(flat, text(bounds)).otherwise(text([*bounds, *caps])), F.when(~flat & ~fell, F.lit("no drawdown")),
    ), 256)
    return (
        valued.join(unknown, KEY, "left").join(breaches, KEY, "left")
        .withColumn("_funds", funds).withColumn("rules", rules).withColumn("context_hash", context)
        .drop("_funds", "_unknown", "_b")
    )


def corporate_actions(bars: DataFrame, at: datetime) -> DataFrame:
    """Latest known vintage of every split or dividend."""
    now = cutoff(at, "utc")
    acted = (F.col("split_factor") != 1) | (F.col("dividend") != 0)
    known = bars.filter((known_at(CLOCKS) <= now) & acted)
    return latest_version(known, ["instrument_id", "event_time"]).withColumn(
        "effective_at", F.col("event_time") - minutes(ENTITLED_BEFORE_EVENT)
    )


def corporate_action_entries(
    entries: DataFrame, actions: DataFrame, booked_keys: DataFrame | None = None
) -> DataFrame:
    """Dividend and split entries for positions held when an action takes effect.

    Earlier splits change later entitlements. Quantities are therefore kept in units before any
    split (quantity divided by the split product so far) and scaled by the product of the splits
    that precede each action; nothing is replayed action by action.
    """
    c = F.col
    splits = cut_lineage(running(
        actions.select("instrument_id", "effective_at", "split_factor", "dividend", "fx_rate",
                       "event_time", "revision"),
        ["instrument_id"], ["effective_at"], month("effective_at"),
        {
            "product": Running("product", c("split_factor")),
            "before": Running("product", c("split_factor"), True),
        },
    ))
    bought = entries.filter(c("instrument_id").isNotNull()).select(
        *HELD, "occurred_at", "quantity_delta"
    )
    # A purchase at the very moment of a split takes part in it: only earlier splits divide.
    scaled = asof(
        bought, splits.select("instrument_id", "effective_at", "product"), ["instrument_id"],
        "occurred_at", "effective_at", ["product"], strict=True,
    )
    units = cut_lineage(
        scaled.groupBy(*HELD, "occurred_at").agg(
            F.sum(c("quantity_delta") / F.coalesce("product", F.lit(1.0))).alias("u")
        )
    )
    held = running(units, HELD, ["occurred_at"], month("occurred_at"),
                   {"units": Running("sum", c("u"))})
    due = bought.select(*HELD).distinct().join(splits, "instrument_id")
    placed = asof(due, held, HELD, "effective_at", "occurred_at", ["units"]).withColumn(
        "position", c("units") * c("before")
    ).filter(c("position") > 0)
    broken = (c("split_factor") <= 0) | (c("dividend") < 0) | (c("fx_rate") <= 0)
    checked = placed.withColumn(
        "position",
        F.when(broken, F.raise_error(F.lit("corporate action is invalid")).cast("double"))
        .otherwise(c("position")),
    )
    booked = F.array_compact(
        F.array(
            F.when(c("dividend") != 0, F.struct(
                F.lit("DIVIDEND").alias("entry_type"),
                (c("position") * c("dividend") * c("fx_rate")).alias("cash_delta"),
                F.lit(0.0).alias("quantity_delta"))),
            F.when(c("split_factor") != 1, F.struct(
                F.lit("SPLIT").alias("entry_type"), F.lit(0.0).alias("cash_delta"),
                (c("position") * (c("split_factor") - 1)).alias("quantity_delta"))),
        )
    )
    rows = checked.select(
        *HELD, c("effective_at").alias("occurred_at"), "event_time", "revision", F.inline(booked)
    ).withColumn(
        "idempotency_key",
        content_key(F.lit("corporate-action"), c("portfolio_id"), c("instrument_id"),
                    F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), c("entry_type")),
    )
    if booked_keys is None:
        return rows
    if "revision" in booked_keys.columns:
        # An action that was booked under another revision must not be dropped in silence.
        stored = booked_keys.select("idempotency_key", F.col("revision").alias("_booked")).distinct()
        rows = rows.join(stored, "idempotency_key", "left")
        clash = F.col("_booked").isNotNull() & ~F.col("_booked").eqNullSafe(F.col("revision"))
        rows = rows.withColumn(
            "revision",
            F.when(clash, F.raise_error(F.lit("corporate action was booked under another revision")))
            .otherwise(F.col("revision")),
        ).filter(F.col("_booked").isNull() | clash).drop("_booked")
        return rows
    return rows.join(booked_keys.select("idempotency_key"), "idempotency_key", "left_anti")


def next_executable_bar(
    signals: DataFrame, bars: DataFrame, delay_minutes: float = 30
) -> DataFrame:
    """First bar after a signal that was verified in time and opens after the signal was usable.

    ``signals`` carries instrument_id, data_as_of and earliest_fill.
    """
    usable = bars.filter(known_at() <= F.col("event_time") + minutes(delay_minutes)).select(
        "instrument_id", F.col("event_time").alias("bar_time"), "open", "fx_rate"
    )
    after = F.greatest("data_as_of", F.col("earliest_fill") + minutes(OPEN_BEFORE_EVENT))
    # Both bounds are strict, so one strict forward match on the later one satisfies them.
    return asof(
        signals.withColumn("_after", after),
        usable.withColumn("_bar", F.col("bar_time")), ["instrument_id"], "_after", "_bar",
        ["bar_time", "open", "fx_rate"], forward=True, strict=True,
    ).withColumn("filled_at", F.col("bar_time") - minutes(OPEN_BEFORE_EVENT)).drop("_after")


# ------------------------------------------------------------------ allocation

ALLOCATION_SCHEMA = (
    "portfolio_id bigint, decided_at timestamp, signal_id bigint, target_weight double, "
    "increment double, status string, quantity double, price double, gross double, fee double"
)


#: What becomes of a candidate whose portfolio has no book.
NO_BOOK = (None, 0.0, "NO_BOOK", 0.0, None, 0.0, 0.0)


class _Book:
    """Weights, caps, turnover and cash of one portfolio while its candidates pass by."""

    def __init__(self, row, limits):
        self.limits = limits
        self.nav, self.cash = row.nav, row.cash
        self.left = limits.max_turnover
        self.weights, self.values, self.sums, self.total = {}, {}, {}, 0.0
        for item in row.holdings:
            self._add(item["instrument_id"], item["weight"], item["asset_class"], item["industry"],
                      item["region"])
            self.values[item["instrument_id"]] = item["weight"] * self.nav

    def _add(self, key, weight, asset_class, industry, region):
        self.weights[key] = self.weights.get(key, 0.0) + weight
        self.total += weight
        for pair in (("a", asset_class), ("i", industry), ("r", region)):
            self.sums[pair] = self.sums.get(pair, 0.0) + weight

    def _fits(self, row, increment):
        lim, eps = self.limits, 1e-9
        # Only the cells a candidate touches can change, but a book already over a cap stays shut.
        caps = {"a": lim.asset_class_cap, "i": lim.industry_cap, "r": lim.region_cap}
        touched = {("a", row.asset_class), ("i", row.industry), ("r", row.region)}
        sums_ok = all(
            value + (increment if cell in touched else 0.0) <= caps[cell[0]] + eps
            for cell, value in {**{k: 0.0 for k in touched}, **self.sums}.items()
        )
        singles_ok = all(
            w <= lim.single_cap + eps for k, w in self.weights.items() if k != row.instrument_id
        )
        return sums_ok and singles_ok and self.total + increment <= 1 - lim.cash_floor + eps

    def decide(self, row):
        lim = self.limits
        target = min(row.risk_budget_max, lim.single_cap)
        increment = target - self.weights.get(row.instrument_id, 0.0)
        skip = (
            self.left <= 0 or row.news_score <= -lim.news_threshold or increment <= 1e-9
            or increment > self.left + 1e-9 or not self._fits(row, increment)
        )
        nothing = (self.weights.get(row.instrument_id, 0.0), 0.0, "EVALUATED_NO_ALLOCATION",
                   0.0, None, 0.0, 0.0)
        if skip:
            return nothing
        self._add(row.instrument_id, increment, row.asset_class, row.industry, row.region)
        self.left -= increment
        return (target, increment, *self._fill(row, increment))

    def _fill(self, row, increment):
        lim = self.limits
        if row.open is None or math.isnan(row.open):
            return "SKIPPED_NO_NEXT_BAR", 0.0, None, 0.0, 0.0
        price = row.open * (1 + lim.slippage_bps / 10_000)
        if row.fx_rate is None or not math.isfinite(row.fx_rate) or row.fx_rate <= 0:
            return "SKIPPED_INVALID_FX", 0.0, None, 0.0, 0.0
        unit = price * row.fx_rate * (1 + lim.fee_bps / 10_000)
        lots = math.floor(self.nav * increment / unit / 100) * 100
        if lots <= 0:
            return "SKIPPED_BELOW_LOT", 0.0, price, 0.0, 0.0
        gross = lots * price * row.fx_rate
        fee = gross * lim.fee_bps / 10_000
        if gross + fee > self.cash + 1e-6:
            return "SKIPPED_CASH", 0.0, price, 0.0, 0.0
        if self.cash - gross - fee < self.nav * lim.cash_floor - 1e-6:
            return "SKIPPED_CASH_FLOOR", 0.0, price, 0.0, 0.0
        value = self.values.get(row.instrument_id, 0.0) + gross
        if value > self.nav * lim.single_cap + 1e-6:
            return "SKIPPED_SINGLE_ETF_CAP", 0.0, price, 0.0, 0.0
        self.cash -= gross + fee
        self.values[row.instrument_id] = value
        return "FILLED", float(lots), price, gross, fee


def allocate(candidates: DataFrame, books: DataFrame, limits) -> DataFrame:
    """Greedy allocation and lot sizing, candidate by candidate in order of composite score.

    Each acceptance changes what the next candidate may take, so a portfolio's candidates are
    streamed in order through one pass that keeps only the book, never the candidates. Candidates
    that no book could accept are decided before the shuffle and skip the ordered pass.
    ``books`` has one row per portfolio with nav, cash and its current holdings; candidates of a portfolio
    without a book come out as NO_BOOK, so as many rows leave as enter.
    """
    c = F.col
    # Two-valued: a candidate without a news score or a budget is refused, not lost.
    hopeless = F.coalesce(c("news_score") <= -limits.news_threshold, F.lit(True)) | (
        F.coalesce(F.least(c("risk_budget_max"), F.lit(limits.single_cap)), F.lit(0.0)) <= 1e-9
    )
    columns = ["portfolio_id", "decided_at", "signal_id", "instrument_id", "asset_class",
               "industry", "region", "composite_score", "risk_budget_max", "news_score", "open",
               "fx_rate"]
    head = books.select(
        "portfolio_id", "nav", "cash",
        F.coalesce("holdings", F.array().cast(books.schema["holdings"].dataType)).alias("holdings"),
    )
    live = candidates.select(*columns).filter(~hopeless)
    opening = candidates.select("portfolio_id", "decided_at").distinct().join(head, "portfolio_id")
    # The book row sorts first in its group and is followed by the candidates.
    rows = live.withColumns(
        {"_kind": F.lit(1), "nav": F.lit(None).cast("double"), "cash": F.lit(None).cast("double"),
         "holdings": F.lit(None).cast(head.schema["holdings"].dataType)}
    ).unionByName(opening.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    ordered = rows.repartition("portfolio_id", "decided_at").sortWithinPartitions(
        "portfolio_id", "decided_at", "_kind", c("composite_score").desc(), "signal_id"
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = key = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name="Row"):
                if key != (own := (row.portfolio_id, row.decided_at)):
                    key, book = own, None
                if row.kind == 0:
                    book = _Book(row, limits)
                    continue
                what = NO_BOOK if book is None else book.decide(row)
                out.append((row.portfolio_id, row.decided_at, row.signal_id, *what))
            names = [x.split()[0] for x in ALLOCATION_SCHEMA.split(", ")]
            yield pd.DataFrame(out, columns=names)

    decided = ordered.withColumnRenamed("_kind", "kind").mapInPandas(fold, ALLOCATION_SCHEMA)
    refused = candidates.filter(hopeless).select(
        "portfolio_id", "decided_at", "signal_id", F.lit(None).cast("double").alias("target_weight"),
        F.lit(0.0).alias("increment"), F.lit("EVALUATED_NO_ALLOCATION").alias("status"),
        F.lit(0.0).alias("quantity"), F.lit(None).cast("double").alias("price"),
        F.lit(0.0).alias("gross"), F.lit(0.0).alias("fee"),
    )
    return decided.unionByName(refused)


# ------------------------------------------------------------------ idempotency and chains

def version_signals(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """What happens to each signal when a run is recorded again.

    Same key: REUSED, or REACTIVATED when it was not current. New key: NEW. A current signal of the
    same instrument with another key: SUPERSEDED.
    """
    old = stored.select("idempotency_key", "instrument_id", "signal_id", "is_current")
    known = old.select("idempotency_key", F.col("is_current").alias("_was"))
    offered = fresh.select("idempotency_key", "instrument_id", "signal_id").join(
        known, "idempotency_key", "left"
    )
    action = (
        F.when(F.col("_was").isNull(), "NEW").when(F.col("_was"), "REUSED").otherwise("REACTIVATED")
    )
    replaced = (
        old.filter("is_current")
        .join(fresh.select("instrument_id").distinct(), "instrument_id", "left_semi")
        .join(fresh.select("idempotency_key"), "idempotency_key", "left_anti")
        .select("instrument_id", "signal_id", F.lit("SUPERSEDED").alias("action"))
    )
    return offered.select("instrument_id", "signal_id", action.alias("action")).unionByName(replaced)


def replay_guard(signals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per signal: NEW, ALREADY_DECIDED, or BLOCKED when another version decided the same case."""
    case = ["instrument_id", "decided_at"]
    own = decisions.select("signal_id").distinct().withColumn("_own", F.lit(True))
    taken = decisions.groupBy(*case).agg(
        F.min("signal_id").alias("_a"), F.max("signal_id").alias("_b")
    )
    joined = signals.join(own, "signal_id", "left").join(taken, case, "left")
    other = F.coalesce(
        (F.col("_a") != F.col("signal_id")) | (F.col("_b") != F.col("signal_id")), F.lit(False)
    )
    state = (
        F.when(other, "CROSS_VERSION_DECISION_REPLAY_BLOCKED")
        .when(F.col("_own"), "ALREADY_DECIDED").otherwise("NEW")
    )
    return joined.withColumn("replay", state).drop("_own", "_a", "_b")


def opening_entries(portfolios: DataFrame, entries: DataFrame, amount: float) -> DataFrame:
    """Opening entries to add, and portfolios whose stored opening is not exactly one of ``amount``."""
    stored = entries.filter(F.col("entry_type") == "OPENING_CASH").groupBy(*KEY).agg(
        F.count("*").alias("_n"), F.min("cash_delta").alias("_a"), F.max("cash_delta").alias("_b")
    )
    fine = (F.col("_n") == 1) & close_to(F.col("_a"), F.lit(amount)) & close_to(
        F.col("_b"), F.lit(amount)
    )
    action = F.when(F.col("_n").isNull(), "INSERT").when(fine, "KEEP").otherwise("VIOLATION")
    return portfolios.select(*KEY).distinct().join(stored, KEY, "left").select(
        *KEY, action.alias("action")
    )


def reconcile_chain(
    entries: DataFrame, fills: DataFrame, decisions: DataFrame, signals: DataFrame
) -> DataFrame:
    """(object_id, kind) of every break in the chain entry - fill - decision - signal."""
    c = F.col

    def found(df: DataFrame, key: Column, kind: str) -> DataFrame:
        return df.select(key.cast("bigint").alias("object_id"), F.lit(kind).alias("kind"))

    buys = entries.filter(c("entry_type") == "BUY")
    per_fill = buys.groupBy("fill_id").agg(F.count("*").alias("n"))
    per_decision = fills.groupBy("decision_id").agg(F.count("*").alias("fills"))
    shared = decisions.join(per_decision, "decision_id", "left").na.fill(0, ["fills"])
    parts = [
        found(per_fill.filter(c("fill_id").isNotNull() & (c("n") > 1)), c("fill_id"),
              "fill_booked_twice"),
        found(buys.filter(c("fill_id").isNull()), c("entry_id"), "entry_without_fill"),
        found(buys.filter(c("fill_id").isNotNull()).join(fills, "fill_id", "left_anti"),
              c("entry_id"), "entry_fill_missing"),
        found(fills.join(per_fill, "fill_id", "left_anti"), c("fill_id"), "fill_without_entry"),
        found(fills.join(decisions, "decision_id", "left_anti"), c("fill_id"),
              "fill_decision_missing"),
        found(decisions.join(signals, "signal_id", "left_anti"), c("decision_id"),
              "decision_signal_missing"),
        found(shared.filter((c("fills") > 1) | ((c("status") == "FILLED") != (c("fills") == 1))),
              c("decision_id"), "status_and_fills_differ"),
        found(decisions.groupBy("signal_id").agg(F.count("*").alias("n")).filter("n > 1"),
              c("signal_id"), "signal_decided_twice"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def entry_rules() -> dict[str, Column]:
    """Shape and conservation rules of booked entries joined to their fills; TRUE is a violation."""
    c = F.col
    kind = c("entry_type")
    buy = kind == "BUY"
    zero = lambda x: close_to(x, F.lit(0.0))
    nn = lambda x: F.coalesce(x, F.lit(True))
    return {
        "type_unknown": ~kind.isin("OPENING_CASH", "BUY", "DIVIDEND", "SPLIT", "REALIZED_LOSS"),
        "buy_values": buy & nn(
            (c("quantity") <= 0) | (c("price") <= 0) | (c("gross") <= 0) | (c("fee") < 0)
            | (c("fx_rate") <= 0)
        ),
        "buy_gross": buy & nn(~close_to(c("gross"), c("quantity") * c("price") * c("fx_rate"))),
        "buy_cash": buy & nn(~close_to(c("cash_delta"), -(c("gross") + c("fee")))),
        "buy_quantity": buy & nn(~close_to(c("quantity_delta"), c("quantity"))),
        "opening_shape": (kind == "OPENING_CASH")
        & ((c("cash_delta") <= 0) | c("instrument_id").isNotNull() | ~zero(c("quantity_delta"))),
        "dividend_shape": (kind == "DIVIDEND")
        & ((c("cash_delta") <= 0) | c("instrument_id").isNull() | ~zero(c("quantity_delta"))),
        "split_shape": (kind == "SPLIT") & (~zero(c("cash_delta")) | zero(c("quantity_delta"))),
        "loss_shape": (kind == "REALIZED_LOSS")
        & ((c("cash_delta") >= 0) | ~zero(c("quantity_delta"))),
    }


def fills_in_order(decisions: DataFrame, fills: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return fills.join(decisions, "decision_id").orderBy(*keys, "filled_at", "fill_id")
