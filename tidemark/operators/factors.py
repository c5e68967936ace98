"""Rule-based factor vectors, scores and signal records per instrument at one decision time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, finite, logistic, signal_state
from tidemark.operators.crosssection import exact_median
from tidemark.operators.ordered import last_rows, latest_version

HISTORY = 253
YEAR = math.sqrt(252)

FACTOR_NAMES = (
    "momentum_1m", "momentum_3m", "momentum_6m", "momentum_12m", "sma_50", "sma_200", "trend",
    "trend_strength", "annualized_volatility", "downside_volatility", "max_drawdown",
    "relative_strength", "median_notional_63d", "volume_ratio", "bid_ask_spread_bps",
    "expense_ratio", "nav_premium_bps", "tracking_error", "quality_score",
)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def recent_history(bars: DataFrame) -> DataFrame:
    """At most 253 latest bars per instrument; the cut runs before the shuffle."""
    slim = bars.select(
        "instrument_id",
        "event_time",
        F.col("total_return_close").cast("double").alias("p"),
        (F.col("close") * F.col("volume")).alias("notional"),
        "volume",
        *[
            _optional(bars, c).alias(c)
            for c in ("bid_ask_spread_bps", "expense_ratio", "nav_premium_bps", "tracking_error")
        ],
    )
    recent = last_rows(slim, ["instrument_id"], [F.col("event_time").desc()], HISTORY)
    older = Window.partitionBy("instrument_id").orderBy(F.col("_rank").desc())
    peak = older.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return recent.withColumn("ret", F.col("p") / F.lag("p").over(older) - 1).withColumn(
        "fall",
        F.when(F.col("_rank") <= 252,
               F.col("p") / F.max(F.when(F.col("_rank") <= 252, F.col("p"))).over(peak) - 1),
    )


def factor_vector(bars: DataFrame) -> DataFrame:
    """One row per instrument; factors are NULL when fewer than 253 bars are known."""
    r = F.col("_rank")

    def at(rank: int, c: str = "p") -> Column:
        return F.max(F.when(r == rank, F.col(c)))

    def change(periods: int) -> Column:
        base = at(periods + 1)
        return F.when(base > 0, at(1) / base - 1).otherwise(F.lit(0.0))

    def upto(n: int, c: str) -> Column:
        return F.when(r <= n, F.col(c))

    fallen = F.when((r <= 63) & (F.col("ret") < 0), F.col("ret"))
    wide = (
        recent_history(bars)
        .groupBy("instrument_id")
        .agg(
            F.count("*").alias("bars_used"),
            *[change(n).alias(f"momentum_{m}m") for n, m in ((21, 1), (63, 3), (126, 6), (252, 12))],
            at(1).alias("price"),
            F.avg(upto(50, "p")).alias("sma_50"),
            F.avg(upto(200, "p")).alias("sma_200"),
            F.stddev_samp(upto(126, "ret")).alias("sd126"),
            (F.stddev_samp(upto(63, "ret")) * YEAR).alias("annualized_volatility"),
            F.when(F.count(fallen) > 1, F.stddev_samp(fallen) * YEAR)
            .otherwise(0.0)
            .alias("downside_volatility"),
            F.min("fall").alias("max_drawdown"),
            F.percentile(upto(63, "notional"), F.lit(0.5)).alias("median_notional_63d"),
            (at(1, "volume") / F.greatest(F.percentile(upto(63, "volume"), F.lit(0.5)), F.lit(1.0)))
            .alias("volume_ratio"),
            finite(at(1, "bid_ask_spread_bps"), 50.0).alias("bid_ask_spread_bps"),
            finite(at(1, "expense_ratio"), 0.01).alias("expense_ratio"),
            F.abs(finite(at(1, "nav_premium_bps"), 25.0)).alias("nav_premium_bps"),
            finite(at(1, "tracking_error"), 0.03).alias("tracking_error"),
        )
    )
    trend = F.when(F.col("sma_200") > 0, F.col("price") / F.col("sma_200") - 1).otherwise(0.0)
    return wide.withColumns(
        {
            "trend": trend,
            "trend_strength": (F.col("sma_50") / F.col("sma_200") - 1)
            / F.greatest(F.col("sd126"), F.lit(1e-6)),
            "enough_history": F.col("bars_used") >= HISTORY,
        }
    )


def universe_median_return(vector: DataFrame) -> DataFrame:
    """Median of six-month returns across the universe (short histories count as zero)."""
    return exact_median(vector, [], "momentum_6m", "instrument_id", "universe_return")


def macro_score(macro: DataFrame) -> DataFrame:
    """Mean of the latest known vintage of each series, each clipped to [-1, 1]."""
    latest = latest_version(macro, ["series_code"])
    value = F.col("value")
    safe = F.when(
        value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")),
        F.raise_error(F.lit("macro fact is not finite")).cast("double"),
    ).otherwise(value)
    return latest.agg(
        F.avg(F.least(F.greatest(safe, F.lit(-1.0)), F.lit(1.0))).alias("macro_score"),
        F.count("*").alias("series"),
    )


def scores(
    vector: DataFrame, universe_return: Column, news_score: Column, macro: Column,
    news_weight_cap: float = 0.15,
) -> DataFrame:
    """Sub-scores and the composite; ``macro`` may be NULL, which re-weights the rest."""
    c = F.col
    momentum = (
        clip(0.15 * c("momentum_1m") + 0.25 * c("momentum_3m") + 0.30 * c("momentum_6m")
             + 0.30 * c("momentum_12m"), -0.35, 0.35) / 0.35
    )
    scored = vector.withColumns(
        {
            "relative_strength": c("momentum_6m") - universe_return,
            "momentum_score": momentum,
            "trend_score": clip(
                0.7 * F.tanh(c("trend") * 10) + 0.3 * F.tanh(c("trend_strength") / 4)
            ),
            "risk_score": clip(-(c("annualized_volatility") / 0.35) + c("max_drawdown") / 0.25),
            "liquidity_score": clip(
                0.45 * F.tanh(F.log10(F.greatest(c("median_notional_63d"), F.lit(1.0))) - 6)
                + 0.25 * F.tanh(c("volume_ratio") - 1)
                + 0.30 * (1 - F.least(c("bid_ask_spread_bps") / 25, F.lit(1.0))),
                0, 1,
            ),
            "quality_score": clip(
                1 - F.least(c("expense_ratio") / 0.02, F.lit(1.0)) * 0.35
                - F.least(c("nav_premium_bps") / 50, F.lit(1.0)) * 0.30
                - F.least(c("tracking_error") / 0.05, F.lit(1.0)) * 0.35,
                0, 1,
            ),
            "news_score": F.coalesce(news_score, F.lit(0.0)),
            "macro_available": macro.isNotNull(),
            "macro_score": clip(F.coalesce(macro, F.lit(0.0))),
        }
    ).withColumn("relative_score", clip(c("relative_strength") / 0.20))
    scored = scored.withColumn(
        "market_score",
        clip(0.45 * c("momentum_score") + 0.25 * c("trend_score") + 0.20 * c("relative_score")
             + 0.10 * c("risk_score")),
    )
    news_weight = min(max(news_weight_cap, 0.0), 0.15)
    base = (
        0.56 * c("market_score") + 0.20 * (c("liquidity_score") * 2 - 1)
        + 0.10 * (c("quality_score") * 2 - 1)
    )
    rest = F.when(c("macro_available"), (base + 0.14 * c("macro_score")) / (0.56 + 0.20 + 0.10 + 0.14)
                  ).otherwise(base / (0.56 + 0.20 + 0.10))
    return scored.withColumn(
        "composite_score", clip((1 - news_weight) * rest + news_weight * c("news_score"))
    )


def evidence(scored: DataFrame) -> DataFrame:
    """Split evidence items into supporting (value >= 0) and opposing ones, with two extra flags."""
    c = F.col

    def item(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("factor"), value.alias("value"))

    items = F.array_compact(
        F.array(
            item("medium_momentum", c("momentum_6m")),
            item("trend", c("trend")),
            item("liquidity", c("liquidity_score")),
            F.when(c("macro_available"), item("macro_state", c("macro_score"))),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(c("annualized_volatility") > 0.30,
                   item("high_volatility", -c("annualized_volatility"))),
            F.when(c("max_drawdown") < -0.20, item("drawdown", c("max_drawdown"))),
        )
    )
    return scored.withColumns(
        {
            "supporting": F.filter(items, lambda x: x["value"] >= 0),
            "opposing": F.concat(F.filter(items, lambda x: x["value"] < 0), warnings),
        }
    )


def signal_record(df: DataFrame, limits) -> DataFrame:
    """State, probability, confidence and risk budget from scores and the risk assessment.

    Expects the columns of :func:`scores`, ``bar_count``, ``rules`` and ``stale``.
    """
    c = F.col
    rules = F.when(
        ~c("enough_history"), F.concat(c("rules"), F.array(F.lit("INSUFFICIENT_HISTORY")))
    ).otherwise(c("rules"))
    df = df.withColumn("rules", rules).withColumn(
        "composite_score", F.when(c("enough_history"), c("composite_score")).otherwise(0.0)
    )
    blocked = F.size("rules") > 0
    confidence = F.greatest(
        F.lit(0.05),
        F.least(F.lit(0.90), 0.45 + c("bar_count") / 2000 - F.size("rules") * 0.12),
    )
    volatility = F.when(c("enough_history"), c("annualized_volatility")).otherwise(F.lit(1.0))
    budget = F.least(
        F.lit(limits.single_cap),
        F.lit(limits.volatility_target) / F.greatest(volatility, F.lit(0.05)) / 20,
    )
    df = df.withColumns(
        {
            "state": F.when(c("stale"), "DATA_STALE")
            .when(blocked, "BLOCKED_BY_RISK")
            .otherwise(signal_state(c("composite_score"))),
            "probability": logistic(c("composite_score")),
            "confidence": confidence,
            "risk_budget_max": F.when(blocked, 0.0).otherwise(budget),
        }
    )
    half = 0.18 + (1 - c("confidence")) * 0.12
    return df.withColumns(
        {
            "risk_budget_min": c("risk_budget_max") * 0.5,
            "probability_low": F.greatest(F.lit(0.0), c("probability") - half),
            "probability_high": F.least(F.lit(1.0), c("probability") + half),
            "latency_status": F.when(c("stale"), "STALE").otherwise("ON_TIME"),
        }
    )
