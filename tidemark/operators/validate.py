"""Row contracts: named rules counted in one pass, with an optional failing mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import ALL_CLOCKS
from tidemark.functions.scalars import is_finite
from tidemark.settings import DATA_MODES

FACT_COLUMNS = (
    "provider", "source_uri", *ALL_CLOCKS, "revision", "timezone", "currency", "latency_class",
    "license_scope", "data_mode", "quality_flags", "raw_payload_hash",
)


class ContractError(ValueError):
    """Data breaks its declared contract; nothing downstream may run."""


def missing_columns(df: DataFrame, required=FACT_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def fact_rules(df: DataFrame) -> dict[str, Column]:
    """Row rules of a fact table, in the order they are reported; TRUE marks a violation."""
    c = F.col
    rules = {"data_mode_unknown": c("data_mode").isNotNull() & ~c("data_mode").isin(*DATA_MODES)}
    rules |= {f"{name}_missing": c(name).isNull() for name in ALL_CLOCKS}
    rules |= {
        "available_before_event": c("available_at") < c("event_time"),
        "first_seen_before_event": c("first_seen_at") < c("event_time"),
        "available_before_published": c("available_at") < c("published_at"),
        "available_before_first_seen": c("available_at") < c("first_seen_at"),
        "available_before_as_of": c("available_at") < c("as_of"),
        "ingested_before_available": c("ingested_at") < c("available_at"),
    }
    prices = ["open", "high", "low", "close"]
    if {*prices, "volume"} <= set(df.columns):
        bad = [~is_finite(c(p)) for p in [*prices, "volume"]]
        rules |= {
            "ohlcv_not_finite": reduce(lambda a, b: a | b, bad),
            "ohlc_not_positive": reduce(lambda a, b: a | b, [c(p) <= 0 for p in prices]),
            "volume_negative": c("volume") < 0,
            "price_range_invalid": (c("low") > F.least("open", "close"))
            | (c("high") < F.greatest("open", "close"))
            | (c("low") > c("high")),
        }
    return rules


def calendar_rules() -> dict[str, Column]:
    """A missing value breaks the rules on it, but for ``published_at``, which is optional."""
    c = F.col
    needed = {
        "event_time_not_scheduled": c("event_time") != c("scheduled_at"),
        "first_seen_before_announced": c("first_announced_at") > c("first_seen_at"),
        "available_before_first_seen": c("first_seen_at") > c("available_at"),
        "available_before_as_of": c("as_of") > c("available_at"),
        "ingested_before_available": c("available_at") > c("ingested_at"),
        "status_unknown": ~c("status").isin("SCHEDULED", "CANCELLED", "POSTPONED"),
    }
    rules = {name: F.coalesce(rule, F.lit(True)) for name, rule in needed.items()}
    late = F.coalesce(c("published_at") > c("first_seen_at"), F.lit(False))
    return rules | {"first_seen_before_published": late}


def range_rules(bounds: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Values must be finite and inside their closed interval."""
    return {
        f"{name}_out_of_range": ~is_finite(F.col(name)) | ~F.col(name).between(low, high)
        for name, (low, high) in bounds.items()
    }


NEWS_BOUNDS = {
    "relevance": (0, 1), "direction": (-1, 1), "severity": (0, 1), "novelty": (0, 1),
    "source_grade": (0, 1),
}
SIGNAL_BOUNDS = {
    "probability": (0, 1), "confidence": (0, 1), "liquidity_score": (0, 1),
    "market_score": (-1, 1), "macro_score": (-1, 1), "news_score": (-1, 1),
    "composite_score": (-1, 1),
}


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) from one aggregation over the rows."""
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.lit(n).alias("rule"),
                             F.col(n).alias("violations"))
                    for i, n in enumerate(rules)
                ]
            )
        )
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def validate_facts(df: DataFrame) -> DataFrame:
    """Every fact rule with its count; duplicate identities count once per surplus row."""
    identity = ["instrument_id", "event_time", "revision"]
    rules = count_violations(df, fact_rules(df))
    report = [rules]
    if set(identity) <= set(df.columns):
        report.append(
            duplicates(df, identity)
            .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("violations"))
            .select(F.lit(98).alias("position"), F.lit("identity_duplicated").alias("rule"),
                    "violations")
        )
    report.append(
        df.agg((F.count("*") == 0).cast("bigint").alias("violations")).select(
            F.lit(99).alias("position"), F.lit("empty").alias("rule"), "violations"
        )
    )
    return reduce(DataFrame.unionByName, report)


def require_valid(report: DataFrame) -> None:
    """Raise on the first violated rule of a report."""
    first = report.filter("violations > 0").orderBy("position").limit(1).collect()
    if first:
        raise ContractError(f"{first[0].rule}: {first[0].violations} rows")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if duplicates(df, keys).limit(1).count():
        raise ContractError(f"duplicate keys {keys}")


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join after both sides have proven their key unique."""
    assert_unique(left, on)
    assert_unique(right, on)
    return left.join(right, on)


def lineage_report(df: DataFrame, keys: list[str], expected: dict[str, Column]) -> DataFrame:
    """Per key: does every row carry exactly the expected provider, scope and mode."""
    return df.groupBy(*keys).agg(
        *[
            F.coalesce(F.bool_and(F.col(c).eqNullSafe(want)), F.lit(False)).alias(f"{c}_ok")
            for c, want in expected.items()
        ]
    )
