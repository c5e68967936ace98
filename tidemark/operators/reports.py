"""Report projections, alert derivation and small bounded reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import cutoff, minutes
from tidemark.functions.hashing import content_key
from tidemark.operators.ordered import Running, ordinals, running
from tidemark.session import cut_lineage
from tidemark.settings import CANDIDATE_STATES

BLOCKED_STATES = ("BLOCKED_BY_RISK", "DATA_STALE")


def newest(df: DataFrame, time: str, tie: str, n: int, most: int = 20) -> DataFrame:
    """The ``n`` newest rows; bounds are checked before anything is read."""
    if not 1 <= n <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return df.orderBy(F.col(time).desc(), F.col(tie)).limit(n)


def latest_value(df: DataFrame, value: str, time: str, default: str) -> DataFrame:
    """Value of the newest row, or a default for an empty input."""
    return df.agg(F.coalesce(F.max_by(value, time), F.lit(default)).alias(value))


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Batch form of duplicate suppression: the first row per key and how many it stands for."""
    return df.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("merged"))


def state_changes(signals: DataFrame) -> DataFrame:
    """Whether the state differs from the instrument's previous signal (or is its first)."""
    day = F.unix_date(F.to_date("recorded_at"))
    out = running(
        signals, ["instrument_id"], ["recorded_at", "signal_id"], day,
        {"previous_state": Running("last", F.col("state"), exclusive=True)},
    )
    changed = F.coalesce(F.col("state") != F.col("previous_state"), F.lit(True))
    return out.withColumn("changed", changed)


def signal_alerts(signals: DataFrame, limits) -> DataFrame:
    """Alerts a signal gives rise to; stale and blocked signals raise at most one each."""
    c = F.col
    stale, blocked = c("state") == "DATA_STALE", c("state") == "BLOCKED_BY_RISK"
    from_portfolio = F.exists("rules", lambda r: r.startswith("PORTFOLIO_"))
    normal = ~stale & ~blocked

    def alert(cond: Column, kind: str, severity: str) -> Column:
        return F.when(
            cond, F.struct(F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"))
        )

    raised = F.array_compact(
        F.array(
            alert(stale, "DATA_HEALTH", "WARN"),
            alert(blocked & ~from_portfolio, "RISK_GATE", "WARN"),
            alert(normal & c("state").isin(*CANDIDATE_STATES) & c("changed"),
                  "SIGNAL_STATE_CHANGE", "INFO"),
            alert(normal & (F.abs("news_score") >= limits.news_threshold), "NEWS_EXPOSURE", "WARN"),
        )
    )
    return signals.select("*", F.inline(raised))


def upcoming_alerts(gated: DataFrame, now: datetime) -> DataFrame:
    """Passed calendar events inside their lead time, with a key that makes the alert unique."""
    at = cutoff(now, "utc")
    hours = (F.unix_micros("scheduled_at") - F.unix_micros(at)) / 3.6e9
    return (
        gated.filter(F.size("gate_reasons") == 0)
        .withColumn("hours_until", hours)
        .filter((F.col("hours_until") >= 0) & (F.col("hours_until") <= F.col("alert_lead_hours")))
        .withColumn(
            "dedupe_key",
            content_key(F.lit("KNOWN_EVENT"), F.col("provider_code"), F.col("event_code"),
                        F.col("revision"), F.date_format("scheduled_at", "yyyy-MM-dd HH:mm:ss")),
        )
    )


def system_alert(df: DataFrame, scope: Column, kind: str = "SYSTEM_HEALTH") -> DataFrame:
    """Operational alert keyed by a constant scope, so a repeated check raises it once."""
    prefix = "SYSTEM" if kind == "SYSTEM_HEALTH" else kind
    return df.withColumns(
        {"alert_type": F.lit(kind), "dedupe_key": content_key(F.lit(prefix), scope)}
    ).dropDuplicates(["dedupe_key"])


def _counts() -> list[Column]:
    state = F.col("state")
    return [
        F.count("*").alias("signals"),
        F.count_if(state.contains("CANDIDATE")).alias("candidates"),
        F.count_if(state.isin(*BLOCKED_STATES)).alias("blocked"),
        F.count_if(state == "WATCH").alias("watch"),
    ]


def state_counts(signals: DataFrame) -> DataFrame:
    return signals.agg(
        *_counts(),
        *[F.avg(f"{part}_score").alias(f"{part}_mean") for part in ("market", "macro", "news", "liquidity")],
    )


def monitoring(signals: DataFrame, every: str = "1 hour") -> DataFrame:
    """Counts, means, freshness and sources per check window."""
    return (
        signals.groupBy(F.window("recorded_at", every).alias("_w"))
        .agg(
            *_counts(),
            F.avg("market_score").alias("market_mean"),
            F.max("data_as_of").alias("market_data_as_of"),
            F.count_distinct("source_link").alias("sources"),
        )
        .withColumn("window_start", F.col("_w.start"))
        .drop("_w")
    )


def report_sources(signals: DataFrame, every: str = "1 hour") -> DataFrame:
    """Distinct sources per check window, one row each: a busy window may have any number."""
    window = F.window("recorded_at", every)["start"]
    return signals.select(window.alias("window_start"), "source_link", "snapshot_id").distinct()


def report_contract(df: DataFrame, now: Column, interval_hours: int) -> DataFrame:
    """First broken rule of a monitoring report, and whether its counts may be shown."""
    c = F.col
    violation = (
        F.when(c("blocked") + c("watch") + c("candidates") > c("signals"), "counts")
        .when(~c("schedule_status").isin("CURRENT", "NOT_RUN", "OVERDUE", "FAILED"), "schedule")
        .when(~((c("checked_at") < c("next_check_at"))
                & (c("next_check_at") <= c("checked_at") + minutes(121))), "clock")
        .when(c("market_data_as_of") > c("checked_at"), "cutoff")
    )
    healthy = (
        violation.isNull() & (c("schedule_status") == "CURRENT") & c("blocked_reason").isNull()
        & c("market_data_as_of").isNotNull()
        & (now - c("last_scheduled_at") <= minutes(interval_hours * 60 + 5))
    )
    return df.withColumns({"violation": violation, "healthy": F.coalesce(healthy, F.lit(False))})


METRIC_BOUNDS = {
    "brier_score": (0, 1), "baseline_brier_score": (0, 1), "expected_calibration_error": (0, 1),
    "horizon_days": (1, 252), "samples": (1, 100_000_000),
}


def bounded_metrics(df: DataFrame, column: str = "metrics") -> DataFrame:
    """Only known metrics inside their bounds leave; ``refused`` names the others, sorted."""

    def inside(k: Column, v: Column) -> Column:
        tests = [(k == n) & v.between(a, b) for n, (a, b) in METRIC_BOUNDS.items()]
        out = tests[0]
        for test in tests[1:]:
            out = out | test
        return out

    kept = F.map_filter(column, inside)
    refused = F.array_sort(F.array_except(F.map_keys(column), F.map_keys(kept)))
    return df.withColumn("refused", refused).withColumn(column, kept)


def envelope(df: DataFrame, data_mode: str, disclaimer: str) -> DataFrame:
    """Constant columns every outward result carries."""
    return df.withColumns({"data_mode": F.lit(data_mode), "disclaimer": F.lit(disclaimer)})


def search(df: DataFrame, haystack: Column, text: str, state: str | None = None) -> DataFrame:
    """Case-insensitive substring search combined with an exact state."""
    wanted = text.strip().lower()
    out = df if not wanted else df.filter(F.lower(haystack).contains(wanted))
    return out if not state else out.filter(F.col("state") == state)


def arrange(df: DataFrame, by: str, tie: str) -> DataFrame:
    """Selectable report order: score, probability (both descending), name, or the default."""
    order = {
        "score-desc": [F.col("composite_score").desc()],
        "probability-desc": [F.col("probability").desc()],
        "name-asc": [F.collate(F.col("name"), "zh")],
    }.get(by, [])
    return df.orderBy(*order, F.col(tie))


def positions(df: DataFrame, by: str, tie: str) -> DataFrame:
    """Every row with its ``position`` in the chosen order, from the sort's own ranges."""
    placed = cut_lineage(arrange(df, by, tie).withColumn("_at", F.monotonically_increasing_id()))
    return ordinals(placed, [], ["_at"], F.shiftright("_at", 33), "position").drop("_at")
