"""Rights, calendar, concentration, output and display gates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import cutoff, minutes
from tidemark.functions.hashing import content_key
from tidemark.functions.scalars import r6
from tidemark.operators import gates, reports, validate
from tidemark.operators.crosssection import concentration_rules
from tidemark.plans import market, views
from tidemark.plans.registry import query
from tidemark.settings import DEFAULTS

UTC = timezone.utc
NOW = datetime(2001, 6, 1, tzinfo=UTC)
PURPOSES = {"display", "algorithm", "cache"}


def requests(t) -> DataFrame:
    """One request per order: provider, market and region asked for."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    region = F.element_at(
        F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MOON")]),
        (cust % 5 + 1).cast("int"),
    )
    return t.orders.select(
        key.alias("request_id"),
        F.concat(F.lit("prov"), (key % 7).cast("string")).alias("provider"),
        F.concat(F.lit("X"), F.substring(region, 1, 3)).alias("mic"),
        region.alias("region"),
    )


REQUEST_SQL = """
req AS (SELECT o_orderkey AS request_id, 'prov' || CAST(o_orderkey % 7 AS VARCHAR) AS provider,
          ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MOON'][CAST(o_custkey % 5 + 1 AS INT)] AS region
        FROM orders),
rq AS (SELECT req.*, 'X' || substr(region, 1, 3) AS mic FROM req)"""


@query(
    "license_gate", "B-08",
    "WITH " + REQUEST_SQL + """
    SELECT request_id, array_to_string(list_filter([
        CASE WHEN r.provider_code IS NULL THEN 'NOT_REGISTERED' END,
        CASE WHEN r.review_status <> 'APPROVED' THEN 'NOT_APPROVED' END,
        CASE WHEN r.expires_at <= TIMESTAMP '2001-06-01 00:00:00' THEN 'EXPIRED' END,
        CASE WHEN NOT r.non_display_algorithm_right THEN 'PURPOSE_DENIED:algorithm' END,
        CASE WHEN NOT r.training_right THEN 'PURPOSE_DENIED:training' END,
        CASE WHEN NOT list_contains(r.markets, q.mic) THEN 'MARKET_DENIED' END,
        CASE WHEN NOT list_contains(r.regions, q.region) THEN 'REGION_DENIED' END],
        lambda x: x IS NOT NULL), ',') AS reasons
    FROM rq q LEFT JOIN registry r ON r.provider_code = q.provider""",
    "registry",
)
def _license_gate(t):
    out = gates.authorize(
        requests(t), views.registry(t), {"display", "algorithm", "training"}, NOW,
        market="mic", region="region",
    )
    return out.select("request_id", F.array_join("license_reasons", ",").alias("reasons"))


@query(
    "licensed_universe", "B-18 C-11",
    """SELECT i.instrument_id, i.name, i.mic FROM instruments i JOIN registry r
         ON r.provider_code = i.provider WHERE r.review_status = 'APPROVED'
         AND r.expires_at > TIMESTAMP '2001-06-01 00:00:00' AND r.display_right AND r.cache_right
         AND list_contains(r.markets, i.mic) AND list_contains(r.regions, i.region)""",
    "instruments registry",
)
def _licensed_universe(t):
    return gates.licensed_rows(
        views.instruments(t), views.registry(t), {"display", "cache"}, NOW
    ).select("instrument_id", "name", "mic")


def weights(t) -> DataFrame:
    """Customers as portfolios over suppliers: value shares scaled to 90 percent of the book."""
    line = t.lineitem.select(
        (F.col("l_orderkey") % 50).alias("portfolio_id"), F.col("l_suppkey").alias("instrument_id"),
        F.col("l_quantity"),
    )
    held = line.groupBy("portfolio_id", "instrument_id").agg(F.sum("l_quantity").alias("q"))
    totals = line.groupBy("portfolio_id").agg(F.sum("l_quantity").alias("total"))
    return (
        held.join(totals, "portfolio_id").join(views.instruments(t), "instrument_id")
        .select("portfolio_id", "instrument_id", "asset_class", "industry", "region",
                (F.col("q") / F.col("total") * F.when(F.col("portfolio_id") % 2 == 0, 0.9)
                 .otherwise(0.75)).alias("weight"))
    )


WEIGHT_SQL = """
w AS (SELECT portfolio_id, instrument_id, asset_class, industry, region,
        q / sum(q) OVER (PARTITION BY portfolio_id)
          * (CASE WHEN portfolio_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END) AS weight
      FROM (SELECT l_orderkey % 50 AS portfolio_id, l_suppkey AS s, sum(l_quantity) AS q
            FROM lineitem GROUP BY 1, 2) x JOIN instruments i ON i.instrument_id = x.s),
br AS (SELECT portfolio_id, 'SINGLE_ETF_CAP:' || instrument_id AS rule, weight AS total FROM w
       WHERE weight > 0.10 + 1e-9
  UNION ALL SELECT portfolio_id, 'ASSET_CLASS_CAP:' || asset_class, sum(weight) FROM w
       GROUP BY portfolio_id, asset_class HAVING sum(weight) > 0.45 + 1e-9
  UNION ALL SELECT portfolio_id, 'INDUSTRY_CAP:' || industry, sum(weight) FROM w
       GROUP BY portfolio_id, industry HAVING sum(weight) > 0.30 + 1e-9
  UNION ALL SELECT portfolio_id, 'REGION_CAP:' || region, sum(weight) FROM w
       GROUP BY portfolio_id, region HAVING sum(weight) > 0.60 + 1e-9
  UNION ALL SELECT portfolio_id, 'CASH_FLOOR', sum(weight) FROM w
       GROUP BY portfolio_id HAVING sum(weight) > 0.80 + 1e-9)"""


@query(
    "concentration", "B-11",
    "WITH " + WEIGHT_SQL + " SELECT portfolio_id, rule, round(total, 6) AS total FROM br",
    "instruments",
)
def _concentration(t):
    return concentration_rules(weights(t), ["portfolio_id"], DEFAULTS).select(
        "portfolio_id", "rule", r6(F.col("total")).alias("total")
    )


# ------------------------------------------------------------------ calendar

def events(t) -> DataFrame:
    c = views.calendar(t)
    return c.withColumns(
        {
            "published_at": F.col("first_announced_at"),
            "available_at": F.col("first_seen_at") + minutes(5),
            "as_of": F.col("first_announced_at"),
            "ingested_at": F.col("first_seen_at") + minutes(6),
            "regions": F.array("region"),
            "quality_flags": F.array_compact(F.array("flag")),
            "data_mode": F.lit("DEMO_FIXTURE"),
            "raw_payload_hash": F.when(
                F.col("event_code") % 59 == 3, F.lit("short")
            ).otherwise(F.sha2(F.col("event_code").cast("string"), 256)),
            "source_uri": F.when(F.col("event_code") % 61 == 3, F.lit("ftp://x/")).otherwise(
                F.lit("https://calendar.example.org/")
            ),
            "alert_lead_hours": F.lit(48),
        }
    )


GATE_SQL = """
g AS (SELECT c.*, first_seen_at + INTERVAL '5' MINUTE AS available_at,
        first_seen_at + INTERVAL '6' MINUTE AS ingested_at FROM calendar c),
gr AS (SELECT g.*, list_filter([
   CASE WHEN status <> 'SCHEDULED' THEN 'EVENT_NOT_SCHEDULED' END,
   CASE WHEN NOT is_current THEN 'EVENT_REVISION_NOT_CURRENT' END,
   CASE WHEN first_announced_at > {now} THEN 'NOT_YET_PUBLICLY_ANNOUNCED' END,
   CASE WHEN first_announced_at > {now} THEN 'PUBLISHED_IN_FUTURE' END,
   CASE WHEN first_seen_at > {now} THEN 'NOT_YET_FIRST_SEEN' END,
   CASE WHEN available_at > {now} THEN 'NOT_YET_AVAILABLE' END,
   CASE WHEN first_announced_at > {now} THEN 'AS_OF_IN_FUTURE' END,
   CASE WHEN ingested_at > {now} THEN 'INGESTED_IN_FUTURE' END,
   CASE WHEN first_announced_at > scheduled_at THEN 'ANNOUNCEMENT_AFTER_EVENT' END,
   CASE WHEN first_announced_at > first_seen_at THEN 'FIRST_SEEN_BEFORE_ANNOUNCEMENT' END,
   CASE WHEN first_announced_at > first_seen_at THEN 'FIRST_SEEN_BEFORE_PUBLISHED' END,
   CASE WHEN first_announced_at > available_at THEN 'AVAILABLE_BEFORE_AS_OF' END,
   CASE WHEN event_time <> scheduled_at THEN 'EVENT_TIME_MISMATCH' END,
   CASE WHEN scheduled_at < {now} THEN 'EVENT_ALREADY_PASSED' END,
   CASE WHEN upper(license_scope) LIKE '%UNCLEAR%' THEN 'LICENSE_SCOPE_UNCLEAR' END,
   CASE WHEN flag = 'LICENSE_UNCLEAR' THEN 'EVENT_QUALITY_BLOCKED' END,
   CASE WHEN event_code % 59 = 3 THEN 'RAW_PAYLOAD_HASH_INVALID' END,
   CASE WHEN event_code % 61 = 3 THEN 'SOURCE_URL_INVALID' END,
   CASE WHEN r.review_status <> 'APPROVED' OR r.expires_at <= {now}
     OR NOT r.non_display_algorithm_right OR NOT list_contains(r.regions, g.region)
     THEN 'PROVIDER_LICENSE_BLOCKED' END], lambda x: x IS NOT NULL) AS reasons
  FROM g JOIN registry r ON r.provider_code = g.provider_code)""".replace(
    "{now}", "TIMESTAMP '2001-06-01 00:00:00'"
)


@query(
    "event_gate", "B-13",
    "WITH " + GATE_SQL + " SELECT event_code, array_to_string(reasons, ',') AS reasons FROM gr",
    "calendar registry",
)
def _event_gate(t):
    return gates.event_gate(events(t), views.registry(t), NOW).select(
        "event_code", F.array_join("gate_reasons", ",").alias("reasons")
    )


@query(
    "event_alerts", "K-08",
    "WITH " + GATE_SQL + """
    SELECT event_code, sha256('KNOWN_EVENT:' || provider_code || ':' || event_code || ':' || revision
        || ':' || strftime(scheduled_at, '%Y-%m-%d %H\\c%M\\c%S')) AS dedupe_key,
      round(date_diff('minute', TIMESTAMP '2001-06-01 00:00:00', scheduled_at) / 60.0, 6)
        AS hours_until
    FROM gr WHERE len(reasons) = 0
      AND scheduled_at BETWEEN TIMESTAMP '2001-06-01 00:00:00' AND TIMESTAMP '2001-06-03 00:00:00'
    """,
    "calendar registry",
)
def _event_alerts(t):
    gated = gates.event_gate(events(t), views.registry(t), NOW)
    return reports.upcoming_alerts(gated, NOW).select(
        "event_code", "dedupe_key", r6(F.col("hours_until")).alias("hours_until")
    )


_CALENDAR_RULES = {
    "event_time_not_scheduled": "event_time <> scheduled_at",
    "first_seen_before_announced": "first_announced_at > first_seen_at",
    "first_seen_before_published": "first_announced_at > first_seen_at",
    "available_before_first_seen": "first_seen_at > available_at",
    "available_before_as_of": "first_announced_at > available_at",
    "ingested_before_available": "available_at > ingested_at",
    "status_unknown": "status NOT IN ('SCHEDULED', 'CANCELLED', 'POSTPONED')",
}


@query(
    "calendar_contract", "B-14",
    "WITH g AS (SELECT c.*, first_seen_at + INTERVAL '5' MINUTE AS available_at, first_seen_at"
    " + INTERVAL '6' MINUTE AS ingested_at FROM calendar c) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {w}) AS violations FROM g"
        for n, w in _CALENDAR_RULES.items()
    ),
    "calendar",
)
def _calendar_contract(t):
    return validate.count_violations(events(t), validate.calendar_rules()).select(
        "rule", "violations"
    )


# ------------------------------------------------------------------ models

def models(t) -> DataFrame:
    """Parts as registered model versions, most of them in order, some not."""
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("model_id"),
        F.when(k % 13 == 1, None).when(k % 13 == 2, "Other").otherwise("RuleBasedV1")
        .alias("model_name"),
        F.lit("1.0.0").alias("version"),
        F.when(k % 7 == 3, "rule-features-v0").otherwise("rule-features-v1").alias("feature_version"),
        F.when(k % 5 == 2, "REJECTED").otherwise("EXPERIMENTAL").alias("status"),
        F.when(k % 11 == 4, None).otherwise("DEMO_FIXTURE_ONLY").alias("governance_scope"),
        F.when(k % 17 == 4, "OPEN").otherwise("BLOCKED").alias("real_data_candidate_gate"),
        F.when(k % 19 == 4, "DRIFT").otherwise("NOT_APPLICABLE_TO_FIXED_FIXTURE")
        .alias("drift_status"),
        F.when(k % 23 == 4, "DELAYED").otherwise("DEMO_FIXTURE").alias("data_mode"),
    )


@query(
    "model_governance", "B-15",
    """SELECT p_partkey AS model_id, CASE WHEN k % 13 = 1 THEN 'MODEL_VERSION_MISSING'
         WHEN k % 13 = 2 THEN 'MODEL_VERSION_UNEXPECTED' ELSE array_to_string(list_filter([
           CASE WHEN k % 7 = 3 THEN 'MODEL_FEATURE_VERSION_UNEXPECTED' END,
           CASE WHEN k % 5 = 2 THEN 'MODEL_STATUS_REJECTED' END,
           CASE WHEN k % 23 <> 4 AND k % 11 = 4 THEN 'MODEL_GOVERNANCE_SCOPE_INVALID' END,
           CASE WHEN k % 23 <> 4 AND k % 17 = 4 THEN 'MODEL_REAL_DATA_GATE_INVALID' END,
           CASE WHEN k % 23 <> 4 AND k % 19 = 4 THEN 'MODEL_DRIFT_GATE_FAILED' END,
           CASE WHEN k % 23 = 4 THEN 'REAL_DATA_MODEL_GATE_BLOCKED' END],
           lambda x: x IS NOT NULL), ',') END AS rules
       FROM (SELECT p_partkey, p_partkey AS k FROM part) p""",
)
def _model_governance(t):
    return models(t).select(
        "model_id", F.array_join(gates.model_rules(F.col("data_mode")), ",").alias("rules")
    )


# ------------------------------------------------------------------ signals as history

def signal_history(t) -> DataFrame:
    """Stored signals: every event is one signal of an instrument."""
    n = views.news(t)
    k = F.col("k")
    score = ((k * 7 + F.col("event_id") * 3) % 200).cast("double") / 100.0 - 1.0
    state = F.when(F.col("flagged"), "BLOCKED_BY_RISK").when(k % 13 == 0, "DATA_STALE").when(
        score >= 0.38, "ENTRY_CANDIDATE").when(score >= 0.14, "WATCH").when(
        score > -0.18, "NO_ACTION").when(score > -0.38, "REDUCE_CANDIDATE").otherwise(
        "EXIT_CANDIDATE")
    rules = F.when(
        F.col("flagged") & (k % 2 == 0),
        F.array(F.lit("SPREAD_TOO_WIDE_OR_UNKNOWN"), F.lit("DATA_QUALITY_GATE_BLOCKED"),
                F.lit("SINGLE_ETF_CAP:7")),
    ).when(F.col("flagged"), F.array(F.lit("PORTFOLIO_CASH_FLOOR"))).when(
        k % 29 == 0, F.array(F.lit("bad code"))).otherwise(F.array().cast("array<string>"))
    return n.select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("instrument_id"),
        F.col("event_time").alias("recorded_at"), state.alias("state"),
        score.alias("composite_score"), F.col("severity").alias("probability"),
        F.col("direction").alias("news_score"), F.col("relevance").alias("market_score"),
        ((k % 21).cast("double") / 10.0 - 1.0).alias("macro_score"),
        ((F.col("event_id") % 11).cast("double") / 10.0).alias("liquidity_score"),
        rules.alias("rules"), (F.col("event_id") % 6 != 5).alias("is_current"),
        F.when(k % 13 == 0, "STALE").otherwise("ON_TIME").alias("latency_status"),
        F.when(F.col("event_id") % 101 == 7, "DELAYED").otherwise("DEMO_FIXTURE").alias("data_mode"),
        (F.col("event_time") - minutes(10)).alias("data_as_of"),
        F.when(F.col("event_id") % 97 == 7, F.col("event_time") - minutes(20))
        .otherwise(F.col("event_time") - minutes(5)).alias("available_at"),
        F.concat(F.lit("src"), (k % 9).cast("string")).alias("source_link"),
        (k % 4).cast("string").alias("snapshot_id"),
    )


SIGNALS_SQL = """
sg0 AS (SELECT event_id AS signal_id, user_id AS instrument_id, event_time AS recorded_at, flagged,
    CAST((k * 7 + event_id * 3) % 200 AS DOUBLE) / 100.0::DOUBLE - 1.0::DOUBLE AS composite_score,
    severity AS probability, direction AS news_score, relevance AS market_score,
    CAST(k % 21 AS DOUBLE) / 10.0::DOUBLE - 1.0::DOUBLE AS macro_score,
    CAST(event_id % 11 AS DOUBLE) / 10.0::DOUBLE AS liquidity_score,
    event_id % 6 <> 5 AS is_current, CASE WHEN k % 13 = 0 THEN 'STALE' ELSE 'ON_TIME' END
      AS latency_status,
    CASE WHEN event_id % 101 = 7 THEN 'DELAYED' ELSE 'DEMO_FIXTURE' END AS data_mode,
    event_time - INTERVAL '10' MINUTE AS data_as_of,
    CASE WHEN event_id % 97 = 7 THEN event_time - INTERVAL '20' MINUTE
         ELSE event_time - INTERVAL '5' MINUTE END AS available_at, k,
    'src' || CAST(k % 9 AS VARCHAR) AS source_link, CAST(k % 4 AS VARCHAR) AS snapshot_id,
    CASE WHEN flagged AND k % 2 = 0 THEN ['SPREAD_TOO_WIDE_OR_UNKNOWN', 'DATA_QUALITY_GATE_BLOCKED',
           'SINGLE_ETF_CAP:7'] WHEN flagged THEN ['PORTFOLIO_CASH_FLOOR']
         WHEN k % 29 = 0 THEN ['bad code'] ELSE CAST([] AS VARCHAR[]) END AS rules FROM news),
sg AS (SELECT *, CASE WHEN flagged THEN 'BLOCKED_BY_RISK' WHEN k % 13 = 0 THEN 'DATA_STALE'
    WHEN composite_score >= 0.38 THEN 'ENTRY_CANDIDATE' WHEN composite_score >= 0.14 THEN 'WATCH'
    WHEN composite_score > -0.18 THEN 'NO_ACTION' WHEN composite_score > -0.38
    THEN 'REDUCE_CANDIDATE' ELSE 'EXIT_CANDIDATE' END AS state FROM sg0)"""


@query(
    "executable_signals", "B-17",
    "WITH " + SIGNALS_SQL + """
    SELECT signal_id, instrument_id FROM sg WHERE state = 'ENTRY_CANDIDATE' AND is_current
      AND latency_status = 'ON_TIME' AND data_mode = 'DEMO_FIXTURE' AND len(rules) = 0""",
    "news",
)
def _executable_signals(t):
    return signal_history(t).filter(gates.executable_signal()).select("signal_id", "instrument_id")


@query(
    "minimal_signals", "B-19",
    "WITH " + SIGNALS_SQL + """
    SELECT signal_id, state, array_to_string(list_sort(list_distinct(list_transform(rules,
        lambda x: split_part(x, ':', 1)))), ',') AS rule_codes,
      CASE WHEN data_mode <> 'DEMO_FIXTURE' THEN 'NON_DEMO_MODE_BLOCKED'
        WHEN NOT is_current OR latency_status <> 'ON_TIME' OR state = 'DATA_STALE'
          OR data_as_of > available_at OR list_contains(rules, 'bad code')
          OR (len(rules) > 0 AND state LIKE '%CANDIDATE%') THEN 'DATA_HEALTH_BLOCKED' END AS refused
    FROM sg""",
    "news",
)
def _minimal_signals(t):
    out = gates.minimal_signal(signal_history(t), datetime(2025, 1, 1, tzinfo=UTC))
    return out.select("signal_id", "state", F.array_join("rule_codes", ",").alias("rule_codes"),
                      "refused")


@query(
    "recent_signals", "G-03 G-05",
    "WITH " + SIGNALS_SQL + """
    SELECT signal_id, state, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS recorded_at FROM sg
    WHERE is_current ORDER BY sg.recorded_at DESC, signal_id LIMIT 20""",
    "news",
)
def _recent_signals(t):
    kept = reports.newest(signal_history(t).filter("is_current"), "recorded_at", "signal_id", 20)
    return kept.select("signal_id", "state", market.stamp("recorded_at"))


@query(
    "state_changes", "F-14",
    "WITH " + SIGNALS_SQL + """
    SELECT instrument_id, signal_id, state, coalesce(state <> lag(state) OVER (PARTITION BY
      instrument_id ORDER BY recorded_at, signal_id), TRUE) AS changed FROM sg""",
    "news",
)
def _state_changes(t):
    return reports.state_changes(signal_history(t)).select(
        "instrument_id", "signal_id", "state", "changed"
    )


@query(
    "signal_alerts", "K-07",
    "WITH " + SIGNALS_SQL + """,
    ch AS (SELECT *, coalesce(state <> lag(state) OVER (PARTITION BY instrument_id
        ORDER BY recorded_at, signal_id), TRUE) AS changed FROM sg)
    SELECT signal_id, 'DATA_HEALTH' AS alert_type, 'WARN' AS severity FROM ch
      WHERE state = 'DATA_STALE'
    UNION ALL SELECT signal_id, 'RISK_GATE', 'WARN' FROM ch WHERE state = 'BLOCKED_BY_RISK'
      AND NOT list_contains(rules, 'PORTFOLIO_CASH_FLOOR')
    UNION ALL SELECT signal_id, 'SIGNAL_STATE_CHANGE', 'INFO' FROM ch
      WHERE state LIKE '%CANDIDATE%' AND changed
    UNION ALL SELECT signal_id, 'NEWS_EXPOSURE', 'WARN' FROM ch
      WHERE state NOT IN ('DATA_STALE', 'BLOCKED_BY_RISK') AND abs(news_score) >= 0.70""",
    "news",
)
def _signal_alerts(t):
    return reports.signal_alerts(reports.state_changes(signal_history(t)), DEFAULTS).select(
        "signal_id", "alert_type", "severity"
    )


@query(
    "state_counts", "D-11 D-12",
    "WITH " + SIGNALS_SQL + """
    SELECT count(*) AS signals, count(*) FILTER (WHERE state LIKE '%CANDIDATE%') AS candidates,
      count(*) FILTER (WHERE state IN ('BLOCKED_BY_RISK', 'DATA_STALE')) AS blocked,
      count(*) FILTER (WHERE state = 'WATCH') AS watch,
      round(avg(market_score), 6) AS market_mean, round(avg(macro_score), 6) AS macro_mean,
      round(avg(news_score), 6) AS news_mean, round(avg(liquidity_score), 6) AS liquidity_mean
    FROM sg WHERE is_current""",
    "news",
)
def _state_counts(t):
    return reports.state_counts(signal_history(t).filter("is_current")).select(
        "signals", "candidates", "blocked", "watch",
        *[r6(F.col(f"{p}_mean")).alias(f"{p}_mean") for p in ("market", "macro", "news", "liquidity")],
    )


@query(
    "monitoring_report", "K-13 D-13 D-14",
    "WITH " + SIGNALS_SQL + """
    SELECT strftime(date_trunc('hour', recorded_at), '%Y-%m-%d %H:%M:%S') AS window_start,
      count(*) AS signals, count(*) FILTER (WHERE state IN ('BLOCKED_BY_RISK', 'DATA_STALE'))
        AS blocked, count(*) FILTER (WHERE state = 'WATCH') AS watch,
      count(*) FILTER (WHERE state LIKE '%CANDIDATE%') AS candidates,
      strftime(max(data_as_of), '%Y-%m-%d %H:%M:%S') AS market_data_as_of,
      count(DISTINCT source_link) AS sources,
      round(avg(market_score), 6) AS market_mean
    FROM sg WHERE is_current GROUP BY date_trunc('hour', recorded_at)""",
    "news",
)
def _monitoring_report(t):
    out = reports.monitoring(signal_history(t).filter("is_current"))
    return out.select(
        market.stamp("window_start"), "signals", "blocked", "watch", "candidates",
        market.stamp("market_data_as_of"), "sources",
        r6(F.col("market_mean")).alias("market_mean"),
    )


@query(
    "report_sources", "D-14",
    "WITH " + SIGNALS_SQL + """
    SELECT DISTINCT strftime(date_trunc('hour', recorded_at), '%Y-%m-%d %H:%M:%S') AS window_start,
      source_link, snapshot_id FROM sg WHERE is_current""",
    "news",
)
def _report_sources(t):
    out = reports.report_sources(signal_history(t).filter("is_current"))
    return out.select(market.stamp("window_start"), "source_link", "snapshot_id")


@query(
    "monitoring_contract", "B-23",
    "WITH " + SIGNALS_SQL + """,
    rp AS (SELECT date_trunc('hour', recorded_at) AS checked_at, count(*) AS signals,
        count(*) FILTER (WHERE state IN ('BLOCKED_BY_RISK', 'DATA_STALE')) AS blocked,
        count(*) FILTER (WHERE state = 'WATCH') AS watch,
        count(*) FILTER (WHERE state LIKE '%CANDIDATE%') AS candidates FROM sg WHERE is_current
        GROUP BY 1)
    SELECT strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at,
      CASE WHEN blocked + watch + candidates > signals THEN 'counts'
           WHEN hour(checked_at) % 8 = 7 THEN 'clock' END AS violation,
      hour(checked_at) % 8 <> 7 AND blocked <= 6 AND hour(checked_at) % 5 <> 2 AS healthy,
      CASE WHEN hour(checked_at) % 8 <> 7 AND blocked <= 6 AND hour(checked_at) % 5 <> 2
           THEN signals END AS shown_signals
    FROM rp""",
    "news",
)
def _monitoring_contract(t):
    out = reports.monitoring(signal_history(t).filter("is_current")).withColumnRenamed(
        "window_start", "checked_at"
    )
    hour = F.hour("checked_at")
    out = out.withColumns(
        {
            "next_check_at": F.col("checked_at")
            + F.when(hour % 8 == 7, minutes(180)).otherwise(minutes(60)),
            "last_scheduled_at": F.col("checked_at")
            - F.when(hour % 5 == 2, minutes(90)).otherwise(minutes(30)),
            "blocked_reason": F.when(F.col("blocked") > 6, "RISK_GATE"),
            "schedule_status": F.lit("CURRENT"),
            "market_data_as_of": F.least("market_data_as_of", "checked_at"),
        }
    )
    checked = reports.report_contract(out, F.col("checked_at"), interval_hours=1)
    return checked.select(
        market.stamp("checked_at"), "violation", "healthy",
        F.when(F.col("healthy"), F.col("signals")).alias("shown_signals"),
    )


@query(
    "result_display", "B-25 B-24 C-12",
    """SELECT p_partkey AS model_id,
         CASE WHEN p_partkey % 6 = 1 THEN 'MODEL_ARTIFACT_INTEGRITY_BLOCKED'
              WHEN p_partkey % 6 = 2 THEN 'PROVIDER_LICENSE_BLOCKED' END AS display_blocked_reason,
         CASE WHEN p_partkey % 6 = 1 THEN 'ARTIFACT_INTEGRITY_BLOCKED_HISTORICAL_AUDIT_ONLY'
              WHEN p_partkey % 6 = 2 THEN 'LICENSE_BLOCKED_HISTORICAL_AUDIT_ONLY'
              ELSE 'EXPERIMENTAL' END AS status,
         CASE WHEN p_partkey % 6 NOT IN (1, 2) AND p_retailprice / 2000 <= 1
              THEN round(p_retailprice / 2000, 6) END AS brier_score
       FROM part""",
)
def _result_display(t):
    c = F.col
    k = c("p_partkey")
    results = t.part.select(
        k.alias("model_id"), F.lit("EXPERIMENTAL").alias("status"),
        F.create_map(F.lit("brier_score"), c("p_retailprice") / 2000,
                     F.lit("note"), F.lit(7.0)).alias("metrics"),
    )
    reason = F.when(c("model_id") % 6 == 1, "MODEL_ARTIFACT_INTEGRITY_BLOCKED").when(
        c("model_id") % 6 == 2, "PROVIDER_LICENSE_BLOCKED"
    )
    status = F.when(reason == "MODEL_ARTIFACT_INTEGRITY_BLOCKED",
                    "ARTIFACT_INTEGRITY_BLOCKED_HISTORICAL_AUDIT_ONLY").otherwise(
        "LICENSE_BLOCKED_HISTORICAL_AUDIT_ONLY")
    shown = gates.display_view(results, reason, ["metrics"], status)
    return reports.bounded_metrics(shown).select(
        "model_id", "display_blocked_reason", "status",
        r6(c("metrics")["brier_score"]).alias("brier_score"),
    )


@query(
    "alert_dedupe", "K-06 K-09",
    "WITH " + SIGNALS_SQL + """
    SELECT sha256(state || ':' || instrument_id || ':' || CAST(k % 3 AS VARCHAR)) AS dedupe_key,
           min(signal_id) AS signal_id, count(*) AS merged
    FROM sg GROUP BY 1""",
    "news",
)
def _alert_dedupe(t):
    s = signal_history(t).join(
        views.news(t).select(F.col("event_id").alias("signal_id"), (F.col("k") % 3).alias("h")),
        "signal_id",
    )
    keyed = s.withColumn("dedupe_key", content_key(F.col("state"), F.col("instrument_id"), F.col("h")))
    return reports.first_per_key(keyed, "dedupe_key", "signal_id")
