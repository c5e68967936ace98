"""The gates on tables with missing values, where each must refuse; a back-fill and a report order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import point_in_time_slice
from tidemark.operators import gates, reports, validate
from tidemark.plans import views
from tidemark.plans.gating import NOW, REQUEST_SQL, events, requests
from tidemark.plans.market import CUT, stamp
from tidemark.plans.registry import query
from tidemark.sources import snapshots


@query(
    "null_rights_gate", "B-08",
    "WITH " + REQUEST_SQL + """,
    reg AS (SELECT * REPLACE (
        CASE WHEN provider_code <> 'prov0' THEN review_status END AS review_status,
        CASE WHEN provider_code <> 'prov1' THEN non_display_algorithm_right END AS non_display_algorithm_right,
        CASE WHEN provider_code <> 'prov2' THEN expires_at END AS expires_at,
        CASE WHEN provider_code <> 'prov4' THEN regions END AS regions) FROM registry)
    SELECT request_id, array_to_string(list_filter([
        CASE WHEN r.provider_code IS NULL THEN 'NOT_REGISTERED' END,
        CASE WHEN r.provider_code IS NOT NULL AND r.review_status IS DISTINCT FROM 'APPROVED' THEN 'NOT_APPROVED' END,
        CASE WHEN r.expires_at <= TIMESTAMP '2001-06-01 00:00:00' THEN 'EXPIRED' END,
        CASE WHEN r.provider_code IS NOT NULL AND r.non_display_algorithm_right IS DISTINCT FROM TRUE
          THEN 'PURPOSE_DENIED:algorithm' END,
        CASE WHEN r.provider_code IS NOT NULL AND coalesce(NOT list_contains(r.markets, q.mic), TRUE) THEN 'MARKET_DENIED' END,
        CASE WHEN r.provider_code IS NOT NULL AND coalesce(NOT list_contains(r.regions, q.region), TRUE) THEN 'REGION_DENIED' END],
        lambda x: x IS NOT NULL), ',') AS reasons
    FROM rq q LEFT JOIN reg r ON r.provider_code = q.provider""",
    "registry",
)
def _null_rights_gate(t):
    code = F.col("provider_code")
    registry = views.registry(t).withColumns({
        "review_status": F.when(code != "prov0", F.col("review_status")),
        "non_display_algorithm_right": F.when(code != "prov1", F.col("non_display_algorithm_right")),
        "expires_at": F.when(code != "prov2", F.col("expires_at")),
        "regions": F.when(code != "prov4", F.col("regions")),
    })
    out = gates.authorize(requests(t), registry, {"algorithm"}, NOW, market="mic", region="region")
    return out.select("request_id", F.array_join("license_reasons", ",").alias("reasons"))


@query(
    "null_mode_risk", "B-10",
    """SELECT instrument_id, count(*) AS bar_count,
         count(*) FILTER (WHERE instrument_id % 3 = 0 AND month(event_time) = 5) AS missing_modes,
         bool_or(instrument_id % 3 = 0 AND month(event_time) = 5) AS mode_unknown
       FROM facts GROUP BY instrument_id""",
    "facts",
)
def _null_mode_risk(t):
    gone = (F.col("instrument_id") % 3 == 0) & (F.month("event_time") == 5)
    rows = views.facts(t).withColumns({
        "data_mode": F.when(~gone, F.lit("DEMO_FIXTURE")), "bid_ask_spread_bps": F.lit(1.0),
    })
    return gates.bar_summary(rows).select(
        "instrument_id", "bar_count", F.col("data_mode_nulls").alias("missing_modes"), "mode_unknown"
    )


@query(
    "null_clock_refused", "B-02 K-12",
    """SELECT instrument_id, count(*) AS rows_known FROM facts
       WHERE greatest(event_time, published_at, first_seen_at, available_at, as_of)
             <= TIMESTAMP '1998-06-01 00:00:00' AND day(event_time) NOT IN (5, 6)
       GROUP BY instrument_id""",
    "facts",
)
def _null_clock_refused(t):
    day = F.dayofmonth("event_time")
    rows = views.facts(t).withColumns({
        "available_at": F.when(day != 5, F.col("available_at")), "as_of": F.when(day != 6, F.col("as_of")),
    })
    return point_in_time_slice(rows, CUT, strict=False).groupBy("instrument_id").agg(F.count("*").alias("rows_known"))


_RULES = {
    "event_time_not_scheduled": "event_time IS DISTINCT FROM scheduled_at",
    "first_seen_before_announced": "coalesce(first_announced_at > first_seen_at, TRUE)",
    "first_seen_before_published": "coalesce(published_at > first_seen_at, FALSE)",
    "available_before_first_seen": "coalesce(first_seen_at > available_at, TRUE)",
    "available_before_as_of": "coalesce(as_of > available_at, TRUE)",
    "ingested_before_available": "coalesce(available_at > ingested_at, TRUE)",
    "status_unknown": "coalesce(status NOT IN ('SCHEDULED', 'CANCELLED', 'POSTPONED'), TRUE)",
}


@query(
    "null_calendar_contract", "B-14",
    """WITH g AS (SELECT * REPLACE (
           CASE WHEN day(scheduled_at) <> 3 THEN event_time END AS event_time,
           CASE WHEN day(scheduled_at) <> 4 THEN status END AS status,
           CASE WHEN day(scheduled_at) <> 5 THEN available_at END AS available_at,
           CASE WHEN day(scheduled_at) <> 6 THEN published_at END AS published_at)
         FROM (SELECT c.*, first_announced_at AS published_at, first_announced_at AS as_of,
                 first_seen_at + INTERVAL '5' MINUTE AS available_at,
                 first_seen_at + INTERVAL '6' MINUTE AS ingested_at FROM calendar c)) """
    + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {w}) AS violations FROM g" for n, w in _RULES.items()),
    "calendar",
)
def _null_calendar_contract(t):
    day = F.dayofmonth("scheduled_at")
    rows = events(t).withColumns({
        "event_time": F.when(day != 3, F.col("event_time")), "status": F.when(day != 4, F.col("status")),
        "available_at": F.when(day != 5, F.col("available_at")), "published_at": F.when(day != 6, F.col("published_at")),
    })
    return validate.count_violations(rows, validate.calendar_rules()).select("rule", "violations")


@query(
    "backfill_signals", "A-16",
    """SELECT event_id AS signal_id,
         strftime(CASE WHEN event_id % 3 <> 0 THEN ts ELSE ts + INTERVAL '1' HOUR END, '%Y-%m-%d %H:%M:%S') AS recorded_at,
         CASE WHEN event_id % 4 = 0 THEN TRUE ELSE event_id % 2 = 0 END AS is_current
       FROM events""",
)
def _backfill_signals(t):
    key, at = F.col("event_id"), F.col("ts").cast("timestamp")
    old = t.events.select(
        key.alias("signal_id"), at.alias("seen_at"), F.when(key % 3 != 0, at).alias("recorded_at"),
        F.when(key % 4 != 0, key % 2 == 0).alias("is_current"),
    )
    out = snapshots.backfill_signals(old, F.col("seen_at") + F.expr("make_dt_interval(0, 1)"))
    return out.select("signal_id", stamp("recorded_at"), "is_current")


@query(
    "report_order", "G-09",
    """WITH s AS (SELECT s_suppkey AS signal_id, s_name AS name, s_acctbal AS composite_score,
           abs(s_acctbal) / 20000 AS probability FROM supplier),
       o AS (SELECT signal_id, row_number() OVER (ORDER BY composite_score DESC, signal_id) AS a,
           row_number() OVER (ORDER BY probability DESC, signal_id) AS b,
           row_number() OVER (ORDER BY name, signal_id) AS c, row_number() OVER (ORDER BY signal_id) AS d FROM s)
       SELECT 'score-desc' AS chosen, signal_id, a AS position FROM o
       UNION ALL SELECT 'probability-desc', signal_id, b FROM o
       UNION ALL SELECT 'name-asc', signal_id, c FROM o UNION ALL SELECT 'default', signal_id, d FROM o""",
)
def _report_order(t):
    rows = t.supplier.select(
        F.col("s_suppkey").alias("signal_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("composite_score"),
        (F.abs("s_acctbal") / 20000).alias("probability"),
    )
    orders = [
        reports.positions(rows, by, "signal_id").select(F.lit(by).alias("chosen"), "signal_id", "position")
        for by in ("score-desc", "probability-desc", "name-asc", "default")
    ]
    return reduce(DataFrame.unionByName, orders)


@query(
    "news_append", "A-06",
    """WITH d AS (SELECT sha256(lang || ':' || lower(text)) AS dedupe_hash, sha256(lang) AS record_hash,
           doc_id % 2 = 0 AS stored FROM documents)
       SELECT dedupe_hash, record_hash, count(*) FILTER (WHERE stored) AS stored,
         CASE WHEN bool_or(stored) THEN 0 ELSE 1 END AS appended
       FROM d GROUP BY 1, 2""",
)
def _news_append(t):
    rows = t.documents.select(
        "doc_id", F.sha2(F.concat_ws(":", "lang", F.lower("text")), 256).alias("dedupe_hash"),
        F.sha2("lang", 256).alias("record_hash"),
    )
    stored = rows.filter(F.col("doc_id") % 2 == 0).drop("doc_id").withColumn("was", F.lit(1))
    offered = rows.filter(F.col("doc_id") % 2 != 0).drop("doc_id").withColumn("was", F.lit(0))
    out = snapshots.apply_upsert(stored, offered, ["dedupe_hash"])
    return out.groupBy("dedupe_hash", "record_hash").agg(
        F.count_if(F.col("was") == 1).alias("stored"), F.sum(1 - F.col("was")).cast("int").alias("appended")
    )


@query(
    "training_lookup", "C-12",
    """WITH m AS (SELECT p_partkey AS model_id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0
           THEN 'x' || p_brand ELSE sha256(p_brand) END AS training_hash FROM part),
       s AS (SELECT sha256(p_brand) AS sha256, p_brand AS snapshot FROM part GROUP BY p_brand HAVING min(p_size) <= 2)
       SELECT model_id, snapshot, CASE WHEN coalesce(NOT regexp_matches(lower(training_hash), '^[0-9a-f]{64}$'), TRUE)
         THEN 'HASH_INVALID' WHEN s.sha256 IS NULL THEN 'NOT_FOUND' END AS lookup
       FROM m LEFT JOIN s ON s.sha256 = m.training_hash""",
)
def _training_lookup(t):
    key, brand = F.col("p_partkey"), F.col("p_brand")
    models = t.part.select(
        key.alias("model_id"),
        F.when(key % 11 == 0, None).when(key % 7 == 0, F.concat(F.lit("x"), brand)).otherwise(F.sha2(brand, 256))
        .alias("training_hash"),
    )
    stored = t.part.groupBy(brand.alias("snapshot")).agg(F.min("p_size").alias("least")).filter("least <= 2")
    stored = stored.withColumn("sha256", F.sha2("snapshot", 256))
    return gates.lookup_by_hash(models, "training_hash", stored, ["snapshot"], "lookup").drop("training_hash")
