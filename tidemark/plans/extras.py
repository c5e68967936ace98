"""Smaller reads: eligible news, range checks, lists, evidence and cost."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import minutes
from tidemark.functions.scalars import r6
from tidemark.functions.text import normalize_url
from tidemark.operators import backtest, gates, integrity, ledger, model, news, reports, validate
from tidemark.operators.ordered import PART, ordinals, range_buckets
from tidemark.plans import gating, ledgers, market, views
from tidemark.plans.registry import query

UTC = timezone.utc
AT = datetime(2024, 1, 25, tzinfo=UTC)


def news_records(t) -> DataFrame:
    """Events as complete news records, part of them broken in one way each."""
    n = views.news(t)
    e, at = F.col("event_id"), F.col("event_time")
    uri = F.when(e % 53 == 1, F.lit("ftp://feed.example.org/")).otherwise(
        F.concat(F.lit("https://feed.example.org/a?utm_source=x&id="), e.cast("string"))
    )
    url = normalize_url(uri)
    title = F.concat(F.lit("Title "), e.cast("string"))
    cluster = F.substring(F.sha2(F.lower(title), 256), 1, 24)
    return n.select(
        "event_id", "event_time",
        F.when(e % 47 == 1, None).when(e % 43 == 1, at + minutes(90)).otherwise(at)
        .alias("published_at"),
        F.when(e % 41 == 1, at - minutes(1)).otherwise(at + minutes(1)).alias("first_seen_at"),
        "available_at", at.alias("as_of"),
        F.when(e % 37 == 1, "").otherwise("SCOPE_A").alias("license_scope"),
        F.when(e % 31 == 1, "DELAYED").otherwise("DEMO_FIXTURE").alias("data_mode"),
        uri.alias("source_uri"), url.alias("normalized_url"), title.alias("title"),
        cluster.alias("cluster_key"),
        F.when(e % 29 == 1, "x").otherwise(gates.news_dedupe_hash(url, title, cluster))
        .alias("dedupe_hash"),
        F.when(e % 23 == 1, "zz").otherwise(F.sha2(title, 256)).alias("raw_payload_hash"),
        F.when(F.col("flagged"), F.array(F.lit("LICENSE_UNCLEAR")))
        .otherwise(F.array().cast("array<string>")).alias("quality_flags"),
        F.array(F.lit("entity")).alias("entities"),
        F.when(e % 19 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
        .alias("exposures"),
        F.concat(F.lit("prov"), (F.col("k") % 6).cast("string")).alias("provider"),
    )


@query(
    "eligible_news", "B-12 G-10",
    """SELECT event_id, 'https://feed.example.org/a?id=' || event_id AS normalized_url
       FROM news n JOIN registry r ON r.provider_code = 'prov' || CAST(k % 6 AS VARCHAR)
       WHERE available_at <= TIMESTAMP '2024-01-25 00:00:00' AND event_id % 53 <> 1
         AND (event_id % 47 = 1 OR event_id % 43 <> 1) AND event_id % 41 <> 1
         AND event_id % 37 <> 1 AND event_id % 31 <> 1 AND event_id % 29 <> 1 AND event_id % 23 <> 1
         AND event_id % 19 <> 1 AND NOT flagged AND review_status = 'APPROVED'
         AND expires_at > TIMESTAMP '2001-01-01 00:00:00' AND non_display_algorithm_right""",
    "news registry",
)
def _eligible_news(t):
    out = gates.eligible_news(
        news_records(t), views.registry(t), AT, "DEMO_FIXTURE",
        licence_at=datetime(2001, 1, 1, tzinfo=UTC),
    )
    return out.select("event_id", "normalized_url")


@query(
    "range_contract", "B-20",
    " UNION ALL ".join(
        f"SELECT '{c}_out_of_range' AS rule, count(*) FILTER (WHERE {c} IS NULL OR {c} < {a} OR {c} > {b})"
        " AS violations FROM (SELECT value / 100 AS relevance, value / 50 - 2 AS direction,"
        " value / 200 AS severity, value / 300 AS novelty, 0.5 AS source_grade FROM events) e"
        for c, (a, b) in validate.NEWS_BOUNDS.items()
    ),
)
def _range_contract(t):
    v = F.col("value")
    rows = t.events.select(
        (v / 100).alias("relevance"), (v / 50 - 2).alias("direction"), (v / 200).alias("severity"),
        (v / 300).alias("novelty"), F.lit(0.5).alias("source_grade"),
    )
    return validate.count_violations(rows, validate.range_rules(validate.NEWS_BOUNDS)).select(
        "rule", "violations"
    )


@query(
    "benchmark_join", "C-01",
    "WITH bench AS (" + market.BENCH_SQL + """)
    SELECT b.instrument_id, count(*) AS bars, round(avg(total_return_close
        / benchmark_total_return_close), 6) AS relative FROM bars b JOIN bench
      ON bench.event_time = b.event_time WHERE b.available_at <= b.event_time + INTERVAL '30' MINUTE
      GROUP BY 1""",
    "bars",
)
def _benchmark_join(t):
    known, bench = model.universe_benchmark(market.staged_bars(t))
    validate.assert_unique(known, ["instrument_id", "event_time"])
    validate.assert_unique(bench, ["event_time"])
    return known.join(bench, "event_time").groupBy("instrument_id").agg(
        F.count("*").alias("bars"),
        r6(F.avg(F.col("total_return_close") / F.col("benchmark_total_return_close")))
        .alias("relative"),
    )


@query(
    "ranked_candidates", "G-06",
    "WITH " + gating.SIGNALS_SQL + """
    SELECT snapshot_id, signal_id, row_number() OVER (PARTITION BY snapshot_id
        ORDER BY composite_score DESC, signal_id) AS place FROM sg WHERE state LIKE '%CANDIDATE%'""",
    "news",
)
def _ranked_candidates(t):
    s = gating.signal_history(t).filter(F.col("state").contains("CANDIDATE")).withColumn(
        "down", -F.col("composite_score")
    )
    order = ["down", "signal_id"]
    slim = range_buckets(s.select("snapshot_id", *order), ["snapshot_id", *order])
    return ordinals(slim, ["snapshot_id"], order, F.col(PART), "place").select(
        "snapshot_id", "signal_id", "place"
    )


@query(
    "newest_alerts", "G-10 G-02",
    "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100",
)
def _newest_alerts(t):
    return reports.newest(t.events, "ts", "event_id", 100, most=200).select("event_id", "event_type")


@query(
    "current_mode", "G-11",
    "SELECT arg_max(CASE WHEN k % 2 = 0 THEN 'DELAYED' ELSE 'HISTORICAL' END, event_id) AS data_mode"
    " FROM news",
    "news",
)
def _current_mode(t):
    rows = views.news(t).select(
        "event_id", F.when(F.col("k") % 2 == 0, "DELAYED").otherwise("HISTORICAL").alias("data_mode")
    )
    return reports.latest_value(rows, "data_mode", "event_id", "DEMO_FIXTURE")


@query(
    "news_links", "D-14",
    """SELECT 'REGION' AS type, r_name AS value, count(*) AS links FROM news JOIN region
         ON r_regionkey = region_key WHERE NOT flagged AND available_at - INTERVAL '8275' DAY
         <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY 2
       UNION ALL SELECT 'ASSET_CLASS', 'AC' || CAST((k + 1) % 5 AS VARCHAR), count(*) FROM news
         WHERE NOT flagged AND available_at - INTERVAL '8275' DAY <= TIMESTAMP '2001-06-01 00:00:00'
         GROUP BY 2""",
    "news",
)
def _news_links(t):
    return news.news_links(market.exposed_news(t), market.AT)


@query(
    "system_alerts", "K-09",
    """SELECT DISTINCT sha256('SYSTEM:monitor\\c' || event_type || '\\c' || user_id) AS dedupe_key FROM events
       WHERE event_type = 'error'""",
)
def _system_alerts(t):
    failed = t.events.filter(F.col("event_type") == "error")
    scope = F.concat_ws(":", F.lit("monitor"), "event_type", F.col("user_id").cast("string"))
    return reports.system_alert(failed, scope).select("dedupe_key")


@query(
    "evidence_totals", "I-12",
    "WITH " + ledgers.BOOK_SQL + """
    SELECT 'ledger' AS table_name, count(*) AS rows, round(sum(cash_delta), 4) AS total,
      count(*) FILTER (WHERE entry_type = 'DIVIDEND' AND cash_delta <= 0) AS invalid FROM book
    UNION ALL SELECT 'macro', count(*), round(sum(value), 4), count(*) FILTER (WHERE available_at
      < event_time) FROM macro
    UNION ALL SELECT 'news', count(*), round(sum(severity), 4), count(*) FILTER (WHERE flagged) FROM news
    """,
    "ledger macro news",
)
def _evidence_totals(t):
    def line(name, df, total, invalid):
        return df.agg(
            F.count("*").alias("rows"), (F.round(F.sum(total), 4) + F.lit(0.0)).alias("total"),
            F.count_if(invalid).alias("invalid"),
        ).select(F.lit(name).alias("table_name"), "rows", "total", "invalid")

    c = F.col
    return (
        line("ledger", ledgers.book(t), "cash_delta",
             (c("entry_type") == "DIVIDEND") & (c("cash_delta") <= 0))
        .unionByName(line("macro", views.macro(t), "value", c("available_at") < c("event_time")))
        .unionByName(line("news", views.news(t), "severity", c("flagged")))
    )


@query(
    "cost_model", "J-05",
    """SELECT event_id, round(value / 1000 - (k % 10) / 10.0::DOUBLE * (2.5 + 3.0 + 10.0 / 2)
         / 10000::DOUBLE, 6) AS net FROM news JOIN (SELECT event_id AS e, value FROM events) v
       ON v.e = event_id""",
    "news",
)
def _cost_model(t):
    rows = views.news(t).select("event_id", "k").join(t.events.select("event_id", "value"), "event_id")
    turnover = (F.col("k") % 10).cast("double") / 10.0
    return rows.select(
        "event_id",
        r6(backtest.net_of_cost(F.col("value") / 1000, turnover, 2.5, 3.0, 10.0)).alias("net"),
    )


@query(
    "metric_replay", "I-11",
    """SELECT portfolio_id FROM ledger WHERE portfolio_id % 30 = 7 GROUP BY 1""",
    "ledger",
)
def _metric_replay(t):
    now = ledger.cash_and_fees(views.ledger(t)).select("portfolio_id", "cash", "total_fees")
    stored = now.withColumn(
        "cash", F.when(F.col("portfolio_id") % 30 == 7, F.col("cash") + 1e-3).otherwise(F.col("cash"))
    )
    # Sums may differ in their last bits between runs, hence a tolerance.
    return integrity.metric_differences(
        stored, now, ["portfolio_id"], ["cash", "total_fees"], 1e-6
    ).select("portfolio_id")
