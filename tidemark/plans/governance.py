"""Output health and governance re-check: gates replayed on the versions known at each time.

Desks are customers, their research runs orders, their signals the latest line per desk and instrument. What the
signals rest on (instrument master, rights, models, macro facts, news) is kept in versions, so that what
held at the decision can be looked up beside what holds later. The fixture's text runs on both engines.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import row_hash
from tidemark.functions.scalars import r6
from tidemark.operators import gates, governance, integrity, ledger
from tidemark.operators.governance import Check
from tidemark.plans import gating, ledgers, views
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

UTC = timezone.utc
AT = datetime(2001, 6, 1, tzinfo=UTC)
NOW = "TIMESTAMP '2001-06-01 00:00:00'"
START = "TIMESTAMP '1990-01-01 00:00:00'"
PURPOSES = {"display", "algorithm", "derivative", "cache"}
SETTINGS = "limits-1|code-1"

FIXTURE = {
    "desks": "SELECT c_custkey AS desk_id, c_custkey % 53 = 0 AS kill_switch FROM {customer}",
    "runs": """
        SELECT o_custkey AS desk_id, o_orderkey AS run_id, CAST(o_orderdate AS TIMESTAMP) AS started_at,
          CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 5 > 1 THEN 'SUCCEEDED' WHEN o_orderkey % 5 = 0
            THEN 'FAILED' ELSE 'RUNNING' END AS status
        FROM {orders} WHERE o_orderkey % 3 = 0""",
    "signals": f"""
        SELECT desk_id * 1000000 + supp AS signal_id, desk_id, CASE WHEN part % 89 = 5 THEN -1 - supp ELSE supp
            END AS instrument_id, part, decided_at,
          decided_at + INTERVAL '1' DAY * CAST(part % 700 AS INT) AS executed_at,
          (desk_id * 7 + supp) % 6 = 0 AS is_current,
          'bars-' || CAST(CASE WHEN part % 101 = 9 THEN (desk_id + 1) % 24 ELSE desk_id % 24 END AS STRING)
            AS snapshot_id,
          CASE WHEN part % 61 = 7 THEN 99 WHEN part % 11 = 0 THEN part % 25 ELSE part % 10 END AS model_id,
          CASE WHEN part % 97 = 3 THEN 'HISTORICAL' ELSE 'DEMO_FIXTURE' END AS data_mode,
          CASE WHEN part % 53 = 1 THEN NULL WHEN part % 59 = 1 THEN 'BROKEN'
               WHEN part % 3 = 0 THEN 'UNAVAILABLE_REWEIGHTED' ELSE 'AVAILABLE' END AS macro_status,
          CASE WHEN part % 67 = 1 THEN NULL ELSE 'macro-' || CAST(year(decided_at) AS STRING) END AS macro_id,
          CASE WHEN part % 5 = 0 THEN 'WATCH' ELSE 'ENTRY_CANDIDATE' END AS state,
          CASE WHEN part % 71 = 2 THEN 'LATE' ELSE 'ON_TIME' END AS latency_status,
          CAST(part % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS probability, part % 43 = 11 AS edited,
          part % 79 = 4 AS other_policy
        FROM (SELECT o_custkey AS desk_id, l_suppkey AS supp, l_partkey AS part,
                CAST(l_shipdate AS TIMESTAMP) AS decided_at,
                row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY l_shipdate DESC,
                  l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS newest
              FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
              WHERE l_shipdate <= {NOW}) lines
        WHERE newest = 1""",
    "models": f"""
        SELECT model_id, model_name, version, feature_version, status, governance_scope,
          'BLOCKED' AS real_data_candidate_gate, 'NOT_APPLICABLE_TO_FIXED_FIXTURE' AS drift_status,
          approved_by, valid_from, valid_to
        FROM (SELECT n_nationkey AS model_id, 'RuleBasedV1' AS model_name,
                CASE WHEN n_nationkey = 13 THEN '0.9.0' ELSE '1.0.0' END AS version,
                CASE WHEN n_nationkey = 17 THEN 'rule-features-v0' ELSE 'rule-features-v1' END AS feature_version,
                'EXPERIMENTAL' AS status, 'nobody' AS approved_by,
                CASE WHEN n_nationkey = 21 THEN 'ANY' ELSE 'DEMO_FIXTURE_ONLY' END AS governance_scope,
                {START} AS valid_from,
                CASE WHEN n_nationkey = 19 THEN TIMESTAMP '2000-01-01 00:00:00' WHEN n_nationkey = 21
                  THEN TIMESTAMP '1998-07-01 00:00:00' WHEN n_nationkey = 4
                  THEN TIMESTAMP '1997-02-01 00:00:00' ELSE CAST(NULL AS TIMESTAMP) END AS valid_to FROM {{nation}}
              UNION ALL
              SELECT n_nationkey, 'RuleBasedV1', '1.0.0', 'rule-features-v1',
                CASE WHEN n_nationkey = 19 THEN 'REJECTED' ELSE 'EXPERIMENTAL' END,
                CASE WHEN n_nationkey = 4 THEN 'board' ELSE 'nobody' END, 'DEMO_FIXTURE_ONLY',
                CASE WHEN n_nationkey = 19 THEN TIMESTAMP '2000-01-01 00:00:00' WHEN n_nationkey = 21
                  THEN TIMESTAMP '1998-07-01 00:00:00' ELSE TIMESTAMP '1997-02-01 00:00:00' END,
                CAST(NULL AS TIMESTAMP)
              FROM {{nation}} WHERE n_nationkey IN (4, 19, 21)) m""",
    "master": f"""
        SELECT s_suppkey AS instrument_id, r_name AS region, n_name AS industry, 'X' || substr(r_name, 1, 3) AS mic,
          'prov' || CAST(s_suppkey % 4 AS STRING) AS provider,
          CASE WHEN s_suppkey % 29 = 3 THEN TRUE ELSE FALSE END AS leveraged, FALSE AS inverse,
          later = 0 OR s_suppkey % 16 <> 0 AS active, CAST(1 + s_suppkey % 2 + 2 * later AS INT) AS liquidity_tier,
          CASE WHEN later = 1 THEN turned ELSE {START} END AS valid_from,
          CASE WHEN later = 0 THEN turned ELSE CAST(NULL AS TIMESTAMP) END AS valid_to
        FROM (SELECT s.*, later, CASE WHEN s_suppkey % 8 = 0 THEN TIMESTAMP '1997-09-01 00:00:00'
                WHEN s_suppkey % 8 = 2 THEN TIMESTAMP '1996-05-01 00:00:00' END AS turned
              FROM {{supplier}} s, (SELECT 0 AS later UNION ALL SELECT 1) v) x
        JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
        WHERE later = 0 OR turned IS NOT NULL""",
    "rights": f"""
        SELECT 'prov' || CAST(r_regionkey AS STRING) AS provider_code, 'APPROVED' AS review_status,
          TIMESTAMP '2031-01-01 00:00:00' AS expires_at, TRUE AS display_right,
          TRUE AS non_display_algorithm_right, TRUE AS derivative_right, TRUE AS cache_right,
          r_regionkey = 2 AND later = 1 AS training_right, FALSE AS redistribution_right,
          array('XAFR', 'XAME', 'XASI', 'XEUR', 'XMID') AS markets,
          CASE WHEN later = 1 AND r_regionkey = 3 THEN array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')
            ELSE array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') END AS regions,
          CASE WHEN later = 1 THEN turned ELSE {START} END AS valid_from,
          CASE WHEN later = 0 THEN turned ELSE CAST(NULL AS TIMESTAMP) END AS valid_to
        FROM (SELECT r.*, later, CASE WHEN r_regionkey = 3 THEN TIMESTAMP '1999-01-01 00:00:00'
                WHEN r_regionkey = 2 THEN TIMESTAMP '1998-03-01 00:00:00' END AS turned
              FROM {{region}} r, (SELECT 0 AS later UNION ALL SELECT 1) v) x
        WHERE later = 0 OR turned IS NOT NULL""",
    "macro_rows": f"""
        SELECT 'macro-' || CAST(year(o_orderdate) AS STRING) AS macro_id, o_orderpriority AS series_code,
          CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS event_time, max(o_orderkey % 400) AS value,
          o_orderstatus AS revision,
          max(CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) % 4 = 0 THEN TIMESTAMP '1998-10-01 00:00:00'
            ELSE {START} END) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to
        FROM {{orders}} GROUP BY year(o_orderdate), o_orderpriority, date_trunc('month', o_orderdate), o_orderstatus""",
    "news_items": f"""
        SELECT 'bars-' || CAST(user_id % 24 AS STRING) AS snapshot_id, event_id, event_type, value + later AS value,
          CASE WHEN later = 1 THEN TIMESTAMP '1998-06-01 00:00:00' ELSE {START} END AS valid_from,
          CASE WHEN later = 0 AND again THEN TIMESTAMP '1998-06-01 00:00:00' ELSE CAST(NULL AS TIMESTAMP) END
            AS valid_to
        FROM (SELECT e.*, later, user_id % 24 IN (2, 14) AND event_id % 7 = 3 AS again
              FROM {{events}} e, (SELECT 0 AS later UNION ALL SELECT 1) v) x
        WHERE later = 0 OR again""",
    "contents": """
        SELECT 'bars-' || CAST(l_suppkey % 24 AS STRING) AS snapshot_id, l_suppkey AS instrument_id,
          CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS event_time, max(l_partkey) AS value, count(*) AS lines
        FROM {lineitem} WHERE l_suppkey % 24 <> 20 GROUP BY l_suppkey, date_trunc('month', l_shipdate)""",
    "snapshots": """
        SELECT 'bars-' || CAST(k AS STRING) AS snapshot_id, 'prov' || CAST(k % 4 AS STRING) AS provider_code,
          CASE WHEN k = 17 THEN 'MACRO_FACTS' ELSE 'MARKET_BARS' END AS dataset_type,
          CASE WHEN k = 11 THEN 'SCOPE_UNCLEAR' ELSE 'SCOPE_A' END AS license_scope, 'DEMO_FIXTURE' AS data_mode
        FROM (SELECT DISTINCT c_custkey % 24 AS k FROM {customer}) x WHERE k <> 23""",
}
TABLES = ("customer", "orders", "lineitem", "nation", "supplier", "region", "events")


def fixture(t, name: str) -> DataFrame:
    text = FIXTURE[name]
    used = {n: getattr(t, n) for n in TABLES if "{" + n + "}" in text}
    return next(iter(used.values())).sparkSession.sql(text, **used)


def _sql(name: str) -> str:
    text = FIXTURE[name].format(**{n: n for n in TABLES}).replace("AS STRING", "AS VARCHAR")
    return f"{name}_f AS ({text.replace('array(', 'list_value(')})"


FIXTURE_SQL = ",\n".join(_sql(n) for n in FIXTURE)

SEALED = ["signal_id", "desk_id", "instrument_id", "decided_at", "snapshot_id", "model_id", "data_mode",
          "macro_status", "macro_id", "state", "latency_status", "probability"]
MASTER = ["instrument_id", "region", "industry", "mic", "leveraged", "inverse", "active", "liquidity_tier"]
RIGHTS = ["review_status", "expires_at", "display_right", "non_display_algorithm_right", "derivative_right",
          "cache_right", "training_right", "redistribution_right", "markets", "regions"]
MODEL = ["model_name", "version", "feature_version", "status", "governance_scope", "real_data_candidate_gate",
         "drift_status", "approved_by"]


class Rests:
    """What signals rest on: version tables, and their digests along time."""

    def __init__(self, t):
        self.t = t
        self.master, self.rights, self.models = (fixture(t, n) for n in ("master", "rights", "models"))
        macro, news = fixture(t, "macro_rows"), fixture(t, "news_items")
        history = governance.digest_history
        self.histories = {
            # name: (history, column of the signal -> key of the history)
            "master": (history(self.master, ["provider"], MASTER), {"provider_code": "provider"}),
            "rights": (history(self.rights, ["provider_code"], RIGHTS), {"provider_code": "provider_code"}),
            "model": (history(self.models, ["model_id"], MODEL), {"model_id": "model_id"}),
            "macro": (history(macro, ["macro_id"], ["series_code", "event_time", "value", "revision"]),
                      {"macro_used": "macro_id"}),
            "news": (history(news, ["snapshot_id"], ["event_id", "event_type", "value"]),
                     {"snapshot_id": "snapshot_id"}),
        }
        self.histories = {n: (cut_lineage(h), k) for n, (h, k) in self.histories.items()}
        # Registered once, before one month of one snapshot was altered.
        registered = fixture(t, "contents")
        altered = (F.col("snapshot_id") == "bars-5") & (F.year("event_time") == 1997)
        self.contents = registered.withColumn("value", F.col("value") + F.when(altered, 1).otherwise(0))
        columns = ["instrument_id", "event_time", "value", "lines"]
        stored = integrity.tree_hash(registered, ["snapshot_id"], row_hash(registered, columns), "sha256")
        self.snapshots = cut_lineage(
            governance.verified_contents(
                fixture(t, "snapshots").join(stored, "snapshot_id", "left")
                .withColumn("row_count", F.coalesce("items", F.lit(0)).cast("bigint")).drop("items"),
                self.contents, columns,
            )
        )

    def signals(self) -> DataFrame:
        """Sealed signals; some edited after that."""
        sealed = integrity.seal(fixture(self.t, "signals"), SEALED)
        known = self.snapshots.select("snapshot_id", F.col("provider_code"))
        macro = F.when(F.col("macro_status") == "AVAILABLE", F.col("macro_id"))
        return sealed.withColumn(
            "probability", F.col("probability") + F.when(F.col("edited"), 1).otherwise(0)
        ).withColumn("macro_used", macro).join(known, "snapshot_id", "left")

    def parts(self, rows: DataFrame, **at: str) -> DataFrame:
        """Digests of all parts at several times, as ``<part>_<name>``. ``rows`` is a stored table."""
        stored = rows
        for part, (history, keys) in self.histories.items():
            rows = governance.digest_at(rows, history, keys, {c: f"{part}_{n}" for n, c in at.items()}, stored)
        return rows

    def policy(self, suffix: str):
        parts = [F.col(f"{n}_{suffix}") for n in self.histories]
        return governance.policy_text([F.col("snapshot_id"), F.col("data_mode"), *parts, F.lit(SETTINGS)])


# ---------------------------------------------------------------- B-21

HEALTH_SQL = FIXTURE_SQL + f""",
last_run AS (SELECT desk_id, arg_max(status, (started_at, run_id)) AS status FROM runs_f GROUP BY 1),
d1 AS (SELECT d.desk_id, CASE WHEN kill_switch THEN 'GLOBAL_KILL_SWITCH' WHEN status IS NULL THEN 'PIPELINE_NOT_RUN'
    WHEN status <> 'SUCCEEDED' THEN 'PIPELINE_' || status END AS reason
  FROM desks_f d LEFT JOIN last_run r ON r.desk_id = d.desk_id),
cur AS (SELECT * FROM signals_f WHERE is_current),
d2 AS (SELECT desk_id, CASE WHEN desk_id NOT IN (SELECT desk_id FROM cur) THEN 'NO_CURRENT_SIGNALS' END AS reason
  FROM desks_f),
changed AS (SELECT c.*,
    m.model_id IS NULL AS no_model, CASE WHEN m.version <> '1.0.0' THEN 'MODEL_VERSION_UNEXPECTED' ELSE
      array_to_string(list_filter([
        CASE WHEN feature_version <> 'rule-features-v1' THEN 'MODEL_FEATURE_VERSION_UNEXPECTED' END,
        CASE WHEN m.status <> 'EXPERIMENTAL' THEN 'MODEL_STATUS_' || m.status END,
        CASE WHEN c.data_mode = 'DEMO_FIXTURE' AND governance_scope <> 'DEMO_FIXTURE_ONLY'
          THEN 'MODEL_GOVERNANCE_SCOPE_INVALID' END,
        CASE WHEN c.data_mode <> 'DEMO_FIXTURE' THEN 'REAL_DATA_MODEL_GATE_BLOCKED' END],
        lambda x: x IS NOT NULL), ',') END AS model_codes,
    i.instrument_id IS NULL AS no_instrument, i.region, s.provider_code, s.dataset_type, s.license_scope,
    CAST(substr(c.snapshot_id, 6) AS INT) AS k,
    EXISTS (SELECT 1 FROM news_items_f n WHERE n.snapshot_id = c.snapshot_id AND c.decided_at < n.valid_from
      AND n.valid_from <= {NOW}) AS news_changed,
    coalesce(macro_status = 'AVAILABLE', FALSE) AND EXISTS (SELECT 1 FROM macro_rows_f r WHERE r.macro_id = c.macro_id
      AND c.decided_at < r.valid_from AND r.valid_from <= {NOW}) AS macro_changed,
    EXISTS (SELECT 1 FROM master_f r WHERE r.provider = s.provider_code AND c.decided_at < r.valid_from
      AND r.valid_from <= {NOW}) OR EXISTS (SELECT 1 FROM rights_f r WHERE r.provider_code = s.provider_code
      AND c.decided_at < r.valid_from AND r.valid_from <= {NOW}) OR EXISTS (SELECT 1 FROM models_f r
      WHERE r.model_id = c.model_id AND c.decided_at < r.valid_from AND r.valid_from <= {NOW}) AS policy_changed,
    list_contains(rt.regions, i.region) AND list_contains(rt.markets, i.mic) AS allowed
  FROM cur c LEFT JOIN (SELECT * FROM models_f WHERE valid_to IS NULL) m ON m.model_id = c.model_id
  LEFT JOIN (SELECT * FROM master_f WHERE valid_to IS NULL) i ON i.instrument_id = c.instrument_id
  LEFT JOIN snapshots_f s ON s.snapshot_id = c.snapshot_id
  LEFT JOIN (SELECT * FROM rights_f WHERE valid_to IS NULL) rt ON rt.provider_code = s.provider_code),
altered AS (SELECT count(*) > 0 AS yes FROM contents_f WHERE snapshot_id = 'bars-5' AND year(event_time) = 1997),
sg3 AS (SELECT desk_id, signal_id, CASE WHEN edited THEN 'SIGNAL_RECORD_INTEGRITY_FAILED'
    WHEN no_model THEN 'MODEL_GOVERNANCE_BLOCKED:MODEL_VERSION_MISSING'
    WHEN model_codes <> '' THEN 'MODEL_GOVERNANCE_BLOCKED:' || model_codes
    WHEN no_instrument THEN 'INSTRUMENT_MASTER_MISSING'
    WHEN provider_code IS NULL OR dataset_type <> 'MARKET_BARS' OR license_scope = 'SCOPE_UNCLEAR'
      OR data_mode <> 'DEMO_FIXTURE' OR (k = 5 AND (SELECT yes FROM altered)) THEN 'MARKET_SNAPSHOT_INTEGRITY_FAILED'
    WHEN NOT allowed THEN 'MARKET_OR_REGION_LICENSE_BLOCKED'
    WHEN news_changed THEN 'NEWS_LINEAGE_INTEGRITY_FAILED'
    WHEN macro_status IS NULL THEN 'MACRO_LINEAGE_MISSING'
    WHEN macro_status NOT IN ('AVAILABLE', 'UNAVAILABLE_REWEIGHTED') OR (macro_status = 'AVAILABLE' AND macro_id IS NULL)
      THEN 'MACRO_LINEAGE_INVALID'
    WHEN macro_status = 'AVAILABLE' AND (macro_changed OR macro_id NOT IN (SELECT macro_id FROM macro_rows_f))
      THEN 'MACRO_SNAPSHOT_INTEGRITY_FAILED'
    WHEN policy_changed OR other_policy THEN 'DECISION_POLICY_CHANGED' END AS reason FROM changed),
d3 AS (SELECT desk_id, arg_min(reason, signal_id) AS reason, CAST(min(signal_id) AS VARCHAR) AS item, count(*) AS failing
  FROM sg3 WHERE reason IS NOT NULL GROUP BY 1),
sets AS (SELECT desk_id, count(DISTINCT snapshot_id) AS n, min(snapshot_id) AS snapshot_id FROM cur GROUP BY 1),
broken AS (SELECT DISTINCT portfolio_id FROM book WHERE entry_id % 211 = 7),
d4 AS (SELECT s.desk_id, CASE WHEN n <> 1 THEN 'CURRENT_SIGNAL_SNAPSHOT_SET_INVALID'
    WHEN NOT EXISTS (SELECT 1 FROM contents_f c WHERE c.snapshot_id = s.snapshot_id) THEN 'PORTFOLIO_MARKET_DATA_UNAVAILABLE'
    WHEN desk_id IN (SELECT portfolio_id FROM broken) THEN 'PORTFOLIO_LEDGER_INTEGRITY_FAILED'
    WHEN len(g.rules) > 0 THEN 'PORTFOLIO_RISK_BLOCKED:' || array_to_string(g.rules, ',') END AS reason
  FROM sets s LEFT JOIN grules g ON g.portfolio_id = s.desk_id)
SELECT d.desk_id, coalesce(d1.reason, d2.reason, d3.reason, d4.reason) AS reason,
  CASE WHEN d1.reason IS NOT NULL THEN 0 WHEN d2.reason IS NOT NULL THEN 1 WHEN d3.reason IS NOT NULL THEN 2
    WHEN d4.reason IS NOT NULL THEN 3 END::INTEGER AS level,
  CASE WHEN d1.reason IS NULL AND d2.reason IS NULL AND d3.reason IS NOT NULL THEN d3.item
    WHEN coalesce(d1.reason, d2.reason, d4.reason) IS NOT NULL THEN '0' END AS item,
  CASE WHEN d1.reason IS NULL AND d2.reason IS NULL AND d3.reason IS NOT NULL THEN d3.failing
    WHEN coalesce(d1.reason, d2.reason, d4.reason) IS NOT NULL THEN 1 ELSE 0 END AS failing
FROM desks_f d JOIN d1 ON d1.desk_id = d.desk_id JOIN d2 ON d2.desk_id = d.desk_id
LEFT JOIN d3 ON d3.desk_id = d.desk_id LEFT JOIN d4 ON d4.desk_id = d.desk_id"""


@query(
    "output_health", "B-21 G-02",
    "WITH " + ledgers.GATE_SQL + ",\n" + HEALTH_SQL, "facts ledger instruments",
)
def _output_health(t):
    """First failing reason per desk, by three levels: the desk and its run, its signals, its set and book."""
    c = F.col
    rests = Rests(t)
    desks = fixture(t, "desks")
    latest = fixture(t, "runs").groupBy("desk_id").agg(
        F.max_by("status", F.struct("started_at", "run_id")).alias("run_status")
    )
    current = rests.signals().filter("is_current").withColumn("now", F.lit(AT.isoformat()).cast("timestamp"))
    both = rests.parts(cut_lineage(current), then="decided_at", now="now")
    stored = F.when(c("other_policy"), F.lit("x")).otherwise(rests.policy("then"))
    snapshots = rests.snapshots.select("snapshot_id", F.struct(
        "dataset_type", "license_scope", "data_mode", "intact", "held_rows").alias("snapshot"))
    wide = both.withColumns({"stored_policy": stored, "current_policy": rests.policy("now")}).join(
        snapshots, "snapshot_id", "left"
    )
    for table, keys, name in (
        (rests.models, {"model_id": "model_id"}, "model"),
        (rests.master, {"instrument_id": "instrument_id"}, "instrument"),
        (rests.rights, {"provider_code": "provider_code"}, "rights"),
    ):
        wide = governance.version_at(wide, table, keys, "now", name)
    wide = cut_lineage(wide.withColumn("sealed", c("record_hash") == row_hash(wide, SEALED)))
    snapshot, instrument = c("snapshot"), c("instrument")
    codes = gates.model_rules(c("data_mode"), c("model"))
    used = c("macro_status") == "AVAILABLE"
    per_signal = [
        Check("SIGNAL_RECORD_INTEGRITY_FAILED", ~c("sealed")),
        Check("MODEL_GOVERNANCE_BLOCKED", F.size(codes) > 0,
              F.concat(F.lit("MODEL_GOVERNANCE_BLOCKED:"), F.array_join(codes, ","))),
        Check("INSTRUMENT_MASTER_MISSING", instrument.isNull()),
        Check("MARKET_SNAPSHOT_INTEGRITY_FAILED",
              snapshot.isNull() | ~snapshot["intact"] | gates.unclear(snapshot["license_scope"])
              | (F.size(gates.license_reasons(c("rights"), c("now"), PURPOSES)) > 0)
              | (snapshot["dataset_type"] != "MARKET_BARS") | (snapshot["data_mode"] != c("data_mode"))),
        # A place is judged only where there is an instrument and a snapshot whose provider is known.
        Check("MARKET_OR_REGION_LICENSE_BLOCKED",
              F.size(gates.license_reasons(c("rights"), c("now"), PURPOSES, instrument["mic"],
                                           instrument["region"])) > 0,
              needs=("INSTRUMENT_MASTER_MISSING", "MARKET_SNAPSHOT_INTEGRITY_FAILED")),
        Check("NEWS_LINEAGE_INTEGRITY_FAILED", ~c("news_then").eqNullSafe(c("news_now")),
              needs=("MARKET_SNAPSHOT_INTEGRITY_FAILED",)),
        Check("MACRO_LINEAGE_MISSING", c("macro_status").isNull()),
        Check("MACRO_LINEAGE_INVALID",
              ~c("macro_status").isin("AVAILABLE", "UNAVAILABLE_REWEIGHTED") | (used & c("macro_id").isNull()),
              needs=("MACRO_LINEAGE_MISSING",)),
        Check("MACRO_SNAPSHOT_INTEGRITY_FAILED", used & ~F.coalesce(c("macro_then") == c("macro_now"), F.lit(False)),
              needs=("MACRO_LINEAGE_MISSING", "MACRO_LINEAGE_INVALID")),
        Check("DECISION_POLICY_CHANGED", c("stored_policy") != c("current_policy"),
              needs=("MARKET_SNAPSHOT_INTEGRITY_FAILED", "NEWS_LINEAGE_INTEGRITY_FAILED",
                     "MACRO_SNAPSHOT_INTEGRITY_FAILED")),
    ]
    per_desk = wide.groupBy("desk_id").agg(
        F.min("snapshot_id").alias("low"), F.max("snapshot_id").alias("high"), F.min("snapshot.held_rows").alias("held_rows"),
    )
    run = desks.join(latest, "desk_id", "left").join(per_desk.select("desk_id", "low"), "desk_id", "left")
    entries = ledgers.book(t)
    columns = ["entry_id", "portfolio_id", "occurred_at", "entry_type", "instrument_id", "cash_delta", "quantity_delta"]
    sealed = integrity.seal(entries, columns).withColumn(
        "cash_delta", c("cash_delta") + F.when(c("entry_id") % 211 == 7, 1.0).otherwise(0.0)
    )
    broken = integrity.seal_mismatches(sealed, columns).select(
        c("portfolio_id").alias("desk_id"), F.lit(True).alias("broken")
    ).distinct()
    books = ledgers.gated(t).select(c("portfolio_id").alias("desk_id"), "rules")
    sets = per_desk.join(broken, "desk_id", "left").join(books, "desk_id", "left")
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    return governance.first_reasons(desks, "desk_id", [
        (run, None, [
            Check("GLOBAL_KILL_SWITCH", c("kill_switch")),
            Check("PIPELINE_NOT_RUN", c("run_status").isNull()),
            Check("PIPELINE_NOT_SUCCEEDED", c("run_status") != "SUCCEEDED",
                  F.concat(F.lit("PIPELINE_"), c("run_status")), needs=("PIPELINE_NOT_RUN",)),
        ]),
        (run, None, [Check("NO_CURRENT_SIGNALS", c("low").isNull())]),
        (wide, "signal_id", per_signal),
        (sets, None, [
            Check("CURRENT_SIGNAL_SNAPSHOT_SET_INVALID", c("low") != c("high")),
            Check("PORTFOLIO_MARKET_DATA_UNAVAILABLE", c("held_rows") == 0,
                  needs=("CURRENT_SIGNAL_SNAPSHOT_SET_INVALID",)),
            Check("PORTFOLIO_LEDGER_INTEGRITY_FAILED", F.coalesce("broken", F.lit(False))),
            Check("PORTFOLIO_RISK_BLOCKED", F.size(rules) > 0,
                  F.concat(F.lit("PORTFOLIO_RISK_BLOCKED:"), F.array_join(rules, ",")),
                  needs=("PORTFOLIO_LEDGER_INTEGRITY_FAILED",)),
        ]),
    ])


# ---------------------------------------------------------------- H-14

def _moment(at: str, name: str) -> str:
    return f"""
{name} AS (SELECT s.signal_id, list_concat(list_filter([
    CASE WHEN edited THEN 'SIGNAL_NOT_INTACT' END, CASE WHEN NOT is_current THEN 'SIGNAL_NOT_CURRENT' END,
    CASE WHEN state <> 'ENTRY_CANDIDATE' THEN 'SIGNAL_STATE_CHANGED' END,
    CASE WHEN latency_status <> 'ON_TIME' THEN 'SIGNAL_NOT_ON_TIME' END,
    CASE WHEN sn.snapshot_id IS NULL THEN 'SNAPSHOT_MISSING' END,
    CASE WHEN sn.dataset_type <> 'MARKET_BARS' THEN 'SNAPSHOT_TYPE_INVALID' END,
    CASE WHEN sn.data_mode <> s.data_mode THEN 'SNAPSHOT_MODE_MISMATCH' END,
    CASE WHEN sn.license_scope = 'SCOPE_UNCLEAR' THEN 'LICENSE_SCOPE_UNCLEAR' END,
    CASE WHEN i.instrument_id IS NULL THEN 'INSTRUMENT_MASTER_MISSING' END,
    CASE WHEN NOT active OR leveraged OR inverse OR liquidity_tier > 2 THEN 'INSTRUMENT_NOT_TRADABLE' END,
    CASE WHEN m.model_id IS NULL THEN 'MODEL_VERSION_MISSING' WHEN m.version <> '1.0.0' THEN 'MODEL_VERSION_UNEXPECTED' END,
    CASE WHEN m.version = '1.0.0' AND feature_version <> 'rule-features-v1' THEN 'MODEL_FEATURE_VERSION_UNEXPECTED' END,
    CASE WHEN m.version = '1.0.0' AND m.status <> 'EXPERIMENTAL' THEN 'MODEL_STATUS_' || m.status END,
    CASE WHEN m.version = '1.0.0' AND s.data_mode = 'DEMO_FIXTURE' AND governance_scope <> 'DEMO_FIXTURE_ONLY'
      THEN 'MODEL_GOVERNANCE_SCOPE_INVALID' END,
    CASE WHEN m.version = '1.0.0' AND s.data_mode <> 'DEMO_FIXTURE' THEN 'REAL_DATA_MODEL_GATE_BLOCKED' END,
    CASE WHEN NOT list_contains(rt.regions, i.region) THEN 'LICENSE_REGION_DENIED' END], lambda x: x IS NOT NULL), []) AS codes
  FROM signals_f s LEFT JOIN snapshots_f sn ON sn.snapshot_id = s.snapshot_id
  LEFT JOIN master_f i ON i.instrument_id = s.instrument_id AND i.valid_from <= {at} AND ({at} < i.valid_to OR i.valid_to IS NULL)
  LEFT JOIN models_f m ON m.model_id = s.model_id AND m.valid_from <= {at} AND ({at} < m.valid_to OR m.valid_to IS NULL)
  LEFT JOIN rights_f rt ON rt.provider_code = sn.provider_code AND rt.valid_from <= {at}
    AND ({at} < rt.valid_to OR rt.valid_to IS NULL))"""


def _changed(table: str, on: str, name: str, also: str = "TRUE") -> str:
    """SQL for whether a version of the signal's key begins between its two times."""
    return (f"CASE WHEN {also} AND EXISTS (SELECT 1 FROM {table} v WHERE {on} AND s.decided_at < v.valid_from"
            f" AND v.valid_from <= s.executed_at) THEN '{name}' END")


RECHECK_SQL = FIXTURE_SQL + "," + _moment("s.decided_at", "before") + "," + _moment("s.executed_at", "after_") + f""",
causes AS (SELECT s.signal_id, s.other_policy, list_filter([
    {_changed("master_f", "v.provider = sn.provider_code", "master")},
    {_changed("rights_f", "v.provider_code = sn.provider_code", "rights")},
    {_changed("models_f", "v.model_id = s.model_id", "model")},
    {_changed("macro_rows_f", "v.macro_id = s.macro_id", "macro", "s.macro_status = 'AVAILABLE'")},
    {_changed("news_items_f", "v.snapshot_id = s.snapshot_id", "news")}], lambda x: x IS NOT NULL) AS parts
  FROM signals_f s LEFT JOIN snapshots_f sn ON sn.snapshot_id = s.snapshot_id)
SELECT c.signal_id, array_to_string(parts, ',') AS changed_parts,
  array_to_string(list_filter(a.codes, lambda x: NOT list_contains(b.codes, x)), ',') AS added,
  array_to_string(list_filter(b.codes, lambda x: NOT list_contains(a.codes, x)), ',') AS cleared,
  len(parts) > 0 OR other_policy AS policy_changed,
  len(parts) = 0 AND NOT other_policy AND len(a.codes) = 0 AS executable
FROM causes c JOIN before b ON b.signal_id = c.signal_id JOIN after_ a ON a.signal_id = c.signal_id"""


@query("governance_recheck", "H-14 B-16 H-07", "WITH " + RECHECK_SQL)
def _governance_recheck(t):
    """Every signal's gates as of its decision and, again, as of its execution, with what changed between."""
    c = F.col
    rests = Rests(t)
    signals = rests.signals()
    rows = cut_lineage(signals.withColumn("intact", c("record_hash") == row_hash(signals, SEALED)))
    rows = rests.parts(rows, then="decided_at", now="executed_at")
    # Digests are compared before rows move on; only what came of it goes along.
    parts = {p: (c(f"{p}_then"), c(f"{p}_now")) for p in rests.histories}
    stored = F.when(c("other_policy"), F.lit("x")).otherwise(rests.policy("then"))
    rows = rows.select(
        "signal_id", "instrument_id", "snapshot_id", "provider_code", "model_id", "decided_at", "executed_at", "intact",
        "is_current", "state", "latency_status", "data_mode", (stored != rests.policy("now")).alias("changed"),
        F.array_join(governance.changes(parts), ",").alias("changed_parts"),
    )
    rows = rows.join(
        rests.snapshots.select("snapshot_id", F.struct("dataset_type", "license_scope", "data_mode").alias("snapshot")),
        "snapshot_id", "left",
    )
    for name, at in (("then", "decided_at"), ("now", "executed_at")):
        for table, keys, part in (
            (rests.models, {"model_id": "model_id"}, "model"),
            (rests.master, {"instrument_id": "instrument_id"}, "instrument"),
            (rests.rights, {"provider_code": "provider_code"}, "rights"),
        ):
            rows = governance.version_at(rows, table, keys, at, part)
        rows = rows.withColumn(f"reasons_{name}", governance.execution_reasons(PURPOSES, c(at)))
        rows = rows.drop("model", "instrument", "rights")
    changed = c("changed")
    return rows.select(
        "signal_id", "changed_parts",
        F.array_join(F.array_except("reasons_now", "reasons_then"), ",").alias("added"),
        F.array_join(F.array_except("reasons_then", "reasons_now"), ",").alias("cleared"),
        changed.alias("policy_changed"), (~changed & (F.size("reasons_now") == 0)).alias("executable"),
    )


# ---------------------------------------------------------------- B-22

SHOWN = ["alert_id", "source_object_type", "title", "message", "latency_status", "trigger_reason", "confidence",
         "source_links", "invalidation_conditions"]
ALERT_SEAL = ["alert_id", "source_object_type", "title", "trigger_reason", "confidence"]

ALERT_SQL = FIXTURE_SQL + "," + _moment(NOW, "held_now").replace("'LICENSE_REGION_DENIED'", "'PROVIDER_LICENSE_BLOCKED'") + f""",
last_run AS (SELECT desk_id, arg_max(status, (started_at, run_id)) AS status FROM runs_f GROUP BY 1),
health AS (SELECT d.desk_id, CASE WHEN kill_switch THEN 'GLOBAL_KILL_SWITCH' WHEN status IS NULL THEN 'PIPELINE_NOT_RUN'
    WHEN status <> 'SUCCEEDED' THEN 'PIPELINE_' || status END AS reason
  FROM desks_f d LEFT JOIN last_run r ON r.desk_id = d.desk_id),
sa AS (SELECT s.*, s.signal_id * 10 + 1 AS alert_id, CASE WHEN part % 37 = 2 THEN 'Other' ELSE 'Signal' END AS kind,
    part % 47 = 5 AS spoilt, part % 41 = 3 AS unlinked, part % 29 = 6 AS elsewhere, h.reason AS health, sn.provider_code,
    sn.dataset_type, sn.license_scope, codes, CAST(substr(s.snapshot_id, 6) AS INT) AS k,
    EXISTS (SELECT 1 FROM news_items_f n WHERE n.snapshot_id = s.snapshot_id AND s.decided_at < n.valid_from
      AND n.valid_from <= {NOW}) AS news_changed
  FROM signals_f s JOIN health h ON h.desk_id = s.desk_id JOIN held_now m ON m.signal_id = s.signal_id
  LEFT JOIN snapshots_f sn ON sn.snapshot_id = s.snapshot_id WHERE part % 4 = 0),
sr AS (SELECT alert_id, kind, latency_status, state AS trigger_reason, probability AS confidence,
    CASE WHEN spoilt THEN 'ALERT_CONTENT_INTEGRITY_FAILED' WHEN kind = 'Other' THEN 'ALERT_LINEAGE_UNVERIFIED'
      WHEN health IS NOT NULL THEN 'CURRENT_CANDIDATE_OUTPUT_BLOCKED:' || health
      WHEN unlinked THEN 'ALERT_SIGNAL_LINEAGE_INVALID' WHEN edited THEN 'SIGNAL_RECORD_INTEGRITY_FAILED'
      WHEN provider_code IS NULL OR list_contains(codes, 'INSTRUMENT_MASTER_MISSING') OR elsewhere
        OR dataset_type <> 'MARKET_BARS' OR data_mode <> 'DEMO_FIXTURE' OR license_scope = 'SCOPE_UNCLEAR'
        THEN 'ALERT_SIGNAL_LINEAGE_INVALID'
      WHEN len(list_filter(codes, lambda x: x LIKE 'MODEL%' OR x LIKE 'REAL_DATA%')) > 0 THEN 'MODEL_GOVERNANCE_BLOCKED'
      WHEN news_changed THEN 'NEWS_LINEAGE_BLOCKED'
      WHEN list_contains(codes, 'PROVIDER_LICENSE_BLOCKED') THEN 'PROVIDER_LICENSE_BLOCKED'
      WHEN k = 5 AND EXISTS (SELECT 1 FROM contents_f WHERE snapshot_id = 'bars-5' AND year(event_time) = 1997)
        THEN 'ALERT_SOURCE_INTEGRITY_BLOCKED' END AS reason FROM sa),
er AS (SELECT c.event_code * 10 + 2 AS alert_id, 'ScheduledEvent' AS kind, 'ON_TIME' AS latency_status,
    status AS trigger_reason, 0.5::DOUBLE AS confidence,
    CASE WHEN c.event_code % 31 = 1 OR c.event_code % 23 = 2 OR NOT is_current OR status <> 'SCHEDULED'
        OR upper(license_scope) LIKE '%UNCLEAR%' OR c.event_code % 59 = 3 THEN 'ALERT_EVENT_LINEAGE_INVALID'
      WHEN flag = 'LICENSE_UNCLEAR' THEN 'ALERT_EVENT_QUALITY_BLOCKED'
      WHEN r.review_status <> 'APPROVED' OR r.expires_at <= {NOW} OR NOT list_contains(r.regions, c.region)
        THEN 'PROVIDER_LICENSE_BLOCKED' END AS reason
  FROM calendar c JOIN registry r ON r.provider_code = c.provider_code),
yr AS (SELECT run_id * 10 + 3 AS alert_id, 'System' AS kind, 'ON_TIME' AS latency_status, status AS trigger_reason,
    NULL::DOUBLE AS confidence, CASE WHEN run_id % 4 = 1 OR run_id % 5 = 0 THEN 'ALERT_SYSTEM_LINEAGE_INVALID' END AS reason
  FROM runs_f WHERE status <> 'SUCCEEDED'),
al AS (SELECT * FROM sr UNION ALL SELECT * FROM er UNION ALL SELECT * FROM yr)
SELECT alert_id, kind AS source_object_type, reason AS display_blocked_reason,
  CASE WHEN reason IS NULL THEN 'alert ' || alert_id ELSE 'withheld' END AS title,
  CASE WHEN reason IS NULL THEN 'because of ' || trigger_reason ELSE 'withheld' END AS message,
  CASE WHEN reason IS NULL THEN latency_status ELSE 'UNAVAILABLE' END AS latency_status,
  CASE WHEN reason IS NULL THEN trigger_reason WHEN kind = 'Signal' AND reason <> 'ALERT_CONTENT_INTEGRITY_FAILED'
    THEN 'SIGNAL_DERIVED_DISPLAY_BLOCKED' ELSE 'ALERT_DERIVED_DISPLAY_BLOCKED' END AS trigger_reason,
  CASE WHEN reason IS NULL THEN round(confidence, 6) END AS confidence,
  CASE WHEN reason IS NULL THEN 'src' ELSE '' END AS source_links,
  CASE WHEN reason IS NULL THEN 'next close' ELSE 'REVIEW_REQUIRED' END AS invalidation_conditions
FROM al"""


def _with_texts(rows: DataFrame) -> DataFrame:
    """What every alert of the fixture shows, sealed."""
    c = F.col
    full = rows.withColumns({
        "title": F.concat(F.lit("alert "), c("alert_id").cast("string")),
        "message": F.concat(F.lit("because of "), c("trigger_reason")),
        "source_links": F.array(F.lit("src")), "invalidation_conditions": F.array(F.lit("next close")),
    })
    return integrity.seal(full, ALERT_SEAL, "content_hash")


@query("alert_display", "B-22", "WITH " + ALERT_SQL, "calendar registry")
def _alert_display(t):
    """Alerts of signals, calendar events and the system, each judged by what its kind of source is joined to."""
    c = F.col
    rests = Rests(t)
    content = lambda df: Check("ALERT_CONTENT_INTEGRITY_FAILED", c("content_hash") != row_hash(df, ALERT_SEAL))

    def judged(df: DataFrame, checks: list[Check]) -> DataFrame:
        reason = F.try_element_at(governance.failures(checks), F.lit(1))["reason"]
        return df.withColumn("display_blocked_reason", reason).select(*SHOWN, "display_blocked_reason")

    # Signals: their desk's run, and the versions that hold now.
    desks = fixture(t, "desks").join(
        fixture(t, "runs").groupBy("desk_id").agg(F.max_by("status", F.struct("started_at", "run_id")).alias("run")),
        "desk_id", "left",
    )
    signals = cut_lineage(rests.signals().filter("part % 4 = 0").withColumn("now", F.lit(AT.isoformat()).cast("timestamp")))
    history, keys = rests.histories["news"]
    wide = governance.digest_at(signals, history, keys, {"decided_at": "news_then", "now": "news_now"})
    wide = wide.join(rests.snapshots.select("snapshot_id", F.struct(
        "provider_code", "dataset_type", "license_scope", "data_mode", "intact").alias("snapshot")), "snapshot_id", "left")
    for table, by, name in (
        (rests.models, {"model_id": "model_id"}, "model"),
        (rests.master, {"instrument_id": "instrument_id"}, "instrument"),
        (rests.rights, {"provider_code": "provider_code"}, "rights"),
    ):
        wide = governance.version_at(wide, table, by, "now", name)
    part, snapshot, instrument = c("part"), c("snapshot"), c("instrument")
    wide = _with_texts(wide.join(desks, "desk_id").withColumns({
        "intact": c("record_hash") == row_hash(wide, SEALED), "alert_id": c("signal_id") * 10 + 1,
        "source_object_type": F.when(part % 37 == 2, "Other").otherwise("Signal"),
        "source_object_id": F.when(part % 41 != 3, c("signal_id")), "trigger_reason": c("state"),
        # The sealed value; rows of edited signals show it as it was.
        "confidence": (part % 100).cast("double") / 100.0,
        "alert_provider": F.when(part % 29 == 6, "provX").otherwise(c("provider_code")),
    }))
    wide = wide.withColumn("content_hash", F.when(part % 47 == 5, "x").otherwise(c("content_hash")))
    placed = gates.license_reasons(c("rights"), c("now"), {"display", "derivative", "cache"}, instrument["mic"], instrument["region"])
    from_signals = judged(wide, [
        content(wide),
        Check("ALERT_LINEAGE_UNVERIFIED", c("source_object_type") != "Signal"),
        Check("CURRENT_CANDIDATE_OUTPUT_BLOCKED", c("kill_switch") | c("run").isNull() | (c("run") != "SUCCEEDED"),
              F.concat(F.lit("CURRENT_CANDIDATE_OUTPUT_BLOCKED:"), F.when(c("kill_switch"), "GLOBAL_KILL_SWITCH")
                       .when(c("run").isNull(), "PIPELINE_NOT_RUN").otherwise(F.concat(F.lit("PIPELINE_"), c("run"))))),
        Check("ALERT_SIGNAL_LINEAGE_INVALID", c("source_object_id") != c("signal_id")),
        Check("SIGNAL_RECORD_INTEGRITY_FAILED", ~c("intact")),
        Check("ALERT_SIGNAL_LINEAGE_INVALID", snapshot.isNull() | instrument.isNull()
              | (c("alert_provider") != snapshot["provider_code"]) | (snapshot["dataset_type"] != "MARKET_BARS")
              | (snapshot["data_mode"] != c("data_mode")) | gates.unclear(snapshot["license_scope"])),
        Check("MODEL_GOVERNANCE_BLOCKED", F.size(gates.model_rules(c("data_mode"), c("model"))) > 0),
        Check("NEWS_LINEAGE_BLOCKED", ~c("news_then").eqNullSafe(c("news_now"))),
        Check("PROVIDER_LICENSE_BLOCKED", F.size(placed) > 0),
        Check("ALERT_SOURCE_INTEGRITY_BLOCKED", ~snapshot["intact"]),
    ])

    # Calendar events: an alert keeps the id and the provider it was raised for.
    code = c("event_code")
    raised = gating.events(t).select(
        (code * 10 + 2).alias("alert_id"), F.lit("ScheduledEvent").alias("source_object_type"),
        F.when(code % 31 == 1, -code).otherwise(code).alias("source_object_id"),
        F.when(code % 23 == 2, "provX").otherwise(c("provider_code")).alias("alert_provider"),
        c("status").alias("trigger_reason"), F.lit("ON_TIME").alias("latency_status"), F.lit(0.5).alias("confidence"),
    )
    facts = gating.events(t).select(code.alias("source_object_id"), F.struct(
        "provider_code", "is_current", "status", "license_scope", "raw_payload_hash", "quality_flags", "region").alias("event"))
    event = c("event")
    known = views.registry(t)
    calendar = _with_texts(raised).join(facts, "source_object_id", "left").join(
        known.select(c("provider_code").alias("alert_provider"), F.struct(*known.columns).alias("rights")), "alert_provider", "left")
    from_events = judged(calendar, [
        content(calendar),
        Check("ALERT_EVENT_LINEAGE_INVALID", event.isNull() | (c("alert_provider") != event["provider_code"])
              | ~event["is_current"] | (event["status"] != "SCHEDULED") | gates.unclear(event["license_scope"])
              | (F.length(event["raw_payload_hash"]) != 64)),
        Check("ALERT_EVENT_QUALITY_BLOCKED", gates.flags_blocked(event["quality_flags"], gates.BLOCKING_EVENT_FLAGS)),
        Check("PROVIDER_LICENSE_BLOCKED", F.size(gates.license_reasons(
            c("rights"), F.lit(AT.isoformat()).cast("timestamp"), {"display", "cache"}, region=event["region"])) > 0),
    ])

    # The system: nothing to join, but it names no provider.
    run = c("run_id")
    failed = _with_texts(fixture(t, "runs").filter("status <> 'SUCCEEDED'").select(
        (run * 10 + 3).alias("alert_id"), F.lit("System").alias("source_object_type"),
        F.when(run % 4 == 1, "OTHER").otherwise("SYSTEM_HEALTH").alias("alert_type"),
        F.when(run % 5 == 0, "prov0").alias("alert_provider"), c("status").alias("trigger_reason"),
        F.lit("ON_TIME").alias("latency_status"), F.lit(None).cast("double").alias("confidence"),
    ))
    from_system = judged(failed, [
        content(failed),
        Check("ALERT_SYSTEM_LINEAGE_INVALID",
              ~c("alert_type").isin("SYSTEM_HEALTH", "PORTFOLIO_RISK") | c("alert_provider").isNotNull()),
    ])
    shown = gates.alert_view(from_signals.unionByName(from_events).unionByName(from_system))
    return shown.select(
        "alert_id", "source_object_type", "display_blocked_reason", "title", "message", "latency_status", "trigger_reason",
        r6(c("confidence")).alias("confidence"), F.array_join("source_links", ",").alias("source_links"),
        F.array_join("invalidation_conditions", ",").alias("invalidation_conditions"),
    )
