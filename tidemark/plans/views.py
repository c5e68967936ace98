"""Domain views over the input tables, once as DataFrames and once as SQL text for comparison.

The DataFrame form avoids windows: first and last values of a bar are combinable aggregates, so a
supplier-day that holds most of the rows is still reduced before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import Tables

SQL: dict[str, str] = {}

SQL["instruments"] = """
SELECT s.s_suppkey AS instrument_id, s.s_name AS name, r.r_name AS region, n.n_name AS industry,
       'AC' || CAST(s.s_suppkey % 5 AS VARCHAR) AS asset_class,
       CAST(1 + s.s_suppkey % 3 AS INT) AS liquidity_tier,
       s.s_suppkey % 17 = 3 AS leveraged, s.s_suppkey % 19 = 4 AS inverse,
       s.s_suppkey % 23 <> 5 AS active,
       'prov' || CAST(s.s_suppkey % 2 AS VARCHAR) AS provider,
       'X' || substr(r.r_name, 1, 3) AS mic
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey"""

SQL["bars"] = """
SELECT l_suppkey AS instrument_id, l_shipdate + INTERVAL '7' HOUR AS event_time,
       max(CASE WHEN ra = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN rd = 1 THEN px END) AS close,
       max(CASE WHEN rd = 1 THEN px END) AS total_return_close,
       sum(l_quantity) * 100000 AS volume,
       max(CASE WHEN ra = 1 THEN round(CAST(2 AS DOUBLE) + CAST(300 AS DOUBLE) * l_tax, 4) END)
         AS bid_ask_spread_bps,
       CASE WHEN max((l_suppkey * 13 + dn) % 211) = 7 THEN CAST(2 AS DOUBLE)
            ELSE CAST(1 AS DOUBLE) END AS split_factor,
       CASE WHEN max((l_suppkey * 7 + dn) % 89) = 5 THEN CAST(0.6 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS dividend,
       CAST(1 AS DOUBLE) AS fx_rate,
       CAST(5 + l_suppkey % 60 AS DOUBLE) / CAST(10000 AS DOUBLE) AS expense_ratio,
       CASE WHEN max((l_suppkey * 31 + dn) % 53) = 0 THEN l_shipdate + INTERVAL '79' HOUR
            ELSE l_shipdate + INTERVAL '7' HOUR + INTERVAL '10' MINUTE END AS available_at,
       'v1' AS revision, 'prov' || CAST(l_suppkey % 2 AS VARCHAR) AS provider
FROM (SELECT *,
        row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber,
          l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS ra,
        row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC,
          l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC,
          l_discount DESC, l_tax DESC) AS rd
      FROM (SELECT *, (year(l_shipdate) - 1995) * 365 + (month(l_shipdate) - 1) * 30
                      + day(l_shipdate) AS dn,
              round(CAST(100 AS DOUBLE) + CAST(l_partkey % 101 AS DOUBLE) / CAST(40 AS DOUBLE)
                + CAST(5 AS DOUBLE) * l_discount
                + CAST(((year(l_shipdate) - 1995) * 365 + (month(l_shipdate) - 1) * 30
                  + day(l_shipdate)) * (l_suppkey % 7 - 3) AS DOUBLE) * CAST(0.003 AS DOUBLE), 6)
                AS px
            FROM lineitem) base) ranked
GROUP BY l_suppkey, l_shipdate"""

SQL["facts"] = """
SELECT *, available_at AS published_at, available_at AS first_seen_at, event_time AS as_of,
       available_at + INTERVAL '1' MINUTE AS ingested_at, 'SCOPE_A' AS license_scope,
       CASE WHEN instrument_id % 29 = 7 THEN 'HISTORICAL' ELSE 'DEMO_FIXTURE' END AS data_mode
FROM bars"""

SQL["news"] = """
SELECT event_id, ts AS event_time, ts + INTERVAL '2' MINUTE AS available_at,
       CAST(k % 5 AS INT) AS region_key, 'AC' || CAST(k % 5 AS VARCHAR) AS asset_class,
       CAST(k % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS relevance,
       CAST(k % 3 - 1 AS DOUBLE) AS direction,
       least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE)) AS severity,
       CAST(0.5 AS DOUBLE) + CAST(k % 6 AS DOUBLE) / CAST(10 AS DOUBLE) AS confidence,
       event_type = 'error' AS flagged, user_id, k
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e"""

SQL["ledger"] = """
SELECT user_id AS portfolio_id, event_id AS entry_id, ts AS occurred_at,
       CASE event_type WHEN 'signup' THEN 'OPENING_CASH' WHEN 'purchase' THEN 'BUY'
            WHEN 'click' THEN 'DIVIDEND' END AS entry_type,
       CASE event_type WHEN 'purchase' THEN CAST(k % 10 AS BIGINT) END AS instrument_id,
       CASE event_type WHEN 'signup' THEN CAST(10000 AS DOUBLE) WHEN 'purchase' THEN -value
            ELSE value / CAST(100 AS DOUBLE) END AS cash_delta,
       CASE event_type WHEN 'purchase' THEN CAST(k % 7 + 1 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS quantity_delta,
       CASE event_type WHEN 'purchase' THEN value / CAST(1000 AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS fee_amount
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
WHERE event_type IN ('signup', 'purchase', 'click')"""

SQL["macro"] = """
SELECT o_orderpriority AS series_code, date_trunc('month', o_orderdate) AS event_time,
       CAST(max(o_orderkey % 400) AS DOUBLE) / CAST(200 AS DOUBLE) - CAST(1 AS DOUBLE) AS value,
       date_trunc('month', o_orderdate) + INTERVAL '40' DAY AS available_at,
       o_orderstatus AS revision
FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate), o_orderstatus"""

SQL["predictions"] = """
SELECT l.doc_id, l.quality AS label,
       CAST((l.doc_id * 37 + d.n_chars) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS p,
       CASE WHEN d.n_chars % 2 = 0 THEN CAST(0.58 AS DOUBLE) ELSE CAST(0.42 AS DOUBLE) END AS p_base
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

SQL["calendar"] = """
SELECT o_orderkey AS event_code, 'r' || CAST(o_custkey % 3 AS VARCHAR) AS revision,
       'prov' || CAST(o_custkey % 3 AS VARCHAR) AS provider_code,
       CAST(o_orderdate AS TIMESTAMP) AS scheduled_at,
       CASE WHEN o_orderkey % 71 = 0 THEN o_orderdate + INTERVAL '1' DAY
            ELSE CAST(o_orderdate AS TIMESTAMP) END AS event_time,
       o_orderdate - INTERVAL '1' DAY * CAST(o_orderkey % 90 AS INT) AS first_announced_at,
       o_orderdate - INTERVAL '1' DAY * CAST(o_orderkey % 90 AS INT) + INTERVAL '1' HOUR
         - INTERVAL '2' HOUR * CAST(CASE WHEN o_orderkey % 83 = 0 THEN 1 ELSE 0 END AS INT)
         AS first_seen_at,
       CASE o_orderstatus WHEN 'F' THEN 'SCHEDULED' WHEN 'O' THEN 'SCHEDULED'
            WHEN 'P' THEN 'POSTPONED' ELSE 'CANCELLED' END AS status,
       o_orderkey % 11 <> 4 AS is_current,
       CASE o_custkey % 4 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'ASIA' WHEN 2 THEN 'EUROPE'
            ELSE 'MOON' END AS region,
       CASE WHEN o_orderkey % 37 = 1 THEN 'LICENSE_UNCLEAR' WHEN o_orderkey % 41 = 1 THEN 'NOTE'
            END AS flag,
       CASE WHEN o_orderkey % 43 = 2 THEN 'scope_unclear' ELSE 'SCOPE_A' END AS license_scope
FROM orders"""

SQL["registry"] = """
SELECT 'prov' || CAST(r_regionkey AS VARCHAR) AS provider_code,
       CASE WHEN r_regionkey = 3 THEN 'PENDING' ELSE 'APPROVED' END AS review_status,
       CASE WHEN r_regionkey = 2 THEN TIMESTAMP '2001-06-01 00:00:00'
            ELSE TIMESTAMP '2031-01-01 00:00:00' END AS expires_at,
       TRUE AS display_right, r_regionkey <> 4 AS non_display_algorithm_right,
       TRUE AS derivative_right, TRUE AS cache_right, r_regionkey = 0 AS training_right,
       FALSE AS redistribution_right,
       ['XAFR', 'XAME', 'XASI', 'XEUR', 'XMID'] AS markets,
       CASE WHEN r_regionkey = 1 THEN ['AFRICA', 'AMERICA', 'ASIA']
            ELSE ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'] END AS regions
FROM region"""

DEPENDS = {"facts": ["bars"]}


def unsigned_zero(sql: str) -> str:
    """Write ``round(x, 6)`` as ``(round(x, 6) + 0.0)``, so that -0.0 compares equal to 0.0."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + 5
        while True:
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
            if depth == 0:
                break
        call = sql[start:end]
        out.append(sql[at:start])
        out.append(f"({call} + 0.0)" if call.endswith(", 6)") else call)
        at = end
    return "".join(out) + sql[at:]


def prepend(names: list[str], sql: str) -> str:
    """Put the named views (and what they rest on) in front of a statement as CTEs."""
    sql = unsigned_zero(sql)
    ordered: list[str] = []
    for name in names:
        for item in [*DEPENDS.get(name, []), name]:
            if item not in ordered:
                ordered.append(item)
    if not ordered:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in ordered)
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _hours(n: int):
    return F.expr(f"make_dt_interval(0, {n}, 0, 0)")


def _minutes(n: int):
    return F.expr(f"make_dt_interval(0, 0, {n}, 0)")


def instruments(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("instrument_id"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("industry"),
            F.concat(F.lit("AC"), (key % 5).cast("string")).alias("asset_class"),
            (1 + key % 3).cast("int").alias("liquidity_tier"),
            (key % 17 == 3).alias("leveraged"),
            (key % 19 == 4).alias("inverse"),
            (key % 23 != 5).alias("active"),
            F.concat(F.lit("prov"), (key % 2).cast("string")).alias("provider"),
            F.concat(F.lit("X"), F.substring("r_name", 1, 3)).alias("mic"),
        )
    )


def bars(t: Tables) -> DataFrame:
    ship = F.col("l_shipdate")
    day = (F.year(ship) - 1995) * 365 + (F.month(ship) - 1) * 30 + F.day(ship)
    drift = (day * (F.col("l_suppkey") % 7 - 3)).cast("double") * 0.003

    def price(part, discount):
        return F.round(F.lit(100.0) + (part % 101).cast("double") / 40.0 + F.lit(5.0) * discount + drift, 6)

    # First and last are lines; what is computed of them is computed once a bar.
    sequence = F.struct(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax",
    )
    px = price(F.col("l_partkey"), F.col("l_discount"))
    grouped = t.lineitem.groupBy("l_suppkey", "l_shipdate").agg(
        F.min(sequence).alias("first"), F.max(sequence).alias("last"), F.max(px).alias("high"),
        F.min(px).alias("low"), F.sum("l_quantity").alias("quantity"),
    )
    opened, close = (price(F.col(f"{x}.l_partkey"), F.col(f"{x}.l_discount")) for x in ("first", "last"))
    key, at = F.col("l_suppkey"), ship.cast("timestamp")
    return grouped.select(
        key.alias("instrument_id"),
        (at + _hours(7)).alias("event_time"),
        opened.alias("open"),
        "high",
        "low",
        close.alias("close"),
        close.alias("total_return_close"),
        (F.col("quantity") * 100000).alias("volume"),
        F.round(F.lit(2.0) + F.lit(300.0) * F.col("first.l_tax"), 4).alias("bid_ask_spread_bps"),
        F.when((key * 13 + day) % 211 == 7, 2.0).otherwise(1.0).alias("split_factor"),
        F.when((key * 7 + day) % 89 == 5, 0.6).otherwise(0.0).alias("dividend"),
        F.lit(1.0).alias("fx_rate"),
        ((5 + key % 60).cast("double") / 10000.0).alias("expense_ratio"),
        F.when((key * 31 + day) % 53 == 0, at + _hours(79))
        .otherwise(at + _hours(7) + _minutes(10))
        .alias("available_at"),
        F.lit("v1").alias("revision"),
        F.concat(F.lit("prov"), (key % 2).cast("string")).alias("provider"),
    )


def facts(t: Tables) -> DataFrame:
    """Bars with the full clock set and lineage columns."""
    return bars(t).withColumns(
        {
            "published_at": F.col("available_at"),
            "first_seen_at": F.col("available_at"),
            "as_of": F.col("event_time"),
            "ingested_at": F.col("available_at") + _minutes(1),
            "license_scope": F.lit("SCOPE_A"),
            "data_mode": F.when(F.col("instrument_id") % 29 == 7, "HISTORICAL").otherwise(
                "DEMO_FIXTURE"
            ),
        }
    )


def _event_number() -> F.Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def news(t: Tables) -> DataFrame:
    at, k = F.col("ts").cast("timestamp"), F.col("k")
    return t.events.withColumn("k", _event_number()).select(
        "event_id",
        at.alias("event_time"),
        (at + _minutes(2)).alias("available_at"),
        (k % 5).cast("int").alias("region_key"),
        F.concat(F.lit("AC"), (k % 5).cast("string")).alias("asset_class"),
        ((k % 10).cast("double") / 10.0).alias("relevance"),
        (k % 3 - 1).cast("double").alias("direction"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("severity"),
        (F.lit(0.5) + (k % 6).cast("double") / 10.0).alias("confidence"),
        (F.col("event_type") == "error").alias("flagged"),
        "user_id",
        "k",
    )


def ledger(t: Tables) -> DataFrame:
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    buy = kind == "purchase"
    return (
        t.events.filter(kind.isin("signup", "purchase", "click"))
        .withColumn("k", _event_number())
        .select(
            F.col("user_id").alias("portfolio_id"),
            F.col("event_id").alias("entry_id"),
            F.col("ts").cast("timestamp").alias("occurred_at"),
            F.when(kind == "signup", "OPENING_CASH").when(buy, "BUY").otherwise("DIVIDEND")
            .alias("entry_type"),
            F.when(buy, (k % 10).cast("bigint")).alias("instrument_id"),
            F.when(kind == "signup", 10000.0).when(buy, -value).otherwise(value / 100.0)
            .alias("cash_delta"),
            F.when(buy, (k % 7 + 1).cast("double")).otherwise(0.0).alias("quantity_delta"),
            F.when(buy, value / 1000.0).otherwise(0.0).alias("fee_amount"),
        )
    )


def macro(t: Tables) -> DataFrame:
    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp")
    return (
        t.orders.groupBy("o_orderpriority", month.alias("event_time"), "o_orderstatus")
        .agg(F.max(F.col("o_orderkey") % 400).alias("top"))
        .select(
            F.col("o_orderpriority").alias("series_code"),
            "event_time",
            (F.col("top").cast("double") / 200.0 - 1.0).alias("value"),
            (F.col("event_time") + F.expr("make_dt_interval(40)")).alias("available_at"),
            F.col("o_orderstatus").alias("revision"),
        )
    )


def predictions(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        (((F.col("doc_id") * 37 + F.col("n_chars")) % 101).cast("double") / 100.0).alias("p"),
        F.when(F.col("n_chars") % 2 == 0, 0.58).otherwise(0.42).alias("p_base"),
    )


def calendar(t: Tables) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    announced = at - F.make_dt_interval((key % 90).cast("int"))
    return t.orders.select(
        key.alias("event_code"),
        F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("revision"),
        F.concat(F.lit("prov"), (F.col("o_custkey") % 3).cast("string")).alias("provider_code"),
        at.alias("scheduled_at"),
        F.when(key % 71 == 0, at + _hours(24)).otherwise(at).alias("event_time"),
        announced.alias("first_announced_at"),
        F.when(key % 83 == 0, announced - _hours(1)).otherwise(announced + _hours(1))
        .alias("first_seen_at"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "SCHEDULED")
        .when(F.col("o_orderstatus") == "P", "POSTPONED")
        .otherwise("CANCELLED")
        .alias("status"),
        (key % 11 != 4).alias("is_current"),
        F.when(F.col("o_custkey") % 4 == 0, "AFRICA")
        .when(F.col("o_custkey") % 4 == 1, "ASIA")
        .when(F.col("o_custkey") % 4 == 2, "EUROPE")
        .otherwise("MOON")
        .alias("region"),
        F.when(key % 37 == 1, "LICENSE_UNCLEAR").when(key % 41 == 1, "NOTE").alias("flag"),
        F.when(key % 43 == 2, "scope_unclear").otherwise("SCOPE_A").alias("license_scope"),
    )


def registry(t: Tables) -> DataFrame:
    """Rights of each data provider; one row per region of the input."""
    key = F.col("r_regionkey")
    wide = F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")])
    narrow = F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA")])
    return t.region.select(
        F.concat(F.lit("prov"), key.cast("string")).alias("provider_code"),
        F.when(key == 3, "PENDING").otherwise("APPROVED").alias("review_status"),
        F.when(key == 2, F.lit("2001-06-01T00:00:00Z").cast("timestamp"))
        .otherwise(F.lit("2031-01-01T00:00:00Z").cast("timestamp"))
        .alias("expires_at"),
        F.lit(True).alias("display_right"),
        (key != 4).alias("non_display_algorithm_right"),
        F.lit(True).alias("derivative_right"),
        F.lit(True).alias("cache_right"),
        (key == 0).alias("training_right"),
        F.lit(False).alias("redistribution_right"),
        F.array(*[F.lit(x) for x in ("XAFR", "XAME", "XASI", "XEUR", "XMID")]).alias("markets"),
        F.when(key == 1, narrow).otherwise(wide).alias("regions"),
    )
