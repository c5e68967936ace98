"""Ledger state, valuation, corporate actions, fills and reconciliation queries."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clocks import minutes, point_in_time_slice
from tidemark.functions.hashing import content_key
from tidemark.functions.scalars import r6
from tidemark.operators import integrity, ledger, reports, validate
from tidemark.plans import gating, market, views
from tidemark.plans.registry import query
from tidemark.session import cut_lineage
from tidemark.settings import DEFAULTS

UTC = timezone.utc
AT = datetime(2001, 6, 1, tzinfo=UTC)

# Thirty days of entries stretched over the 2 400 days of the bars.
BOOK_SQL = """
book0 AS (SELECT * EXCLUDE (occurred_at), make_timestamp(788918400000000
    + (epoch_us(occurred_at) - 1704067200000000) * 80) AS occurred_at,
    row_number() OVER (PARTITION BY portfolio_id, entry_type ORDER BY entry_id) AS rn FROM ledger),
book AS (SELECT * FROM book0 WHERE entry_type <> 'OPENING_CASH' OR rn = 1)"""


def stretched(t) -> DataFrame:
    at = F.timestamp_micros(
        F.lit(788918400000000) + (F.unix_micros("occurred_at") - F.lit(1704067200000000)) * 80
    )
    return views.ledger(t).withColumn("occurred_at", at)


def book(t) -> DataFrame:
    """Entries with exactly one opening per portfolio (the first)."""
    entries = stretched(t)
    opening = F.col("entry_type") == "OPENING_CASH"
    rest = [c for c in entries.columns if c not in ("portfolio_id", "entry_id")]
    first = entries.filter(opening).groupBy("portfolio_id").agg(F.min(F.struct("entry_id", *rest)).alias("_first"))
    return entries.filter(~opening).unionByName(first.select("portfolio_id", "_first.*"))


@query(
    "portfolio_state", "D-02 D-17",
    "WITH " + BOOK_SQL + """
    SELECT portfolio_id, round(sum(cash_delta), 6) AS cash, round(sum(fee_amount), 6) AS total_fees,
      sum(CASE WHEN entry_type = 'OPENING_CASH' THEN cash_delta END) AS opening,
      coalesce(sum(cash_delta) / sum(CASE WHEN entry_type = 'OPENING_CASH' THEN cash_delta END) - 1
        <= -0.10, FALSE) AS loss_limit_hit
    FROM book WHERE occurred_at <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY portfolio_id""",
    "ledger",
)
def _portfolio_state(t):
    s = ledger.cash_and_fees(book(t), AT)
    return s.select(
        "portfolio_id", r6(F.col("cash")).alias("cash"), r6(F.col("total_fees")).alias("total_fees"),
        "opening",
        F.coalesce(F.col("cash") / F.col("opening") - 1 <= -DEFAULTS.max_loss, F.lit(False))
        .alias("loss_limit_hit"),
    )


@query(
    "average_cost", "D-15",
    "WITH " + BOOK_SQL + """
    SELECT portfolio_id, instrument_id, sum(quantity_delta) AS quantity,
      round(ln(sum(-cash_delta + fee_amount) / sum(quantity_delta)), 6) AS log_cost
    FROM book WHERE instrument_id IS NOT NULL GROUP BY portfolio_id, instrument_id""",
    "ledger",
)
def _average_cost(t):
    b = book(t)
    fills = b.filter(F.col("entry_type") == "BUY").select(
        "portfolio_id", "instrument_id", (-F.col("cash_delta")).alias("gross_amount"),
        F.col("fee_amount").alias("fee"),
    )
    # The logarithm of nothing is minus infinity, of less no number.
    paid, inf = F.col("average_cost"), float("inf")
    logged = F.when(paid > 0, F.log(paid)).when(paid == 0, -inf).otherwise(float("nan"))
    return ledger.average_cost(fills, ledger.positions(b)).select(
        "portfolio_id", "instrument_id", "quantity", r6(F.when(F.col("cost").isNotNull(), logged)).alias("log_cost")
    )


@query(
    "position_at_bars", "C-09 C-08",
    "WITH " + BOOK_SQL + """,
    req AS (SELECT h.portfolio_id, b.instrument_id, event_time FROM bars b JOIN (SELECT DISTINCT
        portfolio_id, instrument_id FROM book WHERE instrument_id IS NOT NULL) h
        ON h.instrument_id = b.instrument_id WHERE dividend <> 0),
    cum AS (SELECT portfolio_id, instrument_id, occurred_at, sum(quantity_delta) OVER (PARTITION BY
        portfolio_id, instrument_id ORDER BY occurred_at) AS q FROM book
        WHERE instrument_id IS NOT NULL)
    SELECT r.portfolio_id, r.instrument_id, strftime(r.event_time, '%Y-%m-%d') AS day,
      coalesce(c.q, 0) AS quantity
    FROM req r ASOF LEFT JOIN cum c ON c.portfolio_id = r.portfolio_id AND c.instrument_id =
      r.instrument_id AND c.occurred_at <= r.event_time - INTERVAL '331' MINUTE""",
    "bars ledger",
)
def _position_at_bars(t):
    b = book(t)
    held = b.filter(F.col("instrument_id").isNotNull()).select("portfolio_id", "instrument_id").distinct()
    paid = views.bars(t).filter("dividend <> 0").select("instrument_id", "event_time").withColumn(
        "at", F.col("event_time") - minutes(ledger.ENTITLED_BEFORE_EVENT)
    )
    out = ledger.position_at(held.join(paid, "instrument_id"), b, "at")
    return out.select("portfolio_id", "instrument_id",
                      F.date_format("event_time", "yyyy-MM-dd").alias("day"), "quantity")


NAV_SQL = BOOK_SQL + """,
bk AS (SELECT * FROM book WHERE occurred_at <= TIMESTAMP '2001-06-01 00:00:00'),
kb AS (SELECT * FROM facts WHERE greatest(event_time, available_at)
         <= TIMESTAMP '2001-06-01 00:00:00'),
held AS (SELECT portfolio_id, instrument_id FROM bk WHERE instrument_id IS NOT NULL
         GROUP BY 1, 2 HAVING abs(sum(quantity_delta)) > 1e-9),
tm AS (SELECT DISTINCT portfolio_id, event_time AS t FROM held JOIN kb
         ON kb.instrument_id = held.instrument_id),
cells AS (SELECT tm.portfolio_id, tm.t, held.instrument_id FROM tm JOIN held
         ON held.portfolio_id = tm.portfolio_id),
cq AS (SELECT portfolio_id, instrument_id, occurred_at, sum(quantity_delta) OVER (PARTITION BY
         portfolio_id, instrument_id ORDER BY occurred_at) AS q FROM bk
       WHERE instrument_id IS NOT NULL),
cc AS (SELECT portfolio_id, occurred_at, sum(cash_delta) OVER (PARTITION BY portfolio_id
         ORDER BY occurred_at) AS cash FROM bk),
c1 AS (SELECT c.*, cq.q FROM cells c ASOF LEFT JOIN cq ON cq.portfolio_id = c.portfolio_id
         AND cq.instrument_id = c.instrument_id AND cq.occurred_at <= c.t),
c2 AS (SELECT c1.*, kb.close * kb.fx_rate AS px FROM c1 ASOF LEFT JOIN kb
         ON kb.instrument_id = c1.instrument_id AND kb.event_time <= c1.t),
m AS (SELECT portfolio_id, t, sum(coalesce(q * px, 0)) AS marked FROM c2 GROUP BY 1, 2),
nav AS (SELECT m.portfolio_id, t, marked + coalesce(cash, 0) AS nav FROM m ASOF LEFT JOIN cc
         ON cc.portfolio_id = m.portfolio_id AND cc.occurred_at <= m.t)"""


@query(
    "nav_history", "H-08 C-08",
    "WITH " + NAV_SQL + """
    SELECT portfolio_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS valuation_time, round(nav, 6) AS nav
    FROM nav""",
    "facts ledger",
)
def _nav_history(t):
    known = point_in_time_slice(market.staged_bars(t), AT)
    out = ledger.nav_history(book(t), known, AT)
    return out.select("portfolio_id", market.stamp("valuation_time"), r6(F.col("nav")).alias("nav"))


@query(
    "portfolio_valuation", "H-08 D-17",
    "WITH " + NAV_SQL + """,
    pk AS (SELECT *, max(nav) OVER (PARTITION BY portfolio_id ORDER BY t) AS peak FROM nav),
    tr AS (SELECT portfolio_id, arg_max(nav, t) AS marked_nav, min(nav / nullif(peak, 0) - 1) AS dd FROM pk
           GROUP BY 1),
    lt AS (SELECT instrument_id, max(event_time) AS last FROM kb GROUP BY 1),
    cm AS (SELECT portfolio_id, min(last) = max(last) AS common FROM held JOIN lt
           ON lt.instrument_id = held.instrument_id GROUP BY 1)
    SELECT tr.portfolio_id, round(marked_nav, 6) AS marked_nav, round(dd, 6) AS max_drawdown,
      CASE WHEN common THEN round(marked_nav, 6) END AS nav, common AS available
    FROM tr JOIN cm ON cm.portfolio_id = tr.portfolio_id""",
    "facts ledger",
)
def _portfolio_valuation(t):
    known = point_in_time_slice(market.staged_bars(t), AT)
    out = ledger.valuation(book(t), known, AT).filter(F.col("holdings").isNotNull())
    return out.select(
        "portfolio_id", r6(F.col("marked_nav")).alias("marked_nav"),
        r6(F.col("max_drawdown")).alias("max_drawdown"), r6(F.col("nav")).alias("nav"), "available",
    )


# Books in every condition: opened with nothing, with a debt, with little; without purchases; with a
# holding that no master knows.
GATE_SQL = BOOK_SQL + """,
gbook AS (SELECT * EXCLUDE (cash_delta, instrument_id),
    CASE WHEN entry_type <> 'OPENING_CASH' THEN cash_delta WHEN portfolio_id % 7 = 0 THEN 0
         WHEN portfolio_id % 7 = 1 THEN -500 WHEN portfolio_id % 7 < 5 THEN 300
         ELSE 20000 END::DOUBLE AS cash_delta,
    CASE WHEN portfolio_id % 13 = 5 AND instrument_id = 3 THEN 1000003 ELSE instrument_id END
      AS instrument_id
  FROM book WHERE entry_type <> 'BUY' OR portfolio_id % 17 <> 9),
monthly AS (SELECT instrument_id, date_trunc('month', event_time) + INTERVAL '27' DAY AS event_time,
    arg_max(close, event_time) AS close, 1.0::DOUBLE AS fx_rate FROM facts
  WHERE event_time < TIMESTAMP '2001-06-01 00:00:00' GROUP BY 1, 2),
mb AS (SELECT *, event_time AS available_at FROM (SELECT * FROM monthly UNION ALL
  SELECT instrument_id + 1000000, event_time, close, fx_rate FROM monthly WHERE instrument_id = 3))
""" + NAV_SQL[len(BOOK_SQL):].replace("FROM facts", "FROM mb").replace("FROM book ", "FROM gbook ") + """,
pk AS (SELECT *, max(nav) OVER (PARTITION BY portfolio_id ORDER BY t) AS peak FROM nav),
tr AS (SELECT portfolio_id, arg_max(nav, t) AS nav, min(nav / nullif(peak, 0) - 1) AS dd FROM pk
  GROUP BY 1),
lt AS (SELECT instrument_id, max(event_time) AS last, arg_max(close, event_time) AS px FROM kb GROUP BY 1),
cm AS (SELECT portfolio_id, coalesce(min(last) = max(last) AND bool_and(last IS NOT NULL), FALSE) AS ok
  FROM held LEFT JOIN lt ON lt.instrument_id = held.instrument_id GROUP BY 1),
op AS (SELECT portfolio_id, sum(cash_delta) AS cash,
    sum(CASE WHEN entry_type = 'OPENING_CASH' THEN cash_delta END) AS opening FROM bk GROUP BY 1),
vg AS (SELECT op.portfolio_id, cm.portfolio_id IS NULL AS flat, coalesce(ok, TRUE) AS ok,
    CASE WHEN cm.portfolio_id IS NULL THEN cash WHEN ok THEN nav END AS nav, dd,
    CASE WHEN cm.portfolio_id IS NULL THEN opening WHEN coalesce(opening, 0) = 0 THEN 1000000
      ELSE opening END AS funds
  FROM op LEFT JOIN cm ON cm.portfolio_id = op.portfolio_id LEFT JOIN tr ON tr.portfolio_id = op.portfolio_id),
gw AS (SELECT held.portfolio_id, held.instrument_id, asset_class, industry, region, i.name IS NULL AS unknown,
    q * px / vg.nav AS weight
  FROM (SELECT portfolio_id, instrument_id, sum(quantity_delta) AS q FROM bk WHERE instrument_id IS NOT NULL
        GROUP BY 1, 2 HAVING abs(sum(quantity_delta)) > 1e-9) held
  JOIN vg ON vg.portfolio_id = held.portfolio_id LEFT JOIN lt ON lt.instrument_id = held.instrument_id
  LEFT JOIN instruments i ON i.instrument_id = held.instrument_id),
un AS (SELECT portfolio_id, bool_or(unknown) AS unknown FROM gw GROUP BY 1),
gbr AS (SELECT portfolio_id, 0 AS level, 'SINGLE_ETF_CAP:' || instrument_id AS rule FROM gw WHERE weight > 0.10 + 1e-9
  UNION ALL SELECT portfolio_id, 1, 'ASSET_CLASS_CAP:' || asset_class FROM gw
    GROUP BY portfolio_id, asset_class HAVING sum(weight) > 0.45 + 1e-9
  UNION ALL SELECT portfolio_id, 2, 'INDUSTRY_CAP:' || industry FROM gw
    GROUP BY portfolio_id, industry HAVING sum(weight) > 0.30 + 1e-9
  UNION ALL SELECT portfolio_id, 3, 'REGION_CAP:' || region FROM gw
    GROUP BY portfolio_id, region HAVING sum(weight) > 0.60 + 1e-9
  UNION ALL SELECT portfolio_id, 4, 'CASH_FLOOR' FROM gw GROUP BY portfolio_id HAVING sum(weight) > 0.80 + 1e-9),
grules AS (SELECT vg.portfolio_id, vg.nav, vg.dd, list_concat(list_filter([
    CASE WHEN NOT flat AND (vg.nav IS NULL OR dd IS NULL) THEN 'PORTFOLIO_VALUATION_UNAVAILABLE' END,
    CASE WHEN funds <= 0 AND (flat OR vg.nav IS NOT NULL) THEN 'PORTFOLIO_OPENING_CAPITAL_INVALID' END,
    CASE WHEN funds > 0 AND vg.nav / funds - 1 <= -0.10 THEN 'PORTFOLIO_MAX_SIMULATION_LOSS' END,
    CASE WHEN NOT flat AND vg.nav IS NOT NULL AND dd <= -0.04 THEN 'PORTFOLIO_MAX_DRAWDOWN' END,
    CASE WHEN NOT flat AND vg.nav IS NOT NULL AND unknown THEN 'PORTFOLIO_INSTRUMENT_MASTER_MISSING' END],
    lambda x: x IS NOT NULL),
    CASE WHEN NOT flat AND vg.nav IS NOT NULL AND NOT unknown THEN coalesce((SELECT list('PORTFOLIO_' || rule
      ORDER BY level, rule) FROM gbr WHERE gbr.portfolio_id = vg.portfolio_id), []) ELSE [] END) AS rules
  FROM vg LEFT JOIN un ON un.portfolio_id = vg.portfolio_id)"""
GATE_LIMITS = replace(DEFAULTS, max_drawdown=0.04)


def gate_book(t) -> DataFrame:
    c, p = F.col, F.col("portfolio_id") % 7
    opening = (
        F.when(p == 0, 0.0).when(p == 1, -500.0).when(p < 5, 300.0).otherwise(20000.0)
    )
    lost = (c("portfolio_id") % 13 == 5) & (c("instrument_id") == 3)
    return book(t).filter((c("entry_type") != "BUY") | (c("portfolio_id") % 17 != 9)).withColumns({
        "cash_delta": F.when(c("entry_type") == "OPENING_CASH", opening).otherwise(c("cash_delta")),
        "instrument_id": F.when(lost, F.lit(1000003).cast("bigint")).otherwise(c("instrument_id")),
    })


def monthly_bars(t) -> DataFrame:
    """The last price of each month at one common time, so that books can be valued at all."""
    at = F.date_trunc("month", "event_time") + F.make_dt_interval(F.lit(27))
    known = views.facts(t).filter(F.col("event_time") < F.lit("2001-06-01T00:00:00Z").cast("timestamp"))
    monthly = cut_lineage(known.groupBy("instrument_id", at.alias("event_time")).agg(
        F.max_by("close", known["event_time"]).alias("close")
    ))
    twin = monthly.filter("instrument_id = 3").withColumn("instrument_id", F.col("instrument_id") + 1000000)
    clocks = ("published_at", "first_seen_at", "available_at", "as_of")
    return monthly.unionByName(twin).withColumns(
        {**{x: F.col("event_time") for x in clocks}, "fx_rate": F.lit(1.0), "revision": F.lit("v1")}
    )


def gated(t) -> DataFrame:
    return ledger.portfolio_gate(gate_book(t), monthly_bars(t), views.instruments(t), GATE_LIMITS, AT)


@query(
    "portfolio_gate", "H-09",
    "WITH " + GATE_SQL + """
    SELECT portfolio_id, round(nav, 6) AS nav, round(dd, 6) AS max_drawdown,
      array_to_string(rules, ',') AS rules,
      dense_rank() OVER (ORDER BY array_to_string(rules, ',') || CASE WHEN dd IS NULL THEN '-' ELSE '+' END)
        AS context
    FROM grules""",
    "facts ledger instruments",
)
def _portfolio_gate(t):
    """Books fed by their valuation. Equal context numbers stand for equal context hashes."""
    out = cut_lineage(gated(t))
    kinds = out.groupBy("context_hash").agg(F.min(F.concat(
        F.array_join("rules", ","), F.when(F.col("holdings").isNull() | F.col("max_drawdown").isNull(), "-").otherwise("+")
    )).alias("kind"))
    number = kinds.withColumn("context", F.dense_rank().over(Window.orderBy("kind")).cast("bigint"))
    return out.join(number, "context_hash").select(
        "portfolio_id", r6(F.col("nav")).alias("nav"),
        F.when(F.col("holdings").isNotNull(), r6(F.col("max_drawdown"))).alias("max_drawdown"),
        F.array_join("rules", ",").alias("rules"), "context",
    )


@query(
    "corporate_action_entries", "H-10",
    "WITH " + BOOK_SQL + """,
    act AS (SELECT instrument_id, event_time, event_time - INTERVAL '331' MINUTE AS eff, split_factor,
        dividend, fx_rate FROM facts WHERE (split_factor <> 1 OR dividend <> 0)
        AND greatest(event_time, available_at) <= TIMESTAMP '2001-06-01 00:00:00'),
    pos AS (SELECT h.portfolio_id, a.instrument_id, a.event_time, a.eff, a.split_factor, a.dividend,
        a.fx_rate, (SELECT sum(b.quantity_delta * coalesce((SELECT product(s.split_factor) FROM act s
            WHERE s.instrument_id = a.instrument_id AND s.eff >= b.occurred_at AND s.eff < a.eff), 1))
          FROM book b WHERE b.portfolio_id = h.portfolio_id AND b.instrument_id = a.instrument_id
            AND b.occurred_at <= a.eff) AS position
      FROM act a JOIN (SELECT DISTINCT portfolio_id, instrument_id FROM book
                       WHERE instrument_id IS NOT NULL) h ON h.instrument_id = a.instrument_id)
    SELECT portfolio_id, instrument_id, strftime(event_time, '%Y-%m-%d') AS day, 'DIVIDEND'
        AS entry_type, round(position * dividend * fx_rate, 6) AS cash_delta, 0.0::DOUBLE
        AS quantity_delta FROM pos WHERE position > 0 AND dividend <> 0
    UNION ALL SELECT portfolio_id, instrument_id, strftime(event_time, '%Y-%m-%d'), 'SPLIT',
        0.0::DOUBLE, round(position * (split_factor - 1), 6) FROM pos
      WHERE position > 0 AND split_factor <> 1""",
    "facts ledger",
)
def _corporate_action_entries(t):
    actions = ledger.corporate_actions(market.staged_bars(t), AT)
    out = ledger.corporate_action_entries(book(t), actions)
    return out.select(
        "portfolio_id", "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        "entry_type", r6(F.col("cash_delta")).alias("cash_delta"),
        r6(F.col("quantity_delta")).alias("quantity_delta"),
    )


ORDER_SQL = BOOK_SQL + """,
so AS (SELECT entry_id AS signal_id, portfolio_id, instrument_id, occurred_at AS data_as_of,
         occurred_at + INTERVAL '1' HOUR * CAST(entry_id % 60 AS INT) AS earliest_fill
       FROM book0 WHERE entry_type = 'BUY')"""


def order_signals(t) -> DataFrame:
    return stretched(t).filter(F.col("entry_type") == "BUY").select(
        F.col("entry_id").alias("signal_id"), "portfolio_id", "instrument_id",
        F.col("occurred_at").alias("data_as_of"),
        (F.col("occurred_at") + F.make_dt_interval(hours=(F.col("entry_id") % 60).cast("int")))
        .alias("earliest_fill"),
    )


@query(
    "next_bar", "C-06",
    "WITH " + ORDER_SQL + """,
    xb AS (SELECT instrument_id, event_time, open FROM bars
           WHERE available_at <= event_time + INTERVAL '30' MINUTE)
    SELECT signal_id, (SELECT strftime(min(event_time), '%Y-%m-%d %H:%M:%S') FROM xb
        WHERE xb.instrument_id = so.instrument_id AND event_time > data_as_of
          AND event_time - INTERVAL '330' MINUTE > earliest_fill) AS bar_time,
      (SELECT round(arg_min(open, event_time), 6) FROM xb WHERE xb.instrument_id = so.instrument_id
          AND event_time > data_as_of AND event_time - INTERVAL '330' MINUTE > earliest_fill) AS open
    FROM so""",
    "bars ledger",
)
def _next_bar(t):
    out = ledger.next_executable_bar(order_signals(t), market.staged_bars(t))
    return out.select("signal_id", market.stamp("bar_time"), r6(F.col("open")).alias("open"))


@query("allocation", "H-11 H-12")
def _allocation(t):
    """Candidates of each portfolio and month, filled at the next bar."""
    priced = ledger.next_executable_bar(order_signals(t), market.staged_bars(t))
    k = F.col("signal_id")
    candidates = priced.join(views.instruments(t), "instrument_id").select(
        "portfolio_id", F.date_trunc("month", "data_as_of").alias("decided_at"), "signal_id",
        "instrument_id", "asset_class", "industry", "region",
        ((k * 7 % 100).cast("double") / 100.0).alias("composite_score"),
        F.when(k % 9 == 0, 0.0).otherwise(0.02 + (k % 8).cast("double") / 100.0)
        .alias("risk_budget_max"),
        ((k % 21).cast("double") / 10.0 - 1.0).alias("news_score"), "open", "fx_rate",
    )
    books = ledger.cash_and_fees(book(t)).select(
        "portfolio_id", F.lit(1_000_000.0).alias("nav"), F.lit(600_000.0).alias("cash"),
        F.array(
            F.struct(
                F.lit(0).cast("bigint").alias("instrument_id"), F.lit(0.03).alias("weight"),
                F.lit("AC0").alias("asset_class"), F.lit("NATION_0").alias("industry"),
                F.lit("AFRICA").alias("region"),
            )
        ).alias("holdings"),
    )
    out = ledger.allocate(candidates, books, DEFAULTS)
    return out.select("portfolio_id", market.stamp("decided_at"), "signal_id", "status",
                      r6(F.col("increment")).alias("increment"), "quantity",
                      r6(F.col("gross")).alias("gross"))


def chain_tables(t) -> dict:
    """Decisions, fills and entries derived from purchases, with defects of every kind."""
    buys = t.events.filter(F.col("event_type") == "purchase").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    )
    e, k = F.col("event_id"), F.col("k")
    at = F.col("ts").cast("timestamp")
    decisions = buys.select(
        e.alias("decision_id"), F.when(k % 19 == 3, e - e % 2).otherwise(e).alias("signal_id"),
        F.when(k % 7 == 0, "SKIPPED_CASH").otherwise("FILLED").alias("status"), at.alias("decided_at"),
        F.col("user_id").alias("instrument_id"),
    )
    fills = buys.filter(k % 7 != 1).select(
        e.alias("fill_id"), F.when(k % 23 == 5, -e).otherwise(e).alias("decision_id"),
        (at + minutes(60)).alias("filled_at"), (k % 9 + 1).cast("double").alias("quantity"),
        F.col("value").alias("price"), F.lit(1.0).alias("fx_rate"),
        ((k % 9 + 1) * F.col("value") + F.when(k % 31 == 2, 0.5).otherwise(0.0)).alias("gross"),
        (F.col("value") / 1000.0).alias("fee"),
    )
    entries = buys.filter(k % 11 != 1).select(
        e.alias("entry_id"),
        F.when(k % 13 == 1, None).when(k % 17 == 1, e + 1000000).otherwise(e).alias("fill_id"),
        F.lit("BUY").alias("entry_type"), F.col("user_id").alias("instrument_id"),
        (-((k % 9 + 1) * F.col("value") + F.col("value") / 1000.0)).alias("cash_delta"),
        (k % 9 + F.when(k % 37 == 4, 2).otherwise(1)).cast("double").alias("quantity_delta"),
    )
    signals = buys.filter(k % 29 != 6).select(e.alias("signal_id"))
    return {"decisions": decisions, "fills": fills, "entries": entries, "signals": signals}


CHAIN_SQL = """
pb AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
       WHERE event_type = 'purchase'),
dc AS (SELECT event_id AS decision_id, CASE WHEN k % 19 = 3 THEN event_id - event_id % 2
         ELSE event_id END AS signal_id, CASE WHEN k % 7 = 0 THEN 'SKIPPED_CASH' ELSE 'FILLED' END
         AS status FROM pb),
fl AS (SELECT event_id AS fill_id, CASE WHEN k % 23 = 5 THEN -event_id ELSE event_id END
         AS decision_id, ts + INTERVAL '60' MINUTE AS filled_at, CAST(k % 9 + 1 AS DOUBLE)
         AS quantity, value AS price, (k % 9 + 1) * value + CASE WHEN k % 31 = 2 THEN 0.5 ELSE 0 END
         AS gross, value / 1000.0::DOUBLE AS fee FROM pb WHERE k % 7 <> 1),
en AS (SELECT event_id AS entry_id, CASE WHEN k % 13 = 1 THEN NULL WHEN k % 17 = 1
         THEN event_id + 1000000 ELSE event_id END AS fill_id, -((k % 9 + 1) * value
         + value / 1000.0::DOUBLE) AS cash_delta, CAST(k % 9 + CASE WHEN k % 37 = 4 THEN 2 ELSE 1 END
         AS DOUBLE) AS quantity_delta FROM pb WHERE k % 11 <> 1),
si AS (SELECT event_id AS signal_id FROM pb WHERE k % 29 <> 6)"""


@query(
    "decided_fills", "C-03",
    "WITH " + CHAIN_SQL + """
    SELECT fill_id, signal_id, strftime(filled_at, '%Y-%m-%d %H:%M:%S') AS filled_at
    FROM fl JOIN dc ON dc.decision_id = fl.decision_id""",
)
def _decided_fills(t):
    c = chain_tables(t)
    return ledger.fills_in_order(c["decisions"], c["fills"]).select(
        "fill_id", "signal_id", market.stamp("filled_at")
    )


@query(
    "chain_reconcile", "C-04",
    "WITH " + CHAIN_SQL + """
    SELECT fill_id AS object_id, 'fill_booked_twice' AS kind FROM en WHERE fill_id IS NOT NULL
      GROUP BY fill_id HAVING count(*) > 1
    UNION ALL SELECT entry_id, 'entry_without_fill' FROM en WHERE fill_id IS NULL
    UNION ALL SELECT entry_id, 'entry_fill_missing' FROM en WHERE fill_id IS NOT NULL
      AND fill_id NOT IN (SELECT fill_id FROM fl)
    UNION ALL SELECT fill_id, 'fill_without_entry' FROM fl WHERE fill_id NOT IN
      (SELECT fill_id FROM en WHERE fill_id IS NOT NULL)
    UNION ALL SELECT fill_id, 'fill_decision_missing' FROM fl WHERE decision_id NOT IN
      (SELECT decision_id FROM dc)
    UNION ALL SELECT decision_id, 'decision_signal_missing' FROM dc WHERE signal_id NOT IN
      (SELECT signal_id FROM si)
    UNION ALL SELECT dc.decision_id, 'status_and_fills_differ' FROM dc LEFT JOIN (SELECT decision_id,
        count(*) AS n FROM fl GROUP BY 1) f ON f.decision_id = dc.decision_id
      WHERE coalesce(n, 0) > 1 OR (status = 'FILLED') <> (coalesce(n, 0) = 1)
    UNION ALL SELECT signal_id, 'signal_decided_twice' FROM dc GROUP BY 1 HAVING count(*) > 1""",
)
def _chain_reconcile(t):
    c = chain_tables(t)
    return ledger.reconcile_chain(c["entries"], c["fills"], c["decisions"], c["signals"])


@query(
    "entry_rules", "I-06",
    "WITH " + CHAIN_SQL + """,
    x AS (SELECT en.*, fl.quantity, fl.price, fl.gross, fl.fee FROM en LEFT JOIN fl
          ON fl.fill_id = en.fill_id)
    SELECT 'type_unknown' AS rule, CAST(0 AS BIGINT) AS violations
    UNION ALL SELECT 'buy_values', count(*) FILTER (WHERE coalesce(quantity <= 0 OR price <= 0
        OR gross <= 0 OR fee < 0, TRUE)) FROM x
    UNION ALL SELECT 'buy_gross', count(*) FILTER (WHERE coalesce(abs(gross - quantity * price) >
        greatest(1e-9 * greatest(abs(gross), abs(quantity * price)), 1e-6), TRUE)) FROM x
    UNION ALL SELECT 'buy_cash', count(*) FILTER (WHERE coalesce(abs(cash_delta + gross + fee) >
        greatest(1e-9 * greatest(abs(cash_delta), abs(gross + fee)), 1e-6), TRUE)) FROM x
    UNION ALL SELECT 'buy_quantity', count(*) FILTER (WHERE coalesce(abs(quantity_delta - quantity) >
        1e-6, TRUE)) FROM x
    UNION ALL SELECT 'opening_shape', 0 UNION ALL SELECT 'dividend_shape', 0
    UNION ALL SELECT 'split_shape', 0 UNION ALL SELECT 'loss_shape', 0""",
)
def _entry_rules(t):
    c = chain_tables(t)
    joined = c["entries"].join(c["fills"].drop("decision_id", "filled_at"), "fill_id", "left")
    return validate.count_violations(joined, ledger.entry_rules()).select("rule", "violations")


@query(
    "opening_rules", "H-15",
    """SELECT DISTINCT e.user_id AS portfolio_id, CASE WHEN n IS NULL THEN 'INSERT'
         WHEN n = 1 THEN 'KEEP' ELSE 'VIOLATION' END AS action
       FROM events e LEFT JOIN (SELECT portfolio_id, count(*) AS n FROM ledger WHERE entry_type =
         'OPENING_CASH' AND entry_id % 9 = 0 GROUP BY 1) o ON o.portfolio_id = e.user_id""",
    "ledger",
)
def _opening_rules(t):
    entries = views.ledger(t).filter(
        (F.col("entry_type") != "OPENING_CASH") | (F.col("entry_id") % 9 == 0)
    )
    everyone = t.events.select(F.col("user_id").alias("portfolio_id"))
    return ledger.opening_entries(everyone, entries, 10000.0)


VERSION_SQL = """
ks AS (SELECT event_id AS signal_id, user_id AS instrument_id, k,
    sha256(user_id || ':' || (k % 20)) AS key FROM news),
st0 AS (SELECT key, instrument_id, min(signal_id) AS signal_id, max(signal_id) AS newest FROM ks
        WHERE k < 60 GROUP BY 1, 2),
st AS (SELECT *, newest = max(newest) OVER (PARTITION BY instrument_id) AS cur FROM st0),
fr AS (SELECT instrument_id, arg_max(key, signal_id) AS key, max(signal_id) AS signal_id FROM ks
       WHERE k >= 60 GROUP BY 1)"""


@query(
    "signal_versions", "H-06",
    "WITH " + VERSION_SQL + """
    SELECT fr.instrument_id, fr.signal_id, CASE WHEN st.key IS NULL THEN 'NEW' WHEN cur THEN 'REUSED'
        ELSE 'REACTIVATED' END AS action FROM fr LEFT JOIN st ON st.key = fr.key
    UNION ALL SELECT st.instrument_id, st.signal_id, 'SUPERSEDED' FROM st JOIN fr
        ON fr.instrument_id = st.instrument_id WHERE cur AND st.key <> fr.key""",
    "news",
)
def _signal_versions(t):
    k = F.col("k")
    rows = views.news(t).select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("instrument_id"), k,
        content_key(F.col("user_id"), k % 20).alias("idempotency_key"),
    )
    stored = rows.filter(k < 60).groupBy("idempotency_key", "instrument_id").agg(
        F.min("signal_id").alias("signal_id"), F.max("signal_id").alias("newest")
    )
    top = stored.groupBy("instrument_id").agg(F.max("newest").alias("_top"))
    stored = stored.join(top, "instrument_id").withColumn(
        "is_current", F.col("newest") == F.col("_top")
    )
    fresh = rows.filter(k >= 60).groupBy("instrument_id").agg(
        F.max_by("idempotency_key", "signal_id").alias("idempotency_key"),
        F.max("signal_id").alias("signal_id"),
    )
    return ledger.version_signals(stored, fresh)


@query(
    "replay_guard", "H-13",
    """WITH s AS (SELECT event_id AS signal_id, user_id AS instrument_id, date_trunc('day', ts) AS d,
             event_id % 3 = 0 AS decided FROM events),
       g AS (SELECT instrument_id, d, min(signal_id) AS a, max(signal_id) AS b FROM s WHERE decided
             GROUP BY 1, 2)
       SELECT signal_id, CASE WHEN a <> signal_id OR b <> signal_id THEN
           'CROSS_VERSION_DECISION_REPLAY_BLOCKED' WHEN decided THEN 'ALREADY_DECIDED' ELSE 'NEW' END
           AS replay FROM s LEFT JOIN g ON g.instrument_id = s.instrument_id AND g.d = s.d""",
)
def _replay_guard(t):
    s = t.events.select(
        F.col("event_id").alias("signal_id"), F.col("user_id").alias("instrument_id"),
        F.date_trunc("day", "ts").alias("decided_at"),
    )
    return ledger.replay_guard(s, s.filter(F.col("signal_id") % 3 == 0)).select("signal_id", "replay")


@query(
    "replay_equality", "I-11",
    "WITH " + BOOK_SQL + """
    SELECT 'stored' AS side, portfolio_id FROM book WHERE occurred_at
        <= TIMESTAMP '2001-06-01 00:00:00' AND portfolio_id % 40 = 3 GROUP BY 2
    UNION ALL SELECT 'replayed', portfolio_id FROM book WHERE occurred_at
        <= TIMESTAMP '2001-06-01 00:00:00' AND portfolio_id % 40 = 3 GROUP BY 2""",
    "ledger",
)
def _replay_equality(t):
    now = ledger.cash_and_fees(book(t), AT).select(
        "portfolio_id", F.round("total_fees", 6).alias("fees")
    )
    stored = now.withColumn(
        "fees", F.when(F.col("portfolio_id") % 40 == 3, F.col("fees") + 1).otherwise(F.col("fees"))
    )
    return integrity.differences(stored, now).select("side", "portfolio_id")


@query(
    "run_summary", "D-18 D-16",
    "WITH " + BOOK_SQL + "," + gating.SIGNALS_SQL + """
    SELECT (SELECT count(*) FROM bars) AS fact_count, (SELECT count(*) FROM bars WHERE greatest(
        event_time, available_at) <= TIMESTAMP '2001-06-01 00:00:00') AS known_fact_count,
      (SELECT count(DISTINCT instrument_id) FROM bars) AS instrument_count,
      (SELECT count(*) FROM macro) AS macro_fact_count,
      (SELECT round(sum(cash_delta), 4) FROM book) AS cash,
      (SELECT count(*) FROM (SELECT 1 FROM book WHERE instrument_id IS NOT NULL
        GROUP BY portfolio_id, instrument_id HAVING abs(sum(quantity_delta)) > 1e-9) p)
        AS position_count,
      (SELECT round(sum(fee_amount), 4) FROM book) AS total_fees,
      (SELECT count(*) FROM book WHERE entry_type = 'BUY') AS fill_count,
      (SELECT count(*) FROM sg WHERE is_current) AS signal_count,
      (SELECT count(*) FROM sg WHERE is_current AND state LIKE '%CANDIDATE%') AS candidate_count,
      (SELECT count(*) FROM sg WHERE is_current AND state IN ('BLOCKED_BY_RISK', 'DATA_STALE')) AS blocked_count,
      (SELECT arg_max(data_mode, signal_id) FROM sg) AS data_mode""",
    "bars ledger macro news",
)
def _run_summary(t):
    facts = views.facts(t)
    known = point_in_time_slice(facts, AT, strict=False)
    b = book(t)
    one = lambda df, c: df.agg(c.alias("x")).scalar()
    signals = gating.signal_history(t)
    state, current = F.col("state"), signals.filter("is_current")
    return facts.agg(
        F.count("*").alias("fact_count"), F.count_distinct("instrument_id").alias("instrument_count")
    ).select(
        "fact_count", one(known, F.count("*")).alias("known_fact_count"), "instrument_count",
        one(views.macro(t), F.count("*")).alias("macro_fact_count"),
        (F.round(one(b, F.sum("cash_delta")), 4) + F.lit(0.0)).alias("cash"),
        one(ledger.positions(b), F.count("*")).alias("position_count"),
        (F.round(one(b, F.sum("fee_amount")), 4) + F.lit(0.0)).alias("total_fees"),
        one(b, F.count_if(F.col("entry_type") == "BUY")).alias("fill_count"),
        one(current, F.count("*")).alias("signal_count"),
        one(current, F.count_if(state.contains("CANDIDATE"))).alias("candidate_count"),
        one(current, F.count_if(state.isin(*reports.BLOCKED_STATES))).alias("blocked_count"),
        one(signals, F.max_by("data_mode", "signal_id")).alias("data_mode"),
    )
