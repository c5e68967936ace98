"""Facts, clocks, rolling windows, factors and signal records over market bars."""

from __future__ import annotations

import math
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import (
    CLOCKS, causal_rows, clock_violations, cutoff, execution_mask, known_at, minutes,
    point_in_time_slice,
)
from tidemark.functions.scalars import r6
from tidemark.operators import factors, gates, model, news, validate
from tidemark.operators.crosssection import capped_weights, exact_median, percentile_rank
from tidemark.operators.ordered import (
    Running, array_frames, frames, last_rows, latest_version, month, ordinals, running,
)
from tidemark.plans import views
from tidemark.plans.registry import query
from tidemark.session import cut_lineage
from tidemark.settings import Limits

UTC = timezone.utc
CUT = datetime(1998, 6, 1, tzinfo=UTC)
AT = datetime(2001, 6, 1, tzinfo=UTC)
STALE = 14400
YEAR = math.sqrt(252)


def stamp(c: str, name: str | None = None):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or c)


def staged_bars(t, *columns: str) -> DataFrame:
    """The bars as a stored snapshot: scans over it prune columns, and no branch repeats the
    aggregation that derives bars from lines. With ``columns`` only these are derived and written."""
    facts = views.facts(t)
    return cut_lineage(facts.select(*columns) if columns else facts)


# ------------------------------------------------------------------ contracts and clocks

RAW_SQL = """
SELECT l_suppkey AS instrument_id, l_shipdate + INTERVAL '7' HOUR AS event_time,
       CASE WHEN l_partkey % 199 <> 0 THEN l_shipdate + INTERVAL '425' MINUTE END AS published_at,
       CASE WHEN l_partkey % 101 = 3 THEN l_shipdate + INTERVAL '419' MINUTE
            ELSE l_shipdate + INTERVAL '426' MINUTE END AS first_seen_at,
       l_shipdate + INTERVAL '418' MINUTE + INTERVAL '1' MINUTE * CAST(l_quantity AS INT)
         AS available_at,
       l_shipdate + INTERVAL '7' HOUR AS as_of,
       l_shipdate + INTERVAL '418' MINUTE + INTERVAL '1' MINUTE * CAST(l_quantity AS INT)
         + INTERVAL '1' MINUTE * CAST(CASE WHEN l_partkey % 97 = 5 THEN -2 ELSE 1 END AS INT)
         AS ingested_at,
       'v' || CAST(l_linenumber AS VARCHAR) AS revision,
       CASE WHEN l_partkey % 301 = 1 THEN 'GUESS' WHEN l_partkey % 17 = 1 THEN NULL
            ELSE 'DEMO_FIXTURE' END AS data_mode,
       CASE WHEN l_partkey % 211 = 9 THEN NULL ELSE l_discount * 100 END AS open,
       l_tax * 100 + 1 AS close,
       least(l_discount * 100, l_tax * 100 + 1) - CAST(l_linenumber - 2 AS DOUBLE) AS low,
       greatest(l_discount * 100, l_tax * 100 + 1) + CAST(l_linenumber - 1 AS DOUBLE) AS high,
       l_quantity - 2 AS volume
FROM lineitem"""


def raw_facts(t) -> DataFrame:
    """Line items read as facts with every kind of contract breach among them."""
    base, part = F.col("l_shipdate").cast("timestamp"), F.col("l_partkey")
    seen = base + F.make_dt_interval(mins=F.lit(418) + F.col("l_quantity").cast("int"))
    o = F.col("l_discount") * 100
    c = F.col("l_tax") * 100 + 1
    line = F.col("l_linenumber")
    return t.lineitem.select(
        F.col("l_suppkey").alias("instrument_id"),
        (base + minutes(420)).alias("event_time"),
        F.when(part % 199 != 0, base + minutes(425)).alias("published_at"),
        F.when(part % 101 == 3, base + minutes(419)).otherwise(base + minutes(426))
        .alias("first_seen_at"),
        seen.alias("available_at"),
        (base + minutes(420)).alias("as_of"),
        F.when(part % 97 == 5, seen - minutes(2)).otherwise(seen + minutes(1)).alias("ingested_at"),
        F.concat(F.lit("v"), line.cast("string")).alias("revision"),
        F.when(part % 301 == 1, "GUESS").when(part % 17 == 1, None).otherwise("DEMO_FIXTURE")
        .alias("data_mode"),
        F.when(part % 211 == 9, None).otherwise(o).alias("open"),
        c.alias("close"),
        (F.least(o, c) - (line - 2).cast("double")).alias("low"),
        (F.greatest(o, c) + (line - 1).cast("double")).alias("high"),
        (F.col("l_quantity") - 2).alias("volume"),
    )


_RULE_SQL = {
    "data_mode_unknown": "data_mode IS NOT NULL AND data_mode NOT IN "
    "('LIVE_LICENSED','DELAYED','HISTORICAL','DEMO_FIXTURE')",
    **{f"{c}_missing": f"{c} IS NULL" for c in (*CLOCKS, "ingested_at")},
    "available_before_event": "available_at < event_time",
    "first_seen_before_event": "first_seen_at < event_time",
    "available_before_published": "available_at < published_at",
    "available_before_first_seen": "available_at < first_seen_at",
    "available_before_as_of": "available_at < as_of",
    "ingested_before_available": "ingested_at < available_at",
    "ohlcv_not_finite": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL "
    "OR volume IS NULL",
    "ohlc_not_positive": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0",
    "volume_negative": "volume < 0",
    "price_range_invalid": "low > least(open, close) OR high < greatest(open, close) OR low > high",
}


@query(
    "fact_contract", "B-01 B-20",
    "WITH raw AS (" + RAW_SQL + ") "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {w}) AS violations FROM raw"
        for n, w in _RULE_SQL.items()
    )
    + " UNION ALL SELECT 'identity_duplicated', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT"
    " count(*) AS n FROM raw GROUP BY instrument_id, event_time, revision HAVING count(*) > 1) d"
    " UNION ALL SELECT 'empty', CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM raw",
)
def _fact_contract(t):
    return validate.validate_facts(raw_facts(t)).select("rule", "violations")


@query(
    "pit_slice", "B-02 A-02",
    """SELECT instrument_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
              round(close, 6) AS close
       FROM facts WHERE greatest(event_time, published_at, first_seen_at, available_at, as_of)
             <= TIMESTAMP '1998-06-01 00:00:00'""",
    "facts",
)
def _pit_slice(t):
    return point_in_time_slice(views.facts(t), CUT).select(
        "instrument_id", stamp("event_time"), r6(F.col("close")).alias("close")
    )


@query(
    "availability_slice", "A-02",
    """SELECT instrument_id, count(*) AS rows_known, round(sum(volume), 6) AS volume FROM facts
       WHERE available_at <= TIMESTAMP '1999-01-01 12:00:00' GROUP BY instrument_id""",
    "facts",
)
def _availability_slice(t):
    at = cutoff(datetime(1999, 1, 1, 12), naive="utc")
    return (
        views.facts(t).filter(F.col("available_at") <= at).groupBy("instrument_id")
        .agg(F.count("*").alias("rows_known"), r6(F.sum("volume")).alias("volume"))
    )


@query(
    "clock_check", "B-03",
    "WITH raw AS (" + RAW_SQL + ") " + " UNION ALL ".join(
        f"SELECT '{c}' AS clock, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) FILTER "
        f"(WHERE {c} > TIMESTAMP '1998-06-01 00:00:00') AS future FROM raw" for c in CLOCKS
    ),
)
def _clock_check(t):
    return clock_violations(raw_facts(t), CUT)


@query(
    "causal_facts", "B-04",
    """SELECT instrument_id, count(*) AS rows_known,
              strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_event FROM facts
       WHERE greatest(published_at, first_seen_at, available_at, as_of)
             <= event_time + INTERVAL '30' MINUTE GROUP BY instrument_id""",
    "facts",
)
def _causal_facts(t):
    return (
        causal_rows(views.facts(t)).groupBy("instrument_id")
        .agg(F.count("*").alias("rows_known"), F.max("event_time").alias("last_event"))
        .withColumn("last_event", stamp("last_event"))
    )


EXECUTION_COLUMNS = [
    "open", "bid_ask_spread_bps", "split_factor", "dividend", "fx_rate", "expense_ratio",
]


@query(
    "execution_mask", "B-05",
    """SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
        CASE WHEN available_at <= event_time + INTERVAL '30' MINUTE THEN round(open, 6) END AS open,
        CASE WHEN available_at <= event_time + INTERVAL '30' MINUTE THEN dividend END AS dividend,
        available_at <= event_time + INTERVAL '30' MINUTE AS execution_known
       FROM facts""",
    "facts",
)
def _execution_mask(t):
    return execution_mask(views.facts(t), EXECUTION_COLUMNS).select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        r6(F.col("open")).alias("open"), "dividend", "execution_known",
    )


@query(
    "lineage_homogeneity", "B-06",
    """SELECT instrument_id, bool_and(provider = 'prov0') AS provider_ok,
              bool_and(license_scope = 'SCOPE_A') AS license_scope_ok,
              bool_and(data_mode = 'DEMO_FIXTURE') AS data_mode_ok
       FROM facts GROUP BY instrument_id""",
    "facts",
)
def _lineage_homogeneity(t):
    expected = {"provider": "prov0", "license_scope": "SCOPE_A", "data_mode": "DEMO_FIXTURE"}
    return validate.lineage_report(
        views.facts(t), ["instrument_id"], {k: F.lit(v) for k, v in expected.items()}
    )


@query(
    "freshness", "D-13",
    """SELECT instrument_id, strftime(max(as_of), '%Y-%m-%d %H:%M:%S') AS last_as_of,
              strftime(max(available_at), '%Y-%m-%d %H:%M:%S') AS last_available,
              strftime(least(max(event_time), max(as_of), max(available_at)), '%Y-%m-%d %H:%M:%S')
                AS oldest_clock
       FROM facts GROUP BY instrument_id""",
    "facts",
)
def _freshness(t):
    last = views.facts(t).groupBy("instrument_id").agg(
        F.max("as_of").alias("last_as_of"), F.max("available_at").alias("last_available"),
        F.max("event_time").alias("last_event"),
    )
    return last.select(
        "instrument_id", stamp("last_as_of"), stamp("last_available"),
        stamp(F.least("last_event", "last_as_of", "last_available"), "oldest_clock"),
    )


@query(
    "staleness", "B-10",
    """SELECT instrument_id, TIMESTAMP '2001-06-01 00:00:00' - max(available_at) > INTERVAL '10' DAY
         OR TIMESTAMP '2001-06-01 00:00:00' - least(max(event_time), max(as_of)) > INTERVAL '10' DAY
         AS stale
       FROM facts WHERE available_at <= TIMESTAMP '2001-06-01 00:00:00' GROUP BY instrument_id""",
    "facts",
)
def _staleness(t):
    known = point_in_time_slice(views.facts(t), AT)
    last = known.groupBy("instrument_id").agg(
        F.max("available_at").alias("last_available"), F.max("event_time").alias("last_event"),
        F.max("as_of").alias("last_as_of"),
    )
    return last.select("instrument_id", gates.stale(cutoff(AT), STALE).alias("stale"))


# ------------------------------------------------------------------ vintages

@query(
    "latest_vintage", "F-10",
    """SELECT series_code, strftime(event_time, '%Y-%m-%d') AS month, revision,
              round(value, 6) AS value
       FROM (SELECT *, row_number() OVER (PARTITION BY series_code, event_time
               ORDER BY available_at DESC, revision DESC) AS rn FROM macro) x WHERE rn = 1""",
    "macro",
)
def _latest_vintage(t):
    latest = latest_version(
        views.macro(t), ["series_code", "event_time"], ["available_at", "revision"]
    )
    return latest.select(
        "series_code", F.date_format("event_time", "yyyy-MM-dd").alias("month"), "revision",
        r6(F.col("value")).alias("value"),
    )


def macro_facts(t):
    m = views.macro(t)
    return m.withColumns(
        {"published_at": F.col("available_at"), "first_seen_at": F.col("available_at"),
         "as_of": F.col("available_at")}
    )


MACRO_SQL = """SELECT avg(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value))) AS macro_score,
       count(*) AS series
FROM (SELECT *, row_number() OVER (PARTITION BY series_code
        ORDER BY available_at DESC, revision DESC) AS rn
      FROM macro WHERE available_at <= TIMESTAMP '2001-06-01 00:00:00') x WHERE rn = 1"""


@query(
    "macro_score", "D-04",
    f"SELECT round(macro_score, 6) AS macro_score, series FROM ({MACRO_SQL}) y", "macro",
)
def _macro_score(t):
    known = point_in_time_slice(macro_facts(t), AT)
    return factors.macro_score(known).withColumn("macro_score", r6(F.col("macro_score")))


# ------------------------------------------------------------------ rolling windows

ORDER_SQL = "PARTITION BY instrument_id ORDER BY event_time"
_FRAME = "(" + ORDER_SQL + " ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def _frame(n: int) -> str:
    return _FRAME.format(n=n - 1)


def numbered(t) -> DataFrame:
    slim = staged_bars(t).select(
        "instrument_id", "event_time", F.col("total_return_close").alias("p"), "close", "volume",
        "bid_ask_spread_bps",
    )
    return ordinals(slim, ["instrument_id"], ["event_time"], month("event_time"))


@query(
    "window_factors", "F-01 F-02 F-03 F-04 F-05 F-06",
    f"""WITH r AS (SELECT *, total_return_close AS p,
           total_return_close / lag(total_return_close) OVER ({ORDER_SQL}) - 1 AS ret,
           row_number() OVER ({ORDER_SQL}) AS rn FROM bars)
    SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
       round(ret, 6) AS ret,
       round(p / lag(p, 21) OVER ({ORDER_SQL}) - 1, 6) AS momentum_21,
       round(coalesce(p / lag(p, 63) OVER ({ORDER_SQL}) - 1, 0), 6) AS momentum_3m,
       CASE WHEN rn >= 50 THEN round(avg(p) OVER {_frame(50)}, 6) END AS sma_50,
       CASE WHEN rn >= 200 THEN round(avg(p) OVER {_frame(200)}, 6) END AS sma_200,
       CASE WHEN rn >= 64 THEN round(stddev_samp(ret) OVER {_frame(63)} * {YEAR!r}, 6) END AS vol_63,
       CASE WHEN rn >= 22 THEN round(stddev_samp(CASE WHEN ret > 0 THEN 0 ELSE ret END)
            OVER {_frame(21)} * {YEAR!r}, 6) END AS downside_21,
       round(stddev_samp(CASE WHEN ret < 0 THEN ret END) OVER {_frame(63)}, 6) AS downside_63,
       round(median(close * volume) OVER {_frame(63)}, 6) AS median_notional,
       round(volume / median(volume) OVER {_frame(21)}, 6) AS volume_ratio
    FROM r""",
    "bars",
)
def _window_factors(t):
    p, ret, rn = F.col("p"), F.col("ret"), F.col("ordinal")

    def rolled(f, x):
        r, known = change = f.change(x["p"], strict=True)
        return {
            "ret": change, "_p21": f.lag(x["p"], 21), "_p63": f.lag(x["p"], 63),
            "_mean50": f.mean(x["p"], 50), "_mean200": f.mean(x["p"], 200), "_sd": f.sd(change, 63),
            "_not_up": f.sd((np.where((r > 0) | np.isnan(r), 0.0, r), known), 21),
            "_down": f.sd((r, known & (r < 0)), 63),
            "_notional": f.median(x["notional"], 63), "_median": f.median(x["volume"], 21),
        }

    wide = array_frames(
        numbered(t).withColumn("notional", F.col("close") * F.col("volume")), ["instrument_id"],
        ["p", "volume", "notional"], rolled,
        ["ret", "_p21", "_p63", "_mean50", "_mean200", "_sd", "_not_up", "_down", "_notional", "_median"],
        back=200,
    )
    out = wide.withColumns(
        {
            "momentum_21": r6(p / F.col("_p21") - 1),
            "momentum_3m": r6(F.coalesce(p / F.col("_p63") - 1, F.lit(0.0))),
            "sma_50": F.when(rn >= 50, r6(F.col("_mean50"))),
            "sma_200": F.when(rn >= 200, r6(F.col("_mean200"))),
            "vol_63": F.when(rn >= 64, r6(F.col("_sd") * YEAR)),
            "downside_21": F.when(rn >= 22, r6(F.col("_not_up") * YEAR)),
            "downside_63": r6(F.col("_down")),
            "median_notional": r6(F.col("_notional")),
            "volume_ratio": r6(F.col("volume") / F.col("_median")),
        }
    )
    return out.select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        r6(ret).alias("ret"), "momentum_21", "momentum_3m", "sma_50", "sma_200", "vol_63",
        "downside_21", "downside_63", "median_notional", "volume_ratio",
    )


@query(
    "drawdown", "F-07",
    f"""SELECT instrument_id, round(min(p / peak - 1), 6) AS max_drawdown,
               round(max(peak), 6) AS highest
        FROM (SELECT instrument_id, total_return_close AS p,
                max(total_return_close) OVER ({ORDER_SQL}) AS peak FROM bars) x
        GROUP BY instrument_id""",
    "bars",
)
def _drawdown(t):
    peaks = running(
        staged_bars(t).select("instrument_id", "event_time", "total_return_close"),
        ["instrument_id"], ["event_time"], month("event_time"),
        {"peak": Running("max", F.col("total_return_close"))},
    )
    return peaks.groupBy("instrument_id").agg(
        r6(F.min(F.col("total_return_close") / F.col("peak") - 1)).alias("max_drawdown"),
        r6(F.max("peak")).alias("highest"),
    )


@query(
    "cumulative_split", "F-08",
    f"""SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
               product(split_factor) OVER ({ORDER_SQL}) AS cumulative
        FROM bars""",
    "bars",
)
def _cumulative_split(t):
    out = running(
        staged_bars(t).select("instrument_id", "event_time", "split_factor"),
        ["instrument_id"], ["event_time"], month("event_time"),
        {"cumulative": Running("product", F.col("split_factor"))},
    )
    return out.select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"), "cumulative"
    )


@query(
    "forward_fill", "F-09",
    f"""SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
          round(last_value(CASE WHEN available_at <= event_time + INTERVAL '30' MINUTE THEN open END
            IGNORE NULLS) OVER ({ORDER_SQL}), 6) AS open_known
        FROM bars""",
    "bars",
)
def _forward_fill(t):
    masked = execution_mask(staged_bars(t), ["open"]).select("instrument_id", "event_time", "open")
    out = running(
        masked, ["instrument_id"], ["event_time"], month("event_time"),
        {"open_known": Running("last", F.col("open"))},
    )
    return out.select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        r6(F.col("open_known")).alias("open_known"),
    )


@query(
    "shift_and_change", "F-11 F-12",
    f"""SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
          round(lead(open) OVER ({ORDER_SQL}), 6) AS next_open,
          round(lead(total_return_close, 5) OVER ({ORDER_SQL}) / total_return_close - 1, 6)
            AS ahead_5,
          round(abs(volume - coalesce(lag(volume) OVER ({ORDER_SQL}), 0)), 6) AS volume_change
        FROM bars""",
    "bars",
)
def _shift_and_change(t):
    slim = staged_bars(t).select("instrument_id", "event_time", "open", "total_return_close", "volume")
    base = ordinals(slim, ["instrument_id"], ["event_time"], month("event_time"))

    def step(w):
        return {
            "next_open": r6(F.lead("open").over(w)),
            "ahead_5": r6(F.lead("total_return_close", 5).over(w) / F.col("total_return_close") - 1),
            "volume_change": r6(
                F.abs(F.col("volume") - F.coalesce(F.lag("volume").over(w), F.lit(0.0)))
            ),
        }

    return frames(base, ["instrument_id"], [step], back=1, ahead=5).select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        "next_open", "ahead_5", "volume_change",
    )


@query(
    "cross_section_rank", "F-13",
    """SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
         round((rank() OVER (PARTITION BY event_time ORDER BY close)
           + (count(*) OVER (PARTITION BY event_time, close) - 1) / 2.0)
           / count(*) OVER (PARTITION BY event_time), 6) AS pct_rank,
         (rank() OVER (PARTITION BY event_time ORDER BY close)
           + (count(*) OVER (PARTITION BY event_time, close) - 1) / 2.0)
           / count(*) OVER (PARTITION BY event_time) >= 0.75 AS selected
       FROM bars""",
    "bars",
)
def _cross_section_rank(t):
    slim = staged_bars(t).select("instrument_id", "event_time", "close")
    return percentile_rank(slim, ["event_time"], "close").select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        r6(F.col("pct_rank")).alias("pct_rank"), (F.col("pct_rank") >= 0.75).alias("selected"),
    )


@query(
    "tail_rows", "F-15",
    """SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day, CAST(rn AS INT) AS place,
              round(close, 6) AS close
       FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY event_time DESC) AS rn
             FROM bars) x WHERE rn <= 10""",
    "bars",
)
def _tail_rows(t):
    slim = views.bars(t).select("instrument_id", "event_time", "close")
    return last_rows(slim, ["instrument_id"], [F.col("event_time").desc()], 10).select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        F.col("_rank").cast("int").alias("place"), r6(F.col("close")).alias("close"),
    )


@query(
    "capped_weights", "F-16",
    """WITH s AS (SELECT event_time, instrument_id, 1 / bid_ask_spread_bps AS w,
         row_number() OVER (PARTITION BY event_time ORDER BY 1 / bid_ask_spread_bps DESC,
           instrument_id) - 1 AS i,
         sum(1 / bid_ask_spread_bps) OVER (PARTITION BY event_time
           ORDER BY 1 / bid_ask_spread_bps DESC, instrument_id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM bars),
       k AS (SELECT event_time, coalesce(min(i) FILTER (WHERE
           w * greatest(0, 0.8::DOUBLE - i * 0.1::DOUBLE) / rest <= 0.1::DOUBLE * (1 + 1e-12)),
           count(*)) AS k FROM s GROUP BY event_time)
       SELECT strftime(s.event_time, '%Y-%m-%d') AS day, s.instrument_id,
         round(CASE WHEN s.i < k.k THEN 0.1::DOUBLE ELSE s.w * greatest(0,
           0.8::DOUBLE - k.k * 0.1::DOUBLE)
           / sum(CASE WHEN s.i >= k.k THEN s.w END) OVER (PARTITION BY s.event_time) END, 6) AS weight
       FROM s JOIN k ON s.event_time = k.event_time""",
    "bars",
)
def _capped_weights(t):
    slim = staged_bars(t).select(
        "event_time", "instrument_id", (F.lit(1.0) / F.col("bid_ask_spread_bps")).alias("w")
    )
    out = capped_weights(slim, ["event_time"], "w", "instrument_id", 0.80, 0.10)
    return out.select(
        F.date_format("event_time", "yyyy-MM-dd").alias("day"), "instrument_id",
        r6(F.col("weight")).alias("weight"),
    )


@query(
    "gated_carry", "F-17",
    f"""SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
          coalesce(last_value(CASE WHEN available_at <= event_time + INTERVAL '30' MINUTE
            THEN bid_ask_spread_bps END IGNORE NULLS) OVER ({ORDER_SQL}), 0) AS held
        FROM bars""",
    "bars",
)
def _gated_carry(t):
    tradable = F.col("available_at") <= F.col("event_time") + minutes(30)
    out = running(
        staged_bars(t).select("instrument_id", "event_time", "available_at", "bid_ask_spread_bps"),
        ["instrument_id"], ["event_time"], month("event_time"),
        {"held": Running("last", F.when(tradable, F.col("bid_ask_spread_bps")))},
    )
    return out.select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        F.coalesce("held", F.lit(0.0)).alias("held"),
    )


# ------------------------------------------------------------------ benchmark and model inputs

BENCH_SQL = """
SELECT event_time, avg(total_return_close) AS benchmark_total_return_close,
       max(available_at) AS benchmark_available_at,
       count(DISTINCT instrument_id) AS benchmark_constituent_count
FROM bars WHERE available_at <= event_time + INTERVAL '30' MINUTE GROUP BY event_time"""


@query(
    "universe_benchmark", "D-01",
    f"""SELECT strftime(event_time, '%Y-%m-%d') AS day,
          round(ln(benchmark_total_return_close), 6) AS benchmark,
          strftime(benchmark_available_at, '%Y-%m-%d %H:%M:%S') AS available_at,
          benchmark_constituent_count AS members FROM ({BENCH_SQL}) b""",
    "bars",
)
def _universe_benchmark(t):
    _, bench = model.universe_benchmark(views.facts(t))
    return bench.select(
        F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        r6(F.log("benchmark_total_return_close")).alias("benchmark"),
        stamp("benchmark_available_at", "available_at"),
        F.col("benchmark_constituent_count").alias("members"),
    )


# ------------------------------------------------------------------ factors and signals

FACTOR_SQL = f"""
WITH known AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY event_time DESC)
                 AS r, count(*) OVER (PARTITION BY instrument_id) AS n
               FROM facts WHERE greatest(event_time, available_at, as_of)
                 <= TIMESTAMP '2001-06-01 00:00:00'),
h AS (SELECT *, total_return_close AS p, close * volume AS notional,
        total_return_close / lag(total_return_close)
          OVER (PARTITION BY instrument_id ORDER BY event_time) - 1 AS ret,
        CASE WHEN r <= 252 THEN total_return_close / max(CASE WHEN r <= 252 THEN total_return_close
          END) OVER (PARTITION BY instrument_id ORDER BY event_time) - 1 END AS fall
      FROM known WHERE r <= 253),
f AS (SELECT instrument_id, max(n) AS bar_count, count(*) AS used,
  max(p) FILTER (WHERE r = 1) / max(p) FILTER (WHERE r = 22) - 1 AS m1,
  max(p) FILTER (WHERE r = 1) / max(p) FILTER (WHERE r = 64) - 1 AS m3,
  max(p) FILTER (WHERE r = 1) / max(p) FILTER (WHERE r = 127) - 1 AS m6,
  max(p) FILTER (WHERE r = 1) / max(p) FILTER (WHERE r = 253) - 1 AS m12,
  max(p) FILTER (WHERE r = 1) AS price,
  avg(p) FILTER (WHERE r <= 50) AS s50, avg(p) FILTER (WHERE r <= 200) AS s200,
  stddev_samp(ret) FILTER (WHERE r <= 126) AS sd126,
  stddev_samp(ret) FILTER (WHERE r <= 63) * {YEAR!r} AS vol,
  CASE WHEN count(*) FILTER (WHERE r <= 63 AND ret < 0) > 1 THEN
    stddev_samp(ret) FILTER (WHERE r <= 63 AND ret < 0) * {YEAR!r} ELSE 0 END AS dvol,
  min(fall) AS dd, median(notional) FILTER (WHERE r <= 63) AS notional,
  max(volume) FILTER (WHERE r = 1) / greatest(median(volume) FILTER (WHERE r <= 63), 1) AS vr,
  max(bid_ask_spread_bps) FILTER (WHERE r = 1) AS spread,
  max(expense_ratio) FILTER (WHERE r = 1) AS expense
 FROM h GROUP BY instrument_id),
u AS (SELECT median(coalesce(m6, 0)) AS u FROM f),
g AS (SELECT f.*, CASE WHEN s200 > 0 THEN price / s200 - 1 ELSE 0 END AS trend,
        (s50 / s200 - 1) / greatest(sd126, 1e-6) AS strength, m6 - u.u AS rel FROM f, u)"""


@query(
    "factor_vector", "H-01 D-03",
    FACTOR_SQL + """
SELECT instrument_id, used >= 253 AS enough_history, round(coalesce(m1, 0), 6) AS momentum_1m,
  round(coalesce(m3, 0), 6) AS momentum_3m, round(coalesce(m6, 0), 6) AS momentum_6m,
  round(coalesce(m12, 0), 6) AS momentum_12m, round(s50, 6) AS sma_50, round(s200, 6) AS sma_200,
  round(trend, 6) AS trend, round(strength, 6) AS trend_strength,
  round(vol, 6) AS annualized_volatility, round(dvol, 6) AS downside_volatility,
  round(dd, 6) AS max_drawdown, round(coalesce(m6, 0) - u.u, 6) AS relative_strength,
  round(notional, 6) AS median_notional_63d, round(vr, 6) AS volume_ratio,
  spread AS bid_ask_spread_bps, expense AS expense_ratio FROM g, u""",
    "facts",
)
def _factor_vector(t):
    vector = cut_lineage(factors.factor_vector(point_in_time_slice(views.facts(t), AT)))
    universe = factors.universe_median_return(vector).select("universe_return").scalar()
    vector = vector.withColumn("relative_strength", F.col("momentum_6m") - universe)
    names = [n for n in factors.FACTOR_NAMES
             if n not in ("nav_premium_bps", "tracking_error", "quality_score")]
    return vector.select("instrument_id", "enough_history", *[r6(F.col(n)).alias(n) for n in names])


def snapshot_of() -> dict:
    return {
        "provider": F.col("provider"), "license_scope": F.lit("SCOPE_A"),
        "data_mode": F.lit("DEMO_FIXTURE"),
    }


LIMITS = Limits(data_stale_after_minutes=STALE)


def known_bars(t) -> DataFrame:
    return point_in_time_slice(views.facts(t), AT)


def risk(t, known: DataFrame) -> DataFrame:
    return gates.signal_risk(
        views.instruments(t), gates.bar_summary(known), views.registry(t), AT, LIMITS,
        snapshot_of(),
    )


RISK_SQL = """
known AS (SELECT * FROM facts WHERE greatest(event_time, available_at, as_of)
            <= TIMESTAMP '2001-06-01 00:00:00'),
b AS (SELECT instrument_id, count(*) AS bar_count, min(data_mode) AS dmin, max(data_mode) AS dmax,
        min(provider) AS pmin, max(provider) AS pmax,
        max(available_at) AS la, max(event_time) AS le, max(as_of) AS lo,
        arg_max(bid_ask_spread_bps, event_time) AS sp, arg_max(close, event_time) AS cl
      FROM known GROUP BY instrument_id),
q AS (SELECT i.*, b.bar_count, TIMESTAMP '2001-06-01 00:00:00' - la > INTERVAL '10' DAY
        OR TIMESTAMP '2001-06-01 00:00:00' - least(le, lo) > INTERVAL '10' DAY AS stale,
        list_filter([CASE WHEN leveraged THEN 'LEVERAGED_ETF_FORBIDDEN' END,
          CASE WHEN inverse THEN 'INVERSE_ETF_FORBIDDEN' END,
          CASE WHEN NOT active THEN 'INSTRUMENT_INACTIVE' END,
          CASE WHEN liquidity_tier > 2 THEN 'LOW_LIQUIDITY_FORBIDDEN' END,
          CASE WHEN rg.review_status <> 'APPROVED' OR NOT rg.non_display_algorithm_right
               OR NOT list_contains(rg.regions, i.region) THEN 'PROVIDER_LICENSE_BLOCKED' END,
          CASE WHEN pmin <> i.provider OR pmax <> i.provider THEN 'DATA_PROVIDER_MISMATCH' END,
          CASE WHEN dmin <> 'DEMO_FIXTURE' OR dmax <> 'DEMO_FIXTURE' THEN 'DATA_MODE_MISMATCH' END,
          CASE WHEN TIMESTAMP '2001-06-01 00:00:00' - la > INTERVAL '10' DAY
            OR TIMESTAMP '2001-06-01 00:00:00' - least(le, lo) > INTERVAL '10' DAY
            THEN 'DATA_STALE' END,
          CASE WHEN cl <= 0 THEN 'INVALID_PRICE' END,
          CASE WHEN sp > 25 THEN 'SPREAD_TOO_WIDE_OR_UNKNOWN' END,
          CASE WHEN bar_count < 10 THEN 'INSUFFICIENT_RECENT_BARS' END], lambda x: x IS NOT NULL) AS rules
      FROM instruments i JOIN b ON i.instrument_id = b.instrument_id
      JOIN registry rg ON rg.provider_code = i.provider)"""


@query(
    "risk_rules", "B-09 B-07 B-16 C-02",
    "WITH " + RISK_SQL + """
    SELECT instrument_id, array_to_string(rules, ',') AS rules, stale FROM q""",
    "facts instruments registry",
)
def _risk_rules(t):
    return risk(t, known_bars(t)).select("instrument_id", F.array_join("rules", ",").alias("rules"), "stale")


def exposed_news(t) -> DataFrame:
    """News moved back to the time of the bars, exposed first to a region, then to a class."""
    n = views.news(t)
    back = F.expr("make_dt_interval(8275)")
    return n.join(
        t.region.select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region")),
        "region_key",
    ).select(
        "event_id",
        (F.col("event_time") - back).alias("event_time"),
        (F.col("available_at") - back).alias("available_at"),
        "relevance", "direction", "severity",
        (F.lit(0.5) + (F.col("k") % 4).cast("double") / 10.0).alias("novelty"),
        F.lit(0.8).alias("source_grade"),
        F.when(F.col("flagged"), F.array(F.lit("PROMPT_INJECTION_SUSPECTED")))
        .otherwise(F.array(F.lit("NOTE"))).alias("quality_flags"),
        F.lit("DEMO_FIXTURE").alias("data_mode"),
        F.concat(F.lit("https://feed.example.org/"), F.col("event_id").cast("string"))
        .alias("source_uri"),
        F.array(
            F.struct(F.lit("REGION").alias("type"), F.col("region").alias("value"),
                     F.col("confidence").alias("confidence")),
            F.struct(F.lit("ASSET_CLASS").alias("type"),
                     F.concat(F.lit("AC"), ((F.col("k") + 1) % 5).cast("string")).alias("value"),
                     F.lit(0.9).alias("confidence")),
        ).alias("exposures"),
    )


NEWS_SQL = """
n AS (SELECT w.*, w.event_time - INTERVAL '8275' DAY AS et, w.available_at - INTERVAL '8275' DAY AS av,
        r.r_name AS region, 'AC' || CAST((k + 1) % 5 AS VARCHAR) AS ac,
        CAST(0.5 AS DOUBLE) + CAST(k % 4 AS DOUBLE) / CAST(10 AS DOUBLE) AS novelty
      FROM news w JOIN region r ON r.r_regionkey = w.region_key),
nv AS (SELECT i.instrument_id, n.event_id, n.direction * n.relevance * n.severity * n.novelty
         * CAST(0.8 AS DOUBLE)
         * (CASE WHEN n.region = i.region THEN n.confidence ELSE CAST(0.9 AS DOUBLE) END)
         * exp(-ln(2::DOUBLE) * greatest(0::DOUBLE,
             date_diff('microsecond', n.av, TIMESTAMP '2001-06-01 00:00:00') / 3600000000.0::DOUBLE)
             / 72) AS v
       FROM n JOIN instruments i ON n.region = i.region OR n.ac = i.asset_class
       WHERE NOT n.flagged AND n.av <= TIMESTAMP '2001-06-01 00:00:00'
         AND (CASE WHEN n.region = i.region THEN n.confidence ELSE 0.9 END) >= 0.60),
ns AS (SELECT instrument_id, greatest(-1::DOUBLE, least(1::DOUBLE, sum(v))) AS news_score
       FROM nv GROUP BY instrument_id)"""


@query(
    "news_score", "H-03 C-10",
    "WITH " + NEWS_SQL + """
    SELECT i.instrument_id, round(coalesce(news_score, 0), 6) AS news_score
    FROM instruments i LEFT JOIN ns ON ns.instrument_id = i.instrument_id""",
    "news instruments",
)
def _news_score(t):
    out = news.news_scores(exposed_news(t), views.instruments(t), AT)
    return out.select("instrument_id", r6(F.col("news_score")).alias("news_score"))


@query(
    "news_evidence", "G-01 D-14",
    "WITH " + NEWS_SQL + """
    SELECT instrument_id, event_id, CAST(rk AS INT) AS place, round(v, 6) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id
             ORDER BY round(abs(v), 9) DESC, event_id) AS rk FROM nv) z WHERE rk <= 5""",
    "news instruments",
)
def _news_evidence(t):
    return news.news_evidence(exposed_news(t), views.instruments(t), AT, 5).select(
        "instrument_id", "event_id", F.col("place").cast("int").alias("place"),
        r6(F.col("value")).alias("value"),
    )


def scored(t, known: DataFrame) -> DataFrame:
    # One row per instrument, used for the universe median and again for the scores.
    vector = cut_lineage(factors.factor_vector(known))
    universe = factors.universe_median_return(vector).select("universe_return").scalar()
    macro = factors.macro_score(point_in_time_slice(macro_facts(t), AT)).select("macro_score").scalar()
    news_part = news.news_scores(exposed_news(t), views.instruments(t), AT).select(
        "instrument_id", F.col("news_score").alias("_news")
    )
    joined = vector.join(news_part, "instrument_id", "left")
    return factors.scores(joined, universe, F.col("_news"), macro, LIMITS.news_weight_cap)


def signals(t) -> DataFrame:
    """Signal record per instrument: scores, risk codes, state, probability and budget."""
    known = cut_lineage(known_bars(t))
    rules = risk(t, known).select(
        "instrument_id", "rules", "stale", "bar_count", "last_available", "last_as_of",
        "asset_class", "industry", "region", "mic", "liquidity_tier", "active", "leveraged",
        "inverse", "provider",
    )
    record = factors.signal_record(rules.join(scored(t, known), "instrument_id"), LIMITS)
    return record


SCORE_SQL = """
m AS (SELECT greatest(-1::DOUBLE, least(1::DOUBLE, macro_score)) AS ms FROM (""" + MACRO_SQL + """) y),
s1 AS (SELECT g.*, coalesce(ns.news_score, 0) AS news, m.ms,
  greatest(-0.35::DOUBLE, least(0.35::DOUBLE, 0.15 * coalesce(m1, 0) + 0.25 * coalesce(m3, 0)
    + 0.30 * coalesce(m6, 0) + 0.30 * coalesce(m12, 0))) / 0.35::DOUBLE AS mom,
  greatest(-1::DOUBLE, least(1::DOUBLE, 0.7 * tanh(trend * 10) + 0.3 * tanh(strength / 4))) AS tr,
  greatest(-1::DOUBLE, least(1::DOUBLE, rel / 0.20)) AS rl,
  greatest(-1::DOUBLE, least(1::DOUBLE, -(vol / 0.35) + dd / 0.25)) AS rk,
  greatest(0::DOUBLE, least(1::DOUBLE, 0.45 * tanh(log10(greatest(notional, 1)) - 6)
    + 0.25 * tanh(vr - 1) + 0.30 * (1 - least(spread / 25, 1)))) AS liq,
  greatest(0::DOUBLE, least(1::DOUBLE, 1 - least(expense / 0.02, 1) * 0.35
    - least(25::DOUBLE / 50, 1) * 0.30 - least(0.03::DOUBLE / 0.05, 1) * 0.35)) AS qual
  FROM g LEFT JOIN ns ON ns.instrument_id = g.instrument_id, m),
s2 AS (SELECT *, greatest(-1::DOUBLE, least(1::DOUBLE, 0.45 * mom + 0.25 * tr + 0.20 * rl
        + 0.10 * rk)) AS market FROM s1),
s3 AS (SELECT *, CASE WHEN used >= 253 THEN greatest(-1::DOUBLE, least(1::DOUBLE, 0.85::DOUBLE * (
         (0.56 * market + 0.20 * (liq * 2 - 1) + 0.10 * (qual * 2 - 1) + 0.14 * ms)
         / 1.0::DOUBLE) + 0.15::DOUBLE * news)) ELSE 0 END AS composite FROM s2),
s4 AS (SELECT s3.*, q.stale, CASE WHEN used >= 253 THEN q.rules
         ELSE list_append(q.rules, 'INSUFFICIENT_HISTORY') END AS rules
       FROM s3 JOIN q ON q.instrument_id = s3.instrument_id),
s5 AS (SELECT *, greatest(0.05::DOUBLE, least(0.90::DOUBLE, 0.45 + bar_count / 2000.0::DOUBLE
          - len(rules) * 0.12::DOUBLE)) AS conf, 1 / (1 + exp(-2.6::DOUBLE * composite)) AS prob,
        CASE WHEN len(rules) > 0 THEN 0 ELSE least(0.1::DOUBLE, 0.12::DOUBLE / greatest(
          CASE WHEN used >= 253 THEN vol ELSE 1 END, 0.05::DOUBLE) / 20) END AS budget FROM s4)"""

SIGNAL_SQL = FACTOR_SQL + ",\n" + RISK_SQL.replace("known AS", "known_b AS").replace(
    "FROM known GROUP", "FROM known_b GROUP") + ",\n" + NEWS_SQL + ",\n" + SCORE_SQL


@query(
    "composite_scores", "H-02 H-04 E-07 E-08",
    SIGNAL_SQL + """
    SELECT instrument_id, round(mom, 6) AS momentum_score, round(tr, 6) AS trend_score,
      round(rl, 6) AS relative_score, round(rk, 6) AS risk_score, round(market, 6) AS market_score,
      round(liq, 6) AS liquidity_score, round(qual, 6) AS quality_score,
      round(news, 6) AS news_score, round(ms, 6) AS macro_score FROM s5""",
    "facts instruments registry news macro",
)
def _composite_scores(t):
    names = ("momentum_score", "trend_score", "relative_score", "risk_score", "market_score",
             "liquidity_score", "quality_score", "news_score", "macro_score")
    return scored(t, known_bars(t)).select("instrument_id", *[r6(F.col(n)).alias(n) for n in names])


@query(
    "signal_states", "H-05 E-09 E-10",
    SIGNAL_SQL + """
    SELECT instrument_id, CASE WHEN stale THEN 'DATA_STALE' WHEN len(rules) > 0 THEN
        'BLOCKED_BY_RISK' WHEN composite >= 0.38 THEN 'ENTRY_CANDIDATE' WHEN composite >= 0.14
        THEN 'WATCH' WHEN composite > -0.18 THEN 'NO_ACTION' WHEN composite > -0.38 THEN
        'REDUCE_CANDIDATE' ELSE 'EXIT_CANDIDATE' END AS state,
      round(composite, 6) AS composite_score, round(prob, 6) AS probability,
      round(conf, 6) AS confidence, round(greatest(0, prob - (0.18 + (1 - conf) * 0.12)), 6) AS low,
      round(least(1, prob + (0.18 + (1 - conf) * 0.12)), 6) AS high,
      round(budget, 6) AS risk_budget_max, round(budget * 0.5, 6) AS risk_budget_min,
      array_to_string(rules, ',') AS rules FROM s5""",
    "facts instruments registry news macro",
)
def signal_states(t):
    return signals(t).select(
        "instrument_id", "state",
        *[r6(F.col(c)).alias(c) for c in ("composite_score", "probability", "confidence")],
        r6(F.col("probability_low")).alias("low"), r6(F.col("probability_high")).alias("high"),
        r6(F.col("risk_budget_max")).alias("risk_budget_max"),
        r6(F.col("risk_budget_min")).alias("risk_budget_min"),
        F.array_join("rules", ",").alias("rules"),
    )


@query(
    "evidence_split", "E-12 G-07",
    SIGNAL_SQL + """,
    e AS (SELECT instrument_id, coalesce(m6, 0) AS m6, trend, liq, ms, vol, dd FROM s5)
    SELECT instrument_id,
      CAST((m6 >= 0)::INT + (trend >= 0)::INT + (liq >= 0)::INT + (ms >= 0)::INT AS INT)
        AS supporting,
      CAST((m6 < 0)::INT + (trend < 0)::INT + (liq < 0)::INT + (ms < 0)::INT + (vol > 0.30)::INT
        + (dd < -0.20)::INT AS INT) AS opposing FROM e""",
    "facts instruments registry news macro",
)
def _evidence_split(t):
    return factors.evidence(scored(t, known_bars(t))).select(
        "instrument_id", F.size("supporting").alias("supporting"),
        F.size("opposing").alias("opposing"),
    )
