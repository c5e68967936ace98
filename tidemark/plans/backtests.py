"""Backtest and model-evaluation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.clocks import CLOCKS
from tidemark.functions.scalars import r6
from tidemark.operators import backtest
from tidemark.plans.market import EXECUTION_COLUMNS, staged_bars
from tidemark.plans.registry import query

YEAR = math.sqrt(252)

TARGET_SQL = f"""
WITH times AS (SELECT event_time AS t, row_number() OVER (ORDER BY event_time) - 1 AS idx
               FROM (SELECT DISTINCT event_time FROM bars) d),
seen AS (SELECT b.instrument_id AS i, b.event_time AS e, b.total_return_close AS p,
           (SELECT min(idx) FROM times WHERE t >= greatest(b.event_time,
              b.available_at - INTERVAL '30' MINUTE)) AS enter FROM bars b),
ev AS (SELECT DISTINCT i, enter FROM seen WHERE enter IS NOT NULL),
hist AS (SELECT ev.i, ev.enter, list(s.p ORDER BY s.e DESC) AS l, count(*) AS n
         FROM ev JOIN seen s ON s.i = ev.i AND s.enter <= ev.enter GROUP BY ev.i, ev.enter),
feat AS (SELECT i, enter, n, l[1] / l[22] - 1 AS m21, l[1] / l[64] - 1 AS m63,
           l[1] / l[127] - 1 AS m126, l[1] / list_avg(l[1:50]) - 1 AS tr,
           list_aggregate(list_transform(range(1, 64), lambda k: l[k] / l[k + 1] - 1),
             'stddev_samp') * {YEAR!r} AS vol,
           coalesce(lead(enter) OVER (PARTITION BY i ORDER BY enter) - 1,
             (SELECT max(idx) FROM times)) AS until FROM hist),
grid AS (SELECT i, x.idx, m21, m63, m126, tr, vol FROM feat
         JOIN times x ON x.idx BETWEEN enter AND until WHERE n >= 127),
scored AS (SELECT 'model' AS mode, idx, i, 0.20 * m21 + 0.30 * m63 + 0.35 * m126 + 0.15 * tr
             - 0.03 * vol AS score, 1 / greatest(vol, 0.02) AS raw FROM grid
           UNION ALL SELECT 'momentum', idx, i, m63, 1.0 FROM grid),
sel AS (SELECT * FROM (SELECT *, (rank() OVER (PARTITION BY mode, idx ORDER BY score)
            + (count(*) OVER (PARTITION BY mode, idx, score) - 1) / 2.0)
            / count(*) OVER (PARTITION BY mode, idx) AS pr FROM scored) z
        WHERE pr >= 0.75 AND score > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY mode, idx ORDER BY raw DESC, i) - 1 AS k,
        sum(raw) OVER (PARTITION BY mode, idx ORDER BY raw DESC, i
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
        count(*) OVER (PARTITION BY mode, idx) AS members FROM sel),
cut AS (SELECT idx, coalesce(min(k) FILTER (WHERE raw * greatest(0, 0.8::DOUBLE - k * 0.1::DOUBLE)
          / rest <= 0.1::DOUBLE * (1 + 1e-12)), count(*)) AS c FROM o WHERE mode = 'model'
        GROUP BY idx),
targets AS (SELECT mode, o.idx, i, CASE WHEN mode = 'momentum' THEN 1.0::DOUBLE / members
         WHEN k < c THEN 0.1::DOUBLE ELSE raw * greatest(0, 0.8::DOUBLE - c * 0.1::DOUBLE)
           / sum(CASE WHEN k >= c THEN raw END) OVER (PARTITION BY mode, o.idx) END AS w
       FROM o LEFT JOIN cut ON cut.idx = o.idx)"""


def _bars(t):
    """The bars with the columns a backtest reads, written once."""
    return staged_bars(t, "instrument_id", *CLOCKS, "total_return_close", *EXECUTION_COLUMNS)


def _run(t) -> backtest.Backtest:
    return backtest.Backtest(_bars(t))


@query(
    "pit_targets", "C-07 J-01 K-12",
    TARGET_SQL + """
    SELECT mode, strftime(t, '%Y-%m-%d') AS day, i AS instrument_id, round(w, 6) AS weight
    FROM targets JOIN times ON times.idx = targets.idx""",
    "bars",
)
def _pit_targets(t):
    shared = backtest.prepare(_bars(t))
    days = shared["times"].select("idx", F.date_format("event_time", "yyyy-MM-dd").alias("day"))
    return shared["weights"].join(days, "idx").select(
        "mode", "day", "instrument_id", r6(F.col("weight")).alias("weight"),
    )


# The dense statement: every strategy on every cell of the calendar x instrument panel.
DAILY_SQL = TARGET_SQL + """,
ins AS (SELECT i, min(enter) AS first_idx FROM seen WHERE enter IS NOT NULL GROUP BY i),
cells AS (SELECT times.idx, ins.i, first_idx FROM times CROSS JOIN ins),
nk AS (SELECT idx, count(*) FILTER (WHERE first_idx <= idx) AS n FROM cells GROUP BY idx),
ex AS (SELECT instrument_id AS i, idx, open, fx_rate AS fx, bid_ask_spread_bps AS sp,
         split_factor AS sf, dividend AS dv, expense_ratio AS er
       FROM bars JOIN times ON t = event_time
       WHERE available_at <= event_time + INTERVAL '30' MINUTE),
panel AS (SELECT c.idx, c.i, c.first_idx, ex.open IS NOT NULL AS tradable, ex.sp, ex.sf, ex.dv,
    ex.er, last_value(ex.open IGNORE NULLS) OVER w AS opn, last_value(ex.fx IGNORE NULLS) OVER w
      AS fx, tm.w AS wm, tmo.w AS wmo, CASE WHEN c.first_idx <= c.idx THEN 1.0::DOUBLE / nk.n END
      AS we
  FROM cells c LEFT JOIN ex ON ex.i = c.i AND ex.idx = c.idx
  LEFT JOIN targets tm ON tm.mode = 'model' AND tm.i = c.i AND tm.idx = c.idx
  LEFT JOIN targets tmo ON tmo.mode = 'momentum' AND tmo.i = c.i AND tmo.idx = c.idx
  JOIN nk ON nk.idx = c.idx
  WINDOW w AS (PARTITION BY c.i ORDER BY c.idx)),
rets AS (SELECT *, coalesce((lead(opn) OVER w * coalesce(lead(sf) OVER w, 1)
      + coalesce(lead(dv) OVER w, 0)) * lead(fx) OVER w / (opn * fx) - 1, 0) AS r,
    coalesce(lag(wm) OVER w, 0) AS d_model, coalesce(lag(wmo) OVER w, 0) AS d_momentum,
    coalesce(lag(we) OVER w, 0) AS d_equal FROM panel WINDOW w AS (PARTITION BY i ORDER BY idx)),
long AS (SELECT idx, i, first_idx, tradable, sp, er, r, 'model' AS mode, d_model AS d FROM rets
  UNION ALL SELECT idx, i, first_idx, tradable, sp, er, r, 'momentum', d_momentum FROM rets
  UNION ALL SELECT idx, i, first_idx, tradable, sp, er, r, 'equal', d_equal FROM rets),
pos AS (SELECT *, coalesce(last_value(CASE WHEN tradable THEN d END IGNORE NULLS)
          OVER (PARTITION BY mode, i ORDER BY idx), 0) AS p FROM long),
chg AS (SELECT *, abs(p - coalesce(lag(p) OVER (PARTITION BY mode, i ORDER BY idx), 0)) AS ch
        FROM pos),
agg AS (SELECT mode, idx, sum(p * r) AS gross, sum(ch) AS turnover,
          sum(ch * coalesce(sp, 100)) / 20000 + sum(ch) * 5.5::DOUBLE / 10000
            + sum(p * coalesce(er, 0)) / 252 AS cost, sum(p) AS invested, max(p) AS largest,
          count(*) FILTER (WHERE abs(d - p) > 1e-12 AND NOT tradable) AS unfilled
        FROM chg GROUP BY mode, idx),
st AS (SELECT min(idx) AS a, (SELECT max(idx) FROM times) AS b FROM agg
       WHERE mode = 'model' AND invested > 0),
daily AS (SELECT agg.*, gross - cost AS net FROM agg, st WHERE idx >= a AND idx < b),
bh1 AS (SELECT rets.idx, rets.i, product(1 + r - coalesce(er, 0) / 252) OVER (PARTITION BY rets.i
          ORDER BY rets.idx) AS wl, sp FROM rets, st
        WHERE rets.idx >= a AND rets.idx < b AND first_idx <= a - 1),
bh2 AS (SELECT idx, avg(wl) AS wealth, avg(coalesce(sp, 100)) AS sp FROM bh1 GROUP BY idx),
bh AS (SELECT idx, CASE WHEN idx = (SELECT a FROM st) THEN -(5.5::DOUBLE + sp / 2) / 10000
         ELSE wealth / lag(wealth) OVER (ORDER BY idx) - 1 END AS net FROM bh2),
series AS (SELECT CASE mode WHEN 'model' THEN 'model_net' WHEN 'momentum' THEN 'simple_momentum'
             ELSE 'equal_weight' END AS strategy, idx, net FROM daily
           UNION ALL SELECT 'buy_and_hold', idx, net FROM bh)"""


def _metric_sql(source: str, key: str) -> str:
    return f""",
wl AS (SELECT {key}, idx, net, product(1 + net) OVER (PARTITION BY {key} ORDER BY idx) AS wealth
       FROM {source}),
pk AS (SELECT *, max(wealth) OVER (PARTITION BY {key} ORDER BY idx) AS peak FROM wl),
ag AS (SELECT {key}, count(*) AS n, arg_max(wealth, idx) AS fin, avg(net) AS mu,
         coalesce(stddev_samp(net), 0) AS sd,
         coalesce(stddev_samp(net) FILTER (WHERE net < 0), 0) AS lsd,
         min(wealth / peak - 1) AS dd FROM pk GROUP BY {key})
SELECT {key}, round(pow(fin, 252.0 / n) - 1, 6) AS cagr,
  round(sd * {YEAR!r}, 6) AS annualized_volatility,
  round(CASE WHEN sd > 0 THEN mu * 252 / (sd * {YEAR!r}) ELSE 0 END, 6) AS sharpe,
  round(CASE WHEN lsd > 0 THEN mu * 252 / (lsd * {YEAR!r}) ELSE 0 END, 6) AS sortino,
  round(dd, 6) AS max_drawdown,
  round(CASE WHEN dd < 0 THEN (pow(fin, 252.0 / n) - 1) / -dd ELSE 0 END, 6) AS calmar, n FROM ag"""


def _rounded(df, *plain):
    return df.select(
        *plain, *[r6(F.col(c)).alias(c) for c in df.columns if c not in (*plain, "n")], "n"
    )


@query(
    "strategy_daily", "J-02 J-03 J-05 J-06",
    DAILY_SQL + """
    SELECT mode, idx, round(ln(1 + gross), 6) AS log_gross, round(ln(1 + turnover), 6) AS log_turnover,
      round(ln(1 + cost), 6) AS log_cost, round(ln(1 + net), 6) AS log_net,
      round(ln(1 + invested), 6) AS log_invested FROM daily""",
    "bars",
)
def _strategy_daily(t):
    series = _run(t).series
    return series.select(
        "mode", "idx",
        # Logarithms: sums of round weights and spreads would sit exactly on rounding ties.
        *[r6(F.log(1 + F.col(c))).alias(f"log_{c}")
          for c in ("gross", "turnover", "cost", "net", "invested")],
    )


@query(
    "buy_and_hold", "J-04", DAILY_SQL + "\nSELECT idx, round(net, 6) AS net FROM bh", "bars",
)
def _buy_and_hold(t):
    return _run(t).buy_hold().select("idx", r6(F.col("net")).alias("net"))


@query(
    "performance_metrics", "D-05 J-08", DAILY_SQL + _metric_sql("series", "strategy"), "bars",
)
def _performance_metrics(t):
    return _rounded(_run(t).metrics(), "strategy")


PERIOD_SQL = DAILY_SQL + """,
mn AS (SELECT idx, net, row_number() OVER (ORDER BY idx) AS k, count(*) OVER () AS n,
         row_number() OVER (ORDER BY net, idx) AS low FROM series WHERE strategy = 'model_net'),
per AS (SELECT CASE WHEN k <= floor(n * 0.55::DOUBLE) THEN 'train'
          WHEN k <= floor(n * 0.75::DOUBLE) THEN 'validation' ELSE 'untouched_test' END AS period,
          idx, net FROM mn
        UNION ALL SELECT 'stress', idx, net FROM mn WHERE low <= greatest(10, n // 10))"""


@query("period_metrics", "D-06 G-04", PERIOD_SQL + _metric_sql("per", "period"), "bars")
def _period_metrics(t):
    run = _run(t)
    return _rounded(backtest.performance(backtest.periods(run.model_net()), ["period"]), "period")


@query(
    "backtest_summary", "D-07 J-07",
    DAILY_SQL + """
    SELECT round(sum(turnover) FILTER (WHERE mode = 'model'), 6) AS turnover,
      round(sum(cost) FILTER (WHERE mode = 'model'), 6) AS cost_total,
      round(sum(net) FILTER (WHERE mode = 'model') - sum(net) FILTER (WHERE mode = 'equal'), 6)
        AS relative_to_equal_weight,
      round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE mode = 'model'), 6)
        AS hit_rate,
      round(avg(invested) FILTER (WHERE mode = 'model'), 6) AS average_invested_weight,
      round(max(largest) FILTER (WHERE mode = 'model'), 6) AS max_single_weight,
      count(*) FILTER (WHERE mode = 'model') AS steps,
      CAST(sum(unfilled) FILTER (WHERE mode = 'model') AS BIGINT) AS unfilled_bar_count,
      (SELECT count(*) FROM ex WHERE sf <> 1 OR dv <> 0) AS corporate_action_count,
      TRUE AS leak_free FROM daily""",
    "bars",
)
def _backtest_summary(t):
    run = _run(t)
    out = backtest.summary(run.series)
    checks = backtest.leakage(run.traded, run.shared, run.series, run.limits.decision_delay_minutes)
    passed = checks.select(
        F.forall(F.array(*checks.columns), lambda x: x).alias("ok")
    ).scalar()
    acted = run.traded.agg(
        F.count_if((F.col("split_factor") != 1) | (F.col("dividend") != 0)).alias("x")
    ).scalar()
    unfilled = backtest.unfilled_steps(run.traded, run.shared, run.series).scalar()
    return out.select(
        *[r6(F.col(c)).alias(c) for c in out.columns if c != "steps"], "steps",
        unfilled.alias("unfilled_bar_count"), acted.alias("corporate_action_count"),
        passed.alias("leak_free"),
    )


@query(
    "bootstrap_interval", "D-08",
    DAILY_SQL + """,
mn AS (SELECT net, row_number() OVER (ORDER BY idx) - 1 AS k, count(*) OVER () AS n
       FROM series WHERE strategy = 'model_net'),
sz AS (SELECT count(*) AS n FROM mn),
g AS (SELECT n, rep, ps, ('0x' || substr(md5('20250131:' || rep || ':' || (ps // 20)), 1, 8))
          ::UBIGINT::BIGINT % (n - 19) + ps % 20 AS k
      FROM sz, range(0, 200) a(rep), (SELECT k AS ps FROM mn) b),
gr AS (SELECT rep, pow(product(1 + net), 252.0 / any_value(g.n)) - 1 AS growth
       FROM g JOIN mn ON mn.k = g.k GROUP BY rep)
SELECT round(quantile_cont(growth, 0.025), 6) AS low, round(quantile_cont(growth, 0.975), 6) AS high
FROM gr""",
    "bars",
)
def _bootstrap_interval(t):
    out = backtest.bootstrap_growth(_run(t).model_net())
    return out.select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(
    "backtest_status", "J-09",
    DAILY_SQL + f""",
sh AS (SELECT strategy, avg(net) * 252 / (stddev_samp(net) * {YEAR!r}) AS sharpe FROM series
       GROUP BY strategy)
SELECT CASE WHEN max(sharpe) FILTER (WHERE strategy = 'model_net')
         <= max(sharpe) FILTER (WHERE strategy <> 'model_net') THEN 'EXPERIMENTAL'
         ELSE 'REVIEW_REQUIRED' END AS status,
       round(max(sharpe) FILTER (WHERE strategy <> 'model_net'), 6) AS best_baseline FROM sh""",
    "bars",
)
def _backtest_status(t):
    m = _run(t).metrics()
    model = F.col("strategy") == "model_net"
    return m.agg(
        F.max(F.when(model, F.col("sharpe"))).alias("a"),
        F.max(F.when(~model, F.col("sharpe"))).alias("b"),
    ).select(backtest.status(F.col("a"), F.col("b")).alias("status"), r6(F.col("b")).alias("best_baseline"))
