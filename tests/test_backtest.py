"""Point-in-time targets against a slice per decision time, and their invariance to late facts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest
from tidemark.operators.alerts import deliver
from tidemark.operators.model import supervised_dataset, universe_benchmark
from tidemark.settings import Limits

DELAY = pd.Timedelta(minutes=30)


def make_bars(seed: int, late_share: float = 0.08) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    days = pd.date_range("2020-01-01", periods=190, freq="D")
    rows = []
    for i in range(6):
        price = 100.0
        for d in days:
            if rng.random() < 0.08:
                continue
            price *= 1 + rng.normal(0.0005, 0.01)
            late = rng.random() < late_share
            rows.append((i, d, price, d + (pd.Timedelta(hours=float(rng.integers(10, 200))) if late
                                           else pd.Timedelta(minutes=10))))
    pdf = pd.DataFrame(rows, columns=["instrument_id", "event_time", "total_return_close",
                                      "available_at"])
    pdf["published_at"] = pdf["first_seen_at"] = pdf["available_at"]
    pdf["as_of"] = pdf["event_time"]
    pdf["revision"] = "v1"
    return pdf


def reference_features(pdf: pd.DataFrame) -> dict:
    """(time, instrument) -> momentum 63 and volatility, by slicing at every time."""
    out = {}
    for t in sorted(pdf["event_time"].unique()):
        known = pdf[(pdf["event_time"] <= t) & (pdf["available_at"] <= t + DELAY)]
        for i, g in known.groupby("instrument_id"):
            p = g.sort_values("event_time")["total_return_close"]
            if len(p) >= 127:
                vol = p.pct_change().tail(63).std() * np.sqrt(252)
                out[(t, i)] = (p.iloc[-1] / p.iloc[-64] - 1, vol, p.iloc[-1] / p.tail(50).mean() - 1)
    return out


def grid_of(spark, pdf):
    df = spark.createDataFrame(pdf)
    times = backtest.time_index(df)
    seen = backtest.visibility(df.withColumn("p", F.col("total_return_close")), times, 30)
    spans = backtest.score_spans(backtest.knowledge_events(seen), times)
    grid = spans.withColumn("idx", F.explode(F.sequence("enter", "until"))).join(times, "idx")
    return {
        (r.event_time, r.instrument_id): (r.momentum_63, r.volatility_63, r.trend_50)
        for r in grid.collect()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_features_match_a_slice_per_time(spark, seed):
    pdf = make_bars(seed)
    want, got = reference_features(pdf), grid_of(spark, pdf)
    got = {(pd.Timestamp(t), i): v for (t, i), v in got.items()}
    assert set(want) == set(got) and len(want) > 100
    for key, values in want.items():
        np.testing.assert_allclose(got[key], values, rtol=1e-9)


def test_facts_that_come_late_leave_the_past_alone(spark):
    pdf = make_bars(4, late_share=0.0)
    cut = pdf["event_time"].sort_values().iloc[-40]
    poisoned = pdf.copy()
    row = poisoned.index[(poisoned["event_time"] > cut)][5]
    poisoned.loc[row, "total_return_close"] *= 1e6
    known = poisoned.loc[row, "event_time"] + pd.Timedelta(days=7)
    poisoned.loc[row, ["available_at", "published_at", "first_seen_at"]] = known
    clean, dirty = grid_of(spark, pdf.drop(index=row)), grid_of(spark, poisoned)
    before = {k: v for k, v in dirty.items() if pd.Timestamp(k[0]) + DELAY < known}
    for key, value in before.items():
        if key in clean:
            np.testing.assert_allclose(value, clean[key], rtol=1e-12)


def test_late_vintage_changes_neither_features_nor_benchmark(spark):
    pdf = make_bars(6, late_share=0.0)
    pdf["volume"], pdf["bid_ask_spread_bps"] = 1000.0, 5.0
    extra = pdf[pdf["instrument_id"] == 2].iloc[[150]].copy()
    extra["total_return_close"] *= 1e9
    extra["revision"] = "v2"
    for c in ("available_at", "published_at", "first_seen_at"):
        extra[c] += pd.Timedelta(days=1)

    def dataset(frame):
        known, bench = universe_benchmark(spark.createDataFrame(frame))
        out = supervised_dataset(known, bench, 5)
        return out.toPandas().sort_values(["instrument_id", "event_time"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(dataset(pdf), dataset(pd.concat([pdf, extra])))


def test_costs_never_help(spark):
    pdf = make_bars(9)
    for c in ("open", "close"):
        pdf[c] = pdf["total_return_close"]
    pdf = pdf.assign(bid_ask_spread_bps=5.0, split_factor=1.0, dividend=0.0, fx_rate=1.0,
                     expense_ratio=0.001)
    bars = spark.createDataFrame(pdf)
    total = [
        backtest.Backtest(bars, Limits(fee_bps=fee)).model_net().agg(F.sum("net")).first()[0]
        for fee in (1.0, 25.0)
    ]
    assert total[1] < total[0]


def test_corporate_action_returns(spark):
    """A two-for-one split with a dividend leaves the holder with price move plus cash."""
    days = pd.date_range("2021-01-01", periods=3, freq="D")
    pdf = pd.DataFrame({
        "instrument_id": 1, "event_time": days, "open": [100.0, 51.0, 52.0],
        "split_factor": [1.0, 2.0, 1.0], "dividend": [0.0, 1.0, 0.0], "fx_rate": [1.0, 1.1, 1.1],
        "bid_ask_spread_bps": 5.0, "expense_ratio": 0.0, "total_return_close": 1.0,
    })
    for c in ("published_at", "first_seen_at", "available_at", "as_of"):
        pdf[c] = pdf["event_time"]
    df = spark.createDataFrame(pdf)
    times = backtest.time_index(df)
    none = spark.createDataFrame([], "mode string, idx bigint, instrument_id bigint, weight double")
    shared = {
        "times": times, "weights": none,
        "first": spark.createDataFrame([(1, 0)], "instrument_id bigint, first_idx bigint"),
        "share": times.select("idx", F.lit(1.0).alias("share")),
    }
    rows = backtest.trades(df, shared, 30).orderBy("idx").collect()
    assert rows[0].ret == 0
    assert rows[1].ret == pytest.approx((51 * 2 + 1) * 1.1 / 100 - 1)
    assert rows[2].ret == pytest.approx(52 / 51 - 1)
    assert [r.position_equal for r in rows] == [0.0, 1.0, 1.0]


@pytest.mark.parametrize("cooldown", [240, 3000])
def test_delivery_against_a_plain_loop(spark, cooldown):
    rng = np.random.default_rng(11)
    n = 900
    pdf = pd.DataFrame({
        "channel": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "alert_id": range(n),
        "created_at": pd.Timestamp("2024-03-01") + pd.to_timedelta(
            np.sort(rng.integers(0, 6 * 1440, n)), unit="m"),
        "alert_type": rng.choice(["X", "Y"], n), "instrument_id": rng.integers(0, 12, n),
    })
    limits = Limits(daily_limit=9, cooldown_minutes=cooldown)
    got = deliver(spark.createDataFrame(pdf), limits).toPandas().set_index("alert_id")["outcome"]
    want, history = {}, []
    for r in pdf.sort_values(["created_at", "alert_id"]).itertuples():
        local = r.created_at + pd.Timedelta(hours=8)
        same = [h for h in history if h[0] == r.channel]
        recent = any(
            h[1:3] == (r.alert_type, r.instrument_id) and h[4] in ("SENT", "PENDING")
            and h[3] >= r.created_at - pd.Timedelta(minutes=cooldown) for h in same
        )
        if recent:
            want[r.alert_id] = "COOLDOWN"
            continue
        sent = sum(h[4] == "SENT" and (h[3] + pd.Timedelta(hours=8)).date() == local.date()
                   for h in same)
        state = "SUPPRESSED" if sent >= 9 else (
            "PENDING" if local.hour >= 22 or local.hour < 7 else "SENT")
        history.append((r.channel, r.alert_type, r.instrument_id, r.created_at, state))
        want[r.alert_id] = state
    assert got.sort_index().to_dict() == want
    assert set(want.values()) >= {"COOLDOWN", "PENDING", "SENT"}
    assert cooldown > 240 or "SUPPRESSED" in want.values()
