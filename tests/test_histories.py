"""Histories as arrays against the tables that split them, with late facts and bars that can't trade."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_backtest import make_bars
from tidemark.operators import backtest
from tidemark.operators.crosssection import score_slice


@pytest.fixture(scope="module")
def bars(spark):
    pdf, rng = make_bars(3, late_share=0.15), np.random.default_rng(5)
    pdf["open"] = pdf["total_return_close"]
    pdf = pdf.assign(bid_ask_spread_bps=5.0, split_factor=1.0, dividend=0.0, fx_rate=1.0, expense_ratio=0.001)
    pdf.loc[rng.random(len(pdf)) < 0.05, "dividend"] = 0.3
    df = spark.createDataFrame(pdf)
    shut = F.crc32(F.concat_ws(":", "instrument_id", "event_time").cast("binary")) % 10 == 0
    return df.withColumn("open", F.when(~shut, F.col("open")))


def test_bars_beside_their_past_trade_as_scans_do(bars):
    shared = backtest.prepare(bars, 30, backtest.EXECUTION)
    split = backtest.prepare_split(bars, shared["times"], 30)
    key = ["instrument_id", "idx"]
    names = ["ret", *[f"{x}_{m}" for m in backtest.MODES for x in ("prior", "position")]]
    got = backtest.bar_trades(shared).select(*key, *names).toPandas().sort_values(key)
    want = backtest.trades(bars, split, 30).select(*key, *names).toPandas().sort_values(key)
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-12)
    assert (got["position_model"] > 0).sum() > 20 and (got["ret"] != 0).sum() > 500


def test_slices_never_fall_as_scores_rise(spark):
    values = sorted([*np.random.default_rng(1).normal(0, 0.1, 3000), 0.0, -0.0, 1e300, -1e300, 5e-324, float("inf")])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    slices = [r[0] for r in df.orderBy("i").select(score_slice(F.col("x"))).collect()]
    assert all(a <= b for a, b in zip(slices, slices[1:])) and 200 < len(set(slices)) < 1500
