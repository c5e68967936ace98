"""Long frames as arrays against the same frames as windows, and small fits without a pass a step."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import model
from tidemark.operators.ordered import array_frames, frame_median, frames
from tidemark.plans import QUERIES, market
from tidemark.sources.tables import Tables


def test_array_frames_equal_windows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in (1, 2):
        for i in range(1, 41):
            x = None if rng.random() < 0.2 else float(np.round(rng.normal(5, 2), 3))
            rows.append((k, i, x))
    rows += [(3, 1, 2.0), (4, 1, None), (5, 1, float("nan")), (5, 2, 1.0), (5, 3, 4.0)]
    df = spark.createDataFrame(rows, "k long, ordinal long, x double")

    def arrays(f, c):
        x = c["x"]
        return {"back": f.lag(x, 3), "on": f.lag(x, -2), "ret": f.change(x), "avg": f.mean(x, 7),
                "sd": f.sd(f.change(x), 6), "mid": f.median(x, 6)}

    def first(w):
        return {"ret": F.try_divide("x", F.lag("x").over(w)) - 1}

    def then(w):
        last = lambda n: w.rowsBetween(-(n - 1), 0)
        return {"back": F.lag("x", 3).over(w), "on": F.lead("x", 2).over(w), "avg": F.avg("x").over(last(7)),
                "sd": F.stddev_samp("ret").over(last(6)), "mid": frame_median(F.col("x"), last(6))}

    names = ["back", "on", "ret", "avg", "sd", "mid"]
    got = array_frames(df, ["k"], ["x"], arrays, names, back=7, ahead=2, size=5)
    want = frames(df, ["k"], [first, then], back=7, ahead=2, size=5)
    read = lambda d: {(r.k, r.ordinal): [r[n] for n in names] for r in d.collect()}
    got, want = read(got), read(want)
    assert set(got) == set(want) and len(got) == len(rows)
    for key, values in want.items():
        assert [v is None for v in got[key]] == [v is None for v in values], key
        known = [(g, v) for g, v in zip(got[key], values) if v is not None]
        np.testing.assert_allclose(*zip(*known) if known else ([], []), rtol=1e-9, atol=1e-12)


def test_a_change_from_zero_fails_if_strict(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0)], "k long, ordinal long, x double")
    out = array_frames(df, ["k"], ["x"], lambda f, c: {"r": f.change(c["x"], strict=True)}, ["r"], back=1)
    with pytest.raises(Exception, match="a change from zero"):
        out.collect()


@pytest.mark.parametrize("name", ["window_factors", "model_dataset"])
def test_long_frames_are_not_summed_row_by_row(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    assert "stddev_samp" not in plan and "collect_list" not in plan


def test_small_groups_are_fitted_without_a_pass_a_step(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"])
    pdf["k"] = rng.choice([0, 1, 2], 300)
    pdf["label"] = (rng.random(300) < 1 / (1 + np.exp(-pdf["a"]))).astype(int)
    df = spark.createDataFrame(pdf)
    stepwise = {r.k: r.beta for r in model.fit_logistic(df, ["k"], ["a", "b"], 0.5, small=0).collect()}
    mixed = {r.k: r.beta for r in model.fit_logistic(df, ["k"], ["a", "b"], 0.5, small=100).collect()}
    spark.sparkContext.setJobGroup("fit", "fit")
    few = {r.k: r.beta for r in model.fit_logistic(df, ["k"], ["a", "b"], 0.5).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 8
    for k in (0, 1, 2):
        np.testing.assert_allclose(few[k], stepwise[k], atol=1e-9)
        np.testing.assert_allclose(mixed[k], stepwise[k], atol=1e-9)


def test_staged_bars_hold_the_columns_asked_for(spark, folder):
    t = Tables(spark, folder)
    few = market.staged_bars(t, "instrument_id", "event_time", "close")
    assert few.columns == ["instrument_id", "event_time", "close"]
    whole = market.staged_bars(t).select(*few.columns)
    assert few.exceptAll(whole).isEmpty() and few.count() == whole.count()
