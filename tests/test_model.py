"""Grouped fits against a plain NumPy fit of each group; folds keep their distance."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import model
from tidemark.plans import QUERIES, models
from tidemark.sources.tables import Tables


def newton(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 100):
    """L2-regularised logistic regression (free intercept): weights, intercept."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], 1.0 / strength), 0.0)
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (p - y) + penalty * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-12)
        move = np.linalg.solve(hessian, gradient)
        beta -= move
        if np.abs(move).max() < 1e-10:
            break
    return beta[:-1], beta[-1]



def test_grouped_fit(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(600, 3)), columns=["a", "b", "c"])
    pdf["k"] = rng.choice([0, 1, 2], 600, p=[0.8, 0.1, 0.1])
    pdf["label"] = (rng.random(600) < 1 / (1 + np.exp(-(pdf["a"] - 0.5 * pdf["b"])))).astype(int)
    got = model.fit_logistic(spark.createDataFrame(pdf), ["k"], ["a", "b", "c"], 0.5).collect()
    assert len(got) == 3
    for row in got:
        part = pdf[pdf["k"] == row.k]
        w, w0 = newton(part[["a", "b", "c"]].to_numpy(), part["label"].to_numpy(float), 0.5)
        np.testing.assert_allclose(row.beta, [*w, w0], atol=1e-6)


def test_folds_keep_their_distance(spark):
    n = 400
    pdf = pd.DataFrame({"instrument_id": 1, "event_time": pd.date_range("2020-01-01", periods=n)})
    out = model.walk_forward(spark.createDataFrame(pdf), ["instrument_id"], 5).toPandas()
    place = {t: i for i, t in enumerate(pdf["event_time"])}
    out["i"] = out["event_time"].map(place)
    assert set(out["fold"]) == {0, 1, 2}
    for _, fold in out.groupby("fold"):
        last = fold.groupby("role")["i"].max()
        first = fold.groupby("role")["i"].min()
        assert last["calibrate"] + 10 < first["test"] + 1
        assert last["fit"] + 10 < first["calibrate"]


def test_short_history_is_refused_when_strict(spark):
    sizes = spark.createDataFrame([(1, 90)], "k int, n bigint")
    assert model.fold_bounds(sizes, 3, 80, 5, 5).count() == 0
    with pytest.raises(Exception, match="too few samples"):
        model.fold_bounds(sizes, 3, 80, 5, 5, strict=True).collect()


def test_calibration_error_edges(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(200), np.arange(11) / 10])
    y = (rng.random(len(p)) < p).astype(int)
    edges, error = np.linspace(0, 1, 11), 0.0
    for a, b in zip(edges[:-1], edges[1:]):
        m = (p >= a) & ((p <= b) if b == 1 else (p < b))
        if m.any():
            error += m.sum() / len(p) * abs(y[m].mean() - p[m].mean())
    df = spark.createDataFrame(pd.DataFrame({"p": p, "label": y}))
    got = model.calibration_error(df.withColumn("x", F.lit(0))).first()[0]
    assert got == pytest.approx(error, abs=2e-2)


def test_separable_scores_converge(spark):
    """Forty separable rows with scores up to 50, beside a group that needs a few steps only."""
    rows = [(0, float(x), int(x > 3)) for x in np.linspace(-50, 50, 40)]
    rows += [(1, float(x), int(x > 0) ^ int(i % 5 == 0)) for i, x in enumerate(np.linspace(-2, 2, 60))]
    df = spark.createDataFrame(rows, "k long, score double, label int")
    got = model.fit_logistic(df, ["k"], ["score"], 1.0, residual=True).collect()
    assert len(got) == 2
    for row in got:
        x = np.array([[r[1], 1.0] for r in rows if r[0] == row.k])
        y = np.array([r[2] for r in rows if r[0] == row.k])
        beta = np.array(row.beta)
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ beta, -500, 500))) - y) + np.array([beta[0], 1e-12 * beta[1]])
        assert np.abs(slope).max() < 1e-4 and row.slope <= 1e-7


def samples(spark):
    """Instruments of several lengths, one too short, one with a single label, one constant in a feature."""
    rng = np.random.default_rng(4)
    parts = []
    for who, n in enumerate([400, 250, 95, 60, 300, 130]):
        pdf = pd.DataFrame(rng.normal(size=(n, len(model.FEATURES))), columns=list(model.FEATURES))
        pdf["instrument_id"], pdf["event_time"] = who, pd.date_range("2020-01-01", periods=n, tz="UTC")
        pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(-pdf["momentum_21"] + pdf["spread_bps"]))).astype("int32")
        parts.append(pdf)
    parts[4]["label"] = np.int32(1)
    parts[1]["spread_bps"] = 0.1
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1))


def test_instruments_taken_whole_predict_as_by_tables(spark):
    data = samples(spark)
    by = ["instrument_id", "fold", "event_time"]
    want = model.evaluate_per_instrument(model.walk_forward(data, ["instrument_id"], 5)).toPandas().sort_values(by, ignore_index=True)
    assert set(want["instrument_id"]) >= {0, 1} and 3 not in set(want["instrument_id"]) and len(want) > 500
    for small in (model.SMALL, 200, 0):
        out = model.evaluate_instruments(data, 5, small=small)
        got = out.toPandas().sort_values(by, ignore_index=True)
        assert out.columns == list(want.columns)
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-7, atol=1e-7)
    assert model.evaluate_instruments(data.limit(0), 5).count() == 0


def test_evaluation_writes_no_features(spark, folder, monkeypatch):
    """Neither the dataset nor its rows for each fold are staged, only the bars known and what is predicted."""
    written = []
    for module in (model, models):
        kept = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, kept=kept: written.append(df.columns) or kept(df))
    assert QUERIES["model_evaluation"](spark, folder).count() == 10
    assert not any({"momentum_21", "z0", "role", "score"} & set(columns) for columns in written)


def test_dataset_made_at_the_evaluation_is_that_of_tables(spark, folder):
    known = models.known_bars(Tables(spark, folder))
    # Odd rows: unknown, zero and no numbers.
    odd = F.pmod(F.xxhash64("event_time"), F.lit(97))
    price = F.when(odd == 1, F.lit(None)).when(odd == 2, 0.0).otherwise(F.col("total_return_close"))
    spread = F.when(odd == 3, float("nan")).when(odd == 4, F.lit(None)).otherwise(F.col("bid_ask_spread_bps"))
    known = model.cut_lineage(known.withColumns({"total_return_close": price, "bid_ask_spread_bps": spread}))
    benchmark, by = model.benchmark_of(known), ["instrument_id", "fold", "event_time"]
    want, got = (model.evaluate_bars(known, benchmark, 5, small=n).toPandas().sort_values(by, ignore_index=True) for n in (0, model.SMALL))
    assert len(want) > 300
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-7, atol=1e-7)
