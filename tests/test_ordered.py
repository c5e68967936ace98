"""Ordered operators against pandas, with chunks and buckets far smaller than the hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.crosssection import capped_weights, exact_median, percentile_rank, top_spans
from tidemark.operators.ordered import Running, asof, frame_median, frames, ordinals, running


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds most of the rows."""
    rng = np.random.default_rng(3)
    k = np.where(rng.random(1500) < 0.8, 0, rng.integers(1, 6, 1500))
    pdf = pd.DataFrame({"k": k, "t": rng.permutation(1500), "x": rng.normal(size=1500).round(6)})
    pdf["y"] = pdf["x"].where(rng.random(1500) < 0.5)
    return pdf


def slices(width):
    return F.floor(F.col("t") / width)


def test_running(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    out = running(
        df, ["k"], ["t"], slices(37),
        {"s": Running("sum", F.col("x")), "m": Running("max", F.col("x")),
         "l": Running("last", F.col("y")), "before": Running("last", F.col("y"), True)},
    ).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    ref = skewed.sort_values(["k", "t"]).reset_index(drop=True)
    g = ref.groupby("k")
    np.testing.assert_allclose(out["s"], g["x"].cumsum(), atol=1e-9)
    np.testing.assert_allclose(out["m"], g["x"].cummax())
    np.testing.assert_allclose(out["l"], g["y"].ffill())
    np.testing.assert_allclose(out["before"], g["y"].ffill().groupby(ref["k"]).shift(1))


def test_running_reverse(spark, skewed):
    df = spark.createDataFrame(skewed[["k", "t", "x"]])
    out = running(df, ["k"], ["t"], slices(50), {"nxt": Running("last", F.col("x"), True)},
                  reverse=True).toPandas().sort_values(["k", "t"])
    ref = skewed.sort_values(["k", "t"])
    np.testing.assert_allclose(out["nxt"], ref.groupby("k")["x"].shift(-1))


@pytest.mark.parametrize("size", [7, 64])
def test_frames(spark, skewed, size):
    df = ordinals(spark.createDataFrame(skewed[["k", "t", "x"]]), ["k"], ["t"], slices(41))

    def step(w):
        last = w.rowsBetween(-9, 0)
        return {"avg": F.avg("x").over(last), "med": frame_median(F.col("x"), last),
                "lead": F.lead("x", 3).over(w), "lag": F.lag("x", 9).over(w)}

    out = frames(df, ["k"], [step], back=9, ahead=3, size=size).toPandas().sort_values(["k", "t"])
    assert len(out) == len(skewed)
    ref = skewed.sort_values(["k", "t"])
    roll = ref.groupby("k")["x"].rolling(10, min_periods=1)
    np.testing.assert_allclose(out["avg"], roll.mean().to_numpy(), atol=1e-9)
    np.testing.assert_allclose(out["med"], roll.median().to_numpy(), atol=1e-12)
    np.testing.assert_allclose(out["lead"], ref.groupby("k")["x"].shift(-3))
    np.testing.assert_allclose(out["lag"], ref.groupby("k")["x"].shift(9))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, forward, strict):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": rng.integers(0, 3, 300), "t": rng.integers(0, 400, 300)})
    left["id"] = range(300)
    right = pd.DataFrame({"k": rng.integers(0, 3, 200), "s": rng.integers(0, 400, 200)})
    right = right.drop_duplicates(["k", "s"])
    right["v"] = rng.normal(size=len(right))
    got = asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "s", ["v"],
               bucket=lambda c: F.floor(c / 23), forward=forward, strict=strict).toPandas()
    ref = pd.merge_asof(
        left.sort_values("t"), right.sort_values("s"), left_on="t", right_on="s", by="k",
        direction="forward" if forward else "backward", allow_exact_matches=not strict,
    )
    a, b = got.set_index("id")["v"].sort_index(), ref.set_index("id")["v"].sort_index()
    np.testing.assert_allclose(a, b)


def test_percentile_rank_with_ties(spark, skewed):
    pdf = skewed.assign(x=skewed["x"].round(1))
    out = percentile_rank(spark.createDataFrame(pdf[["k", "t", "x"]]), ["k"], "x").toPandas()
    out = out.sort_values("t")["pct_rank"].to_numpy()
    ref = pdf.sort_values("t").groupby("k")["x"].rank(pct=True).to_numpy()
    np.testing.assert_allclose(out, ref, atol=1e-12)


def test_exact_median(spark, skewed):
    out = exact_median(spark.createDataFrame(skewed[["k", "t", "x"]]), ["k"], "x", "t").toPandas()
    ref = skewed.groupby("k")["x"].median()
    np.testing.assert_allclose(out.set_index("k")["median"].sort_index(), ref)


def _waterfill(raw: pd.Series, budget: float, cap: float) -> pd.Series:
    """Definition by rounds: share, cap whoever exceeds, share the rest again."""
    done = {}
    while len(raw) and budget - sum(done.values()) > 1e-12:
        share = raw / raw.sum() * (budget - sum(done.values()))
        over = share[share > cap]
        if over.empty:
            done.update(share)
            break
        done.update({i: cap for i in over.index})
        raw = raw.drop(over.index)
    return pd.Series(done)


def test_capped_weights(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):
        n = rng.integers(1, 40)
        rows += [(g, int(i), float(w)) for i, w in enumerate(rng.exponential(size=n).round(2) + 0.01)]
    pdf = pd.DataFrame(rows, columns=["g", "i", "w"])
    out = capped_weights(spark.createDataFrame(pdf), ["g"], "w", "i", 0.8, 0.1).toPandas()
    for g, part in pdf.groupby("g"):
        ref = _waterfill(part.set_index("i")["w"], 0.8, 0.1).sort_index()
        got = out[out["g"] == g].set_index("i")["weight"].sort_index()
        np.testing.assert_allclose(got, ref.reindex(got.index).fillna(0), atol=1e-9)


@pytest.mark.parametrize("digits, equal", [(2, False), (6, False), (3, True)])
def test_top_spans_rank_every_step(spark, digits, equal):
    """The steps at which a span's percentile reaches 0.75, against ranks of a dense panel."""
    rng = np.random.default_rng(digits)
    rows = []
    for g in ("a", "b"):
        for i in range(40):
            at = int(rng.integers(0, 30))
            while at < 200 and (i or g == "a"):
                end = min(199, at + int(rng.integers(0, 40)))
                score = 0.5 if equal else round(float(rng.normal(0, 0.3)), digits)
                rows.append((g, i, at, end, score))
                at = end + 1 + int(rng.integers(0, 2) * 5)
    pdf = pd.DataFrame(rows, columns=["g", "i", "enter", "until", "x"])
    out = top_spans(spark.createDataFrame(pdf), ["g"], "x", 0.75).toPandas()
    dense = pdf.assign(idx=[range(a, b + 1) for a, b in zip(pdf["enter"], pdf["until"])]).explode("idx")
    pct = dense.groupby(["g", "idx"])["x"].rank(pct=True)
    want = dense[pct >= 0.75]
    key = ["g", "idx", "i"]
    assert sorted(map(tuple, out[key].to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))
    assert len(out) > 300 or equal


def test_equal_scores_of_one_group_are_one_value(spark):
    df = spark.range(50_000).select(F.lit(1).alias("k"), F.lit(0.25).alias("x"), "id")
    out = percentile_rank(df, ["k"], "x").agg(F.min("pct_rank"), F.max("pct_rank"), F.count("*")).first()
    assert out[0] == out[1] == pytest.approx((50_000 + 1) / 2 / 50_000) and out[2] == 50_000
