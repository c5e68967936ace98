"""Supervised dataset, folds, calibration and scoring queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.clocks import CLOCKS, causal_rows
from tidemark.functions.scalars import r6
from tidemark.operators import integrity, model
from tidemark.operators.ordered import latest_version
from tidemark.plans import views
from tidemark.plans.market import BENCH_SQL
from tidemark.plans.registry import query
from tidemark.session import cut_lineage

YEAR = math.sqrt(252)
HORIZON = 5

DATASET_SQL = f"""
bench AS ({BENCH_SQL}),
d0 AS (SELECT b.instrument_id, b.event_time, total_return_close AS p, volume,
        benchmark_total_return_close AS bm, bid_ask_spread_bps AS spread_bps
       FROM bars b JOIN bench ON bench.event_time = b.event_time
       WHERE b.available_at <= b.event_time + INTERVAL '30' MINUTE
         AND benchmark_available_at <= b.event_time + INTERVAL '30' MINUTE),
d1 AS (SELECT *, row_number() OVER w AS rn, p / lag(p) OVER w - 1 AS ret FROM d0
       WINDOW w AS (PARTITION BY instrument_id ORDER BY event_time)),
d2 AS (SELECT *, p / lag(p, 21) OVER w - 1 AS momentum_21, p / lag(p, 63) OVER w - 1 AS momentum_63,
         p / lag(p, 126) OVER w - 1 AS momentum_126,
         stddev_samp(ret) OVER w21 * {YEAR!r} AS volatility_21,
         stddev_samp(least(ret, 0)) OVER w21 * {YEAR!r} AS downside_21,
         p / avg(p) OVER w50 - 1 AS trend_50, volume / median(volume) OVER w21 AS volume_ratio,
         lead(p, {HORIZON}) OVER w / p - lead(bm, {HORIZON}) OVER w / bm - 8.0::DOUBLE / 10000
           AS excess FROM d1
       WINDOW w AS (PARTITION BY instrument_id ORDER BY event_time),
         w21 AS (PARTITION BY instrument_id ORDER BY event_time ROWS 20 PRECEDING),
         w50 AS (PARTITION BY instrument_id ORDER BY event_time ROWS 49 PRECEDING)),
ds AS (SELECT *, CASE WHEN excess > 0 THEN 1 ELSE 0 END AS label FROM d2
       WHERE rn >= 127 AND excess IS NOT NULL)"""


def known_bars(t):
    """The latest vintages known in time, written once."""
    bars = views.facts(t).select(
        "instrument_id", *CLOCKS, "revision", "total_return_close", "volume", "bid_ask_spread_bps"
    )
    return cut_lineage(latest_version(causal_rows(bars), ["instrument_id", "event_time"]))


def dataset(known):
    """The benchmark and the bars joined to it rest on the same vintages."""
    return model.supervised_dataset(known, model.benchmark_of(known), HORIZON)


def folds(t):
    """The dataset with folds and roles; it is read several times, so it is written first."""
    return model.walk_forward(cut_lineage(dataset(known_bars(t))), ["instrument_id"], HORIZON)


@query(
    "model_dataset", "J-10",
    "WITH " + DATASET_SQL + """
    SELECT instrument_id, strftime(event_time, '%Y-%m-%d') AS day,
      round(momentum_21, 6) AS momentum_21, round(momentum_63, 6) AS momentum_63,
      round(momentum_126, 6) AS momentum_126, round(volatility_21, 6) AS volatility_21,
      round(downside_21, 6) AS downside_21, round(trend_50, 6) AS trend_50,
      round(volume_ratio, 6) AS volume_ratio, spread_bps, label FROM ds""",
    "bars",
)
def _model_dataset(t):
    return dataset(known_bars(t)).select(
        "instrument_id", F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        *[r6(F.col(c)).alias(c) for c in model.FEATURES if c != "spread_bps"], "spread_bps", "label",
    )


@query(
    "walk_forward_folds", "J-11",
    "WITH " + DATASET_SQL + """,
    ix AS (SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY event_time)
             - 1 AS i, count(*) OVER (PARTITION BY instrument_id) AS n FROM ds),
    fd AS (SELECT ix.*, f AS fold, 80 + f * greatest(1, (n - 90) // 3) AS te FROM ix,
             (VALUES (0), (1), (2)) v(f) WHERE n > 80 + 10 + 3),
    fe AS (SELECT *, te + 10 AS ts, least(n, te + 10 + greatest(1, (n - 90) // 3)) AS tx,
             te - greatest(20, te // 5) AS cs FROM fd),
    ro AS (SELECT *, CASE WHEN i >= ts AND i < tx THEN 'test' WHEN i >= cs AND i < te THEN
             'calibrate' WHEN i + 10 < cs THEN 'fit' END AS role FROM fe)
    SELECT instrument_id, CAST(fold AS INT) AS fold, role, count(*) AS samples FROM ro
    WHERE role IS NOT NULL GROUP BY 1, 2, 3""",
    "bars",
)
def _walk_forward_folds(t):
    assigned = folds(t)
    return assigned.groupBy("instrument_id", "fold", "role").agg(F.count("*").alias("samples"))


@query("model_evaluation", "J-12 J-13")
def _model_evaluation(t):
    """Per-instrument walk-forward evaluation with calibrated probabilities."""
    known = known_bars(t)
    predictions = cut_lineage(model.evaluate_bars(known, model.benchmark_of(known), HORIZON).select(
        "instrument_id", "label", "p", "p_base"
    ))
    scores = model.brier(predictions, ["instrument_id"]).join(
        model.calibration_error(predictions, ["instrument_id"]), "instrument_id"
    )
    status = model.model_status(F.col("brier_score"), F.col("baseline_brier_score"))
    return scores.select(
        "instrument_id", r6(F.col("brier_score")).alias("brier_score"),
        r6(F.col("baseline_brier_score")).alias("baseline_brier_score"),
        r6(F.col("calibration_error")).alias("calibration_error"), "samples",
        status.alias("status"),
    )


@query("pooled_model", "J-12")
def _pooled_model(t):
    """One model over all instruments, last fold."""
    assigned = cut_lineage(folds(t))
    predictions = model.evaluate_pooled(assigned, 2)
    return model.brier(predictions).select(
        r6(F.col("brier_score")).alias("brier_score"),
        r6(F.col("baseline_brier_score")).alias("baseline_brier_score"), "samples",
    )


@query(
    "brier_score", "D-09 J-13",
    """SELECT round(avg((p - label) * (p - label)), 6) AS brier_score,
         round(avg((p_base - label) * (p_base - label)), 6) AS baseline_brier_score,
         count(*) AS samples, CASE WHEN avg((p - label) * (p - label)) <
           avg((p_base - label) * (p_base - label)) THEN 'EXPERIMENTAL' ELSE 'REJECTED' END AS status
       FROM predictions""",
    "predictions",
)
def _brier_score(t):
    b = model.brier(views.predictions(t))
    return b.select(
        r6(F.col("brier_score")).alias("brier_score"),
        r6(F.col("baseline_brier_score")).alias("baseline_brier_score"), "samples",
        model.model_status(F.col("brier_score"), F.col("baseline_brier_score")).alias("status"),
    )


@query(
    "calibration_error", "D-10",
    """WITH b AS (SELECT least((SELECT max(e) FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8),
             (9)) v(e) WHERE e / 10.0::DOUBLE <= p), 9) AS bin, label, p FROM predictions),
       g AS (SELECT bin, count(*) AS n, abs(avg(label) - avg(p)) AS gap FROM b GROUP BY bin)
       SELECT round(sum(n * gap) / sum(n), 6) AS calibration_error FROM g""",
    "predictions",
)
def _calibration_error(t):
    return model.calibration_error(views.predictions(t)).select(
        r6(F.col("calibration_error")).alias("calibration_error")
    )


@query(
    "artifact_verification", "I-09 I-10",
    """SELECT doc_id, doc_id % 10 <> 3 AS hash_ok, doc_id % 7 <> 2 AS status_ok FROM predictions""",
    "predictions",
)
def _artifact_verification(t):
    columns = ["doc_id", "p", "p_base", "status"]
    rows = views.predictions(t).withColumn(
        "status", model.model_status(F.col("p"), F.col("p_base"))
    )
    flipped = F.when(F.col("status") == "REJECTED", "EXPERIMENTAL").otherwise("REJECTED")
    stored = integrity.seal(
        rows.withColumn(
            "status", F.when(F.col("doc_id") % 7 == 2, flipped).otherwise(F.col("status"))
        ),
        columns,
    ).withColumn("p_base", F.when(F.col("doc_id") % 10 == 3, F.col("p_base") + 1e-5)
                 .otherwise(F.col("p_base")))
    bad = integrity.seal_mismatches(stored, columns).select("doc_id", F.lit(True).alias("_bad"))
    honest = F.when(F.col("doc_id") % 10 == 3, F.col("p_base") - 1e-5).otherwise(F.col("p_base"))
    status_ok = F.col("status") == model.model_status(F.col("p"), F.round(honest, 6))
    return stored.join(bad, "doc_id", "left").select(
        "doc_id", F.col("_bad").isNull().alias("hash_ok"), status_ok.alias("status_ok")
    )
