"""Supervised datasets, purged walk-forward folds, calibration and scoring of probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clocks import CLOCKS, causal_rows, known_at, minutes, require_clocks
from tidemark.functions.scalars import logistic
from tidemark.operators.ordered import array_frames, array_steps, latest_version, month, ordinals
from tidemark.session import cut_lineage

YEAR = math.sqrt(252)


def universe_benchmark(bars: DataFrame, delay_minutes: float = 30) -> tuple[DataFrame, DataFrame]:
    """Facts known in time (latest vintage) and their cross-sectional mean per event time."""
    require_clocks(bars, CLOCKS)
    known = latest_version(causal_rows(bars, delay_minutes), ["instrument_id", "event_time"])
    return known, benchmark_of(known)


def benchmark_of(known: DataFrame) -> DataFrame:
    """Cross-sectional mean per event time of facts with one vintage each."""
    clocks = [c for c in CLOCKS if c != "event_time"]
    return known.groupBy("event_time").agg(
        F.avg("total_return_close").alias("benchmark_total_return_close"),
        *[F.max(c).alias(f"benchmark_{c}") for c in clocks],
        # One row per instrument and time is left, so counting rows counts instruments.
        F.count("*").alias("benchmark_constituent_count"),
    )


def _joined(bars: DataFrame, benchmark: DataFrame, delay_minutes: float) -> DataFrame:
    """Prices, volumes and spreads beside the benchmark, of rows known in time."""
    c = F.col
    clocks = [f"benchmark_{x}" for x in CLOCKS if x != "event_time"]
    return bars.join(benchmark, "event_time").filter(
        known_at([*CLOCKS, *clocks]) <= c("event_time") + minutes(delay_minutes)
    ).select(
        "instrument_id", "event_time", c("total_return_close").alias("p"), "volume",
        c("benchmark_total_return_close").alias("b"), c("bid_ask_spread_bps").alias("spread_bps"),
    )


def _features(horizon: int, cost_bps: float):
    """Features and excess return of consecutive rows of one instrument, as arrays of values and of which are known."""
    year = YEAR

    def features(f, x):
        def ratio(a, b):
            known = a[1] & b[1] & (b[0] != 0)
            return np.where(known, a[0] / np.where(known, b[0], 1.0), 0.0), known

        def change(b):
            return tuple(v - 1 if k == 0 else v for k, v in enumerate(ratio(x["p"], b)))

        def full(n, a):
            return a[0], a[1] & (x["ordinal"][0] >= n)

        ret = f.change(x["p"])
        # The least of an unknown change and 0 is 0.
        fall = (np.where(ret[1] & (ret[0] < 0), ret[0], 0.0), np.ones(len(ret[0]), bool))
        gain, other = (ratio(f.lag(x[k], -horizon), x[k]) for k in ("p", "b"))
        deviations = {name: f.sd(v, 21) for name, v in (("volatility_21", ret), ("downside_21", fall))}
        return {
            **{f"momentum_{n}": change(f.lag(x["p"], n)) for n in (21, 63, 126)},
            **{name: full(22, (v * year, known)) for name, (v, known) in deviations.items()},
            "trend_50": full(50, change(f.mean(x["p"], 50))),
            "volume_ratio": full(21, ratio(x["volume"], f.median(x["volume"], 21))),
            "excess": (gain[0] - other[0] - cost_bps / 10000, gain[1] & other[1]),
        }

    return features


def _dataset(slim: DataFrame, horizon: int, cost_bps: float) -> DataFrame:
    c = F.col
    placed = ordinals(slim, ["instrument_id"], ["event_time"], month("event_time"))
    out = array_frames(
        placed, ["instrument_id"], ["p", "b", "volume", "ordinal"], _features(horizon, cost_bps),
        [*(x for x in FEATURES if x != "spread_bps"), "excess"], back=126, ahead=horizon,
    )
    complete = out.filter(
        known_features() & c("excess").isNotNull()
    ).withColumn("label", (c("excess") > 0).cast("int"))
    return complete.select("instrument_id", "event_time", *FEATURES, "label")


def supervised_dataset(
    bars: DataFrame, benchmark: DataFrame, horizon: int, cost_bps: float = 8.0,
    delay_minutes: float = 30,
) -> DataFrame:
    """Eight features and the label "beats the benchmark after costs over the horizon".

    ``bars`` holds one vintage per (instrument, time). Rows known too late, with incomplete features
    or without a full horizon are left out.
    """
    return _dataset(_joined(bars, benchmark, delay_minutes), horizon, cost_bps)


FEATURES = (
    "momentum_21", "momentum_63", "momentum_126", "volatility_21", "downside_21", "trend_50",
    "volume_ratio", "spread_bps",
)


def known_features():
    out = F.lit(True)
    for name in FEATURES:
        out = out & F.col(name).isNotNull() & ~F.isnan(name)
    return out


def fold_bounds(
    samples: DataFrame, folds: int, min_train: int, purge: int, embargo: int, strict: bool = False
) -> DataFrame:
    """Fold table per group: train [0, train_end), test [test_start, test_end), 0-based.

    ``samples`` has the group columns and ``n``. Groups too short for the folds are left out, or
    fail the job in strict mode.
    """
    gap = purge + embargo
    n = F.col("n")
    enough = n > min_train + gap + folds
    if strict:
        samples = samples.filter(
            F.when(~enough, F.raise_error(F.lit("too few samples")).cast("boolean")).otherwise(True)
        )
    size = F.greatest(F.lit(1), F.floor((n - min_train - gap) / folds))
    return (
        samples.filter(enough)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("train_end", (min_train + F.col("fold") * size).cast("bigint"))
        .withColumn("test_start", F.col("train_end") + gap)
        .withColumn("test_end", F.least(n, F.col("test_start") + size))
        .filter(F.col("test_end") > F.col("test_start"))
        .drop("n")
    )


def walk_forward(
    data: DataFrame, keys: list[str], horizon: int, folds: int = 3, embargo: int = 5
) -> DataFrame:
    """Assign rows to (fold, role) with role fit, calibrate or test.

    Training rows end before a purge gap; inside training the last fifth (at least 20) calibrates
    and is separated from the fit rows by the same gap.
    """
    c = F.col
    placed = ordinals(data, keys, ["event_time"], month("event_time"), "_n").withColumn(
        "_i", c("_n") - 1
    ).drop("_n")
    sizes = data.groupBy(*keys).agg(F.count("*").alias("n"))
    bounds = fold_bounds(sizes, folds, max(80, horizon * 4), horizon, embargo)
    joined = placed.join(bounds, keys)
    calibrate_from = c("train_end") - F.greatest(F.lit(20), F.floor(c("train_end") / 5))
    role = (
        F.when((c("_i") >= c("test_start")) & (c("_i") < c("test_end")), "test")
        .when((c("_i") >= calibrate_from) & (c("_i") < c("train_end")), "calibrate")
        .when(c("_i") + horizon + embargo < calibrate_from, "fit")
    )
    return joined.withColumn("role", role).filter(c("role").isNotNull()).drop(
        "_i", "train_end", "test_start", "test_end"
    )


_POINT = T.ArrayType(T.DoubleType())
_STATE = T.StructType(
    [T.StructField("beta", _POINT), T.StructField("best", _POINT), T.StructField("slope", T.DoubleType())]
)


@F.pandas_udf(_STATE)
def _newton_step(
    beta: pd.Series, best: pd.Series, slope: pd.Series, gradient: pd.Series, hessian: pd.Series,
    rows: pd.Series,
) -> pd.DataFrame:
    """One small system per group: the Newton step from a point that lowered the gradient, else half
    the way back to the best point. H is given by its upper triangle."""
    out = []
    for b, old, s, g, h, n in zip(beta, best, slope, gradient, hessian, rows):
        b, old, g = np.asarray(b), np.asarray(old), np.asarray(g)
        now = float(np.abs(g).max()) / max(n, 1)
        if not now < s:
            out.append(((b + old) / 2, old, s))
            continue
        full = np.zeros((len(b), len(b)))
        full[np.triu_indices(len(b))] = h
        full = full + np.triu(full, 1).T
        out.append((b - np.linalg.solve(full, g), b, now))
    return pd.DataFrame(out, columns=["beta", "best", "slope"])


# Groups of at most this many rows are solved where they lie.
SMALL = 4096


def _newton(penalty: list[float], steps: int = 7, tolerance: float = 1e-7, rounds: int = 12):
    """The steps of ``fit_logistic`` over the rows of one group as arrays: (best point, largest gradient a row)."""

    def newton(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        x, weight = np.column_stack([x, np.ones(len(x))]), np.asarray(penalty)
        beta = best = np.zeros(x.shape[1])
        slope, done = np.inf, 0
        while done < steps * rounds and not (done % steps == 0 and slope <= tolerance):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
            gradient = x.T @ (p - y) + weight * beta
            now = float(np.abs(gradient).max()) / len(x)
            if now < slope:
                hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(weight)
                beta, best, slope = beta - np.linalg.solve(hessian, gradient), beta, now
            else:
                beta = (beta + best) / 2
            done += 1
        return best, slope

    return newton


def _solver(keys: list[str], features: list[str], penalty: list[float], steps: int, tolerance: float, rounds: int):
    newton = _newton(penalty, steps, tolerance, rounds)

    def solve(table: pa.Table) -> pa.Table:
        x = np.column_stack([table[f].cast(pa.float64()).to_numpy() for f in features])
        best, slope = newton(x, table["label"].cast(pa.float64()).to_numpy())
        group = table.select(keys).slice(0, 1)
        group = group.append_column("best", pa.array([best.tolist()], pa.list_(pa.float64())))
        return group.append_column("slope", pa.array([slope], pa.float64()))

    return solve


def fit_logistic(
    rows: DataFrame, keys: list[str], features: list[str], strength: float, steps: int = 7,
    tolerance: float = 1e-7, rounds: int = 12, residual: bool = False, small: int = SMALL,
) -> DataFrame:
    """L2-regularised logistic regression per group by Newton steps: ``beta``, intercept last.

    A step is one aggregation: gradient and Hessian are sums that combine map-side, so a group may
    hold any number of rows. Only the solution of the small system sees a group as one row. The
    intercept is not penalised. Steps that don't lower the largest gradient a row are halved; after
    every ``steps`` of them the largest left of any group, one number, decides on another round.
    ``residual`` adds it per group as ``slope``. Groups of at most ``small`` rows take the same steps in one
    task each; only larger ones pay for a pass a step.
    """
    size = len(features) + 1
    x = [F.col(f) for f in features] + [F.lit(1.0)]
    penalty = [1.0 / strength] * len(features) + [1e-12]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    rows = rows.select(*keys, *features, "label")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = cut_lineage(sizes.filter(F.col("_n") > small).select(*keys))
    some_large = not large.isEmpty()
    key_types = [f for f in rows.schema.fields if f.name in keys]
    solved = (rows.join(large, keys, "left_anti") if some_large else rows).groupBy(*keys).applyInArrow(
        _solver(keys, features, penalty, steps, tolerance, rounds),
        T.StructType([*sorted(key_types, key=lambda f: keys.index(f.name)), T.StructField("best", _POINT),
                      T.StructField("slope", T.DoubleType())]),
    )
    kept_columns = [*keys, F.col("best").alias("beta"), *(["slope"] if residual else [])]
    if not some_large:
        return solved.select(*kept_columns)
    rows = cut_lineage(rows.join(large, keys, "left_semi"))
    zero = F.array(*[F.lit(0.0)] * size)
    state = rows.select(*keys).distinct().withColumns(
        {"beta": zero, "best": zero, "slope": F.lit(float("inf"))}
    )
    kept = ("beta", "best", "slope")
    for _ in range(rounds):
        for _ in range(steps):
            b = [F.col("beta")[i] for i in range(size)]
            score = sum((v * w for v, w in zip(x[1:], b[1:])), x[0] * b[0])
            bounded = F.least(F.greatest(score, F.lit(-500.0)), F.lit(500.0))
            scored = rows.join(state, keys).withColumn("_p", logistic(bounded, 1.0)).withColumns(
                {"_e": F.col("_p") - F.col("label"), "_w": F.col("_p") * (1 - F.col("_p"))}
            )
            sums = scored.groupBy(*keys).agg(
                *[F.first(c).alias(c) for c in kept], F.count("*").alias("_n"),
                *[F.sum(F.col("_e") * x[i]).alias(f"_g{i}") for i in range(size)],
                *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"_h{i}_{j}") for i, j in pairs],
            )
            gradient = F.array(
                *[F.col(f"_g{i}") + penalty[i] * F.col("beta")[i] for i in range(size)]
            )
            hessian = F.array(
                *[F.col(f"_h{i}_{j}") + (penalty[i] if i == j else 0.0) for i, j in pairs]
            )
            moved = _newton_step(*[F.col(c) for c in kept], gradient, hessian, F.col("_n"))
            state = sums.select(*keys, moved.alias("_s")).select(*keys, "_s.*")
        # The steps of a round form one job; each reads the rows once, after the step before.
        state = cut_lineage(state)
        left = state.agg(F.max("slope")).first()[0]
        if left is None or left <= tolerance:
            break
    return solved.select(*kept_columns).unionByName(state.select(*kept_columns))


def evaluate_per_instrument(assigned: DataFrame) -> DataFrame:
    """Calibrated test probabilities of one small model per (instrument, fold).

    Features are standardised on the fit rows, the model is fitted there, and its score is
    calibrated on the later calibration rows. Groups with a single class in either part are left
    out.
    """
    c = F.col
    keys = ["instrument_id", "fold"]
    part = lambda r, x: F.when(c("role") == r, x)
    stats = assigned.groupBy(*keys).agg(
        *[F.avg(part("fit", c(f))).alias(f"_m_{f}") for f in FEATURES],
        *[F.stddev_pop(part("fit", c(f))).alias(f"_s_{f}") for f in FEATURES],
        *[F.min(part(r, c("label"))).alias(f"_lo_{r}") for r in ("fit", "calibrate")],
        *[F.max(part(r, c("label"))).alias(f"_hi_{r}") for r in ("fit", "calibrate")],
        F.count_if(c("role") == "test").alias("_tests"),
    ).filter(
        (c("_lo_fit") < c("_hi_fit")) & (c("_lo_calibrate") < c("_hi_calibrate")) & (c("_tests") > 0)
    )
    scaled = cut_lineage(
        assigned.join(stats, keys).select(
            *keys, "role", "event_time", "label", "momentum_63",
            *[
                ((c(f) - c(f"_m_{f}")) / F.when(c(f"_s_{f}") > 0, c(f"_s_{f}")).otherwise(1.0))
                .alias(f"z{i}")
                for i, f in enumerate(FEATURES)
            ],
        )
    )
    names = [f"z{i}" for i in range(len(FEATURES))]
    beta = fit_logistic(scaled.filter(c("role") == "fit"), keys, names, 0.5)
    score = c("beta")[len(names)]
    for i, n in enumerate(names):
        score = score + c("beta")[i] * c(n)
    raw = cut_lineage(
        scaled.filter(c("role") != "fit").join(beta, keys).select(
            *keys, "role", "event_time", "label", "momentum_63", score.alias("score")
        )
    )
    platt = fit_logistic(raw.filter(c("role") == "calibrate"), keys, ["score"], 1.0)
    return raw.filter(c("role") == "test").join(platt, keys).select(
        *keys, "event_time", "label",
        logistic(c("score") * c("beta")[0] + c("beta")[1], 1.0).alias("p"),
        F.when(c("momentum_63") > 0, 0.58).otherwise(0.42).alias("p_base"),
    )


def _evaluator(horizon: int, folds: int, embargo: int):
    """``walk_forward`` and ``evaluate_per_instrument`` over the rows of one instrument, as arrays."""
    names, least, gap = list(FEATURES), max(80, horizon * 4), horizon + embargo
    fitted, calibrated = _newton([1.0 / 0.5] * len(names) + [1e-12]), _newton([1.0, 1e-12])

    def evaluate(table: pa.Table) -> pa.Table:
        table = table.sort_by("event_time")
        x = np.column_stack([table[f].cast(pa.float64()).to_numpy() for f in names])
        y, n = table["label"].cast(pa.float64()).to_numpy(), table.num_rows
        size = max(1, (n - least - gap) // folds)
        plain = table.select(["instrument_id", "event_time", "label"])
        columns = {"fold": pa.int32(), "p": pa.float64(), "p_base": pa.float64()}
        out = [plain.slice(0, 0)]
        for name, kind in columns.items():
            out[0] = out[0].append_column(name, pa.array([], kind))
        for fold in range(folds) if n > least + gap + folds else ():
            end = least + fold * size
            start, since = end + gap, end - max(20, end // 5)
            stop, until = min(n, start + size), max(since - gap, 0)
            if stop <= start or not all(len(set(part.tolist())) > 1 for part in (y[:until], y[since:end])):
                continue
            middle, spread = x[:until].mean(0), x[:until].std(0)
            spread[(x[:until].max(0) == x[:until].min(0)) | (spread <= 0)] = 1.0
            z = (x - middle) / spread
            beta, score = fitted(z[:until], y[:until])[0], 0.0
            for i in (-1, *range(len(names))):
                score = score + beta[i] * (z[:, i] if i >= 0 else 1.0)
            slope, shift = calibrated(score[since:end, None], y[since:end])[0]
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-(score[start:stop] * slope + shift)))
            base = np.where(x[start:stop, names.index("momentum_63")] > 0, 0.58, 0.42)
            part = plain.slice(start, stop - start)
            for (name, kind), values in zip(columns.items(), (np.full(stop - start, fold), p, base)):
                part = part.append_column(name, pa.array(values, kind))
            out.append(part)
        return pa.concat_tables(out).select(["instrument_id", "fold", "event_time", "label", "p", "p_base"])

    return evaluate


def _derived(horizon: int, cost_bps: float):
    """``_dataset`` over the rows of one instrument, as arrays."""
    features, steps, names = _features(horizon, cost_bps), array_steps(), list(FEATURES)

    def derive(table: pa.Table) -> pa.Table:
        table, cells = table.sort_by("event_time"), {}
        for name in ("p", "b", "volume", "spread_bps"):
            column = table[name].cast(pa.float64())
            cells[name] = (column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy())
        cells["ordinal"] = (np.arange(1.0, table.num_rows + 1), np.ones(table.num_rows, bool))
        with np.errstate(all="ignore"):
            out = features(steps, cells) | {"spread_bps": cells["spread_bps"]}
        excess, kept = out.pop("excess")
        for values, known in out.values():
            kept = kept & known & ~np.isnan(values)
        data = table.select(["instrument_id", "event_time"]).filter(pa.array(kept))
        for name in names:
            data = data.append_column(name, pa.array(out[name][0][kept], pa.float64()))
        # Spark has NaN above every number.
        return data.append_column("label", pa.array((~(excess[kept] <= 0)).astype(np.int32)))

    return derive


def evaluate_instruments(
    data: DataFrame, horizon: int, counted: DataFrame | None = None, folds: int = 3, embargo: int = 5,
    small: int = SMALL, derive=None, tables=None,
) -> DataFrame:
    """``evaluate_per_instrument`` of ``walk_forward`` of the dataset, without its rows once for each fold.

    An instrument of at most ``small`` rows goes to one task whole, which cuts the folds, fits and calibrates and
    sends out what it predicts; longer ones go by tables. ``counted`` has at least the rows of each instrument,
    where counting those of ``data`` would derive them twice. ``derive`` makes the dataset of an instrument's rows,
    ``tables`` that of a table, if ``data`` holds what it is made of.
    """
    c = F.col
    data = data.filter(c("instrument_id").isNotNull())
    sizes = (data if counted is None else counted).groupBy("instrument_id").agg(F.count("*").alias("_n"))
    large = cut_lineage(sizes.filter(c("_n") > small).select("instrument_id"))
    some_large = not large.isEmpty()
    data = cut_lineage(data) if some_large else data
    kinds, evaluate = {f.name: f.dataType for f in data.schema}, _evaluator(horizon, folds, embargo)

    def run(table: pa.Table) -> pa.Table:
        return evaluate(table if derive is None else derive(table))

    whole = (data.join(large, "instrument_id", "left_anti") if some_large else data).groupBy("instrument_id").applyInArrow(
        run,
        T.StructType([
            T.StructField("instrument_id", kinds["instrument_id"]), T.StructField("fold", T.IntegerType()),
            T.StructField("event_time", kinds["event_time"]), T.StructField("label", kinds.get("label", T.IntegerType())),
            *[T.StructField(x, T.DoubleType()) for x in ("p", "p_base")],
        ]),
    )
    if not some_large:
        return whole
    rest = data.join(large, "instrument_id", "left_semi")
    rest = walk_forward(rest if tables is None else cut_lineage(tables(rest)), ["instrument_id"], horizon, folds, embargo)
    return whole.unionByName(evaluate_per_instrument(cut_lineage(rest)))


def evaluate_bars(
    bars: DataFrame, benchmark: DataFrame, horizon: int, cost_bps: float = 8.0, delay_minutes: float = 30,
    small: int = SMALL,
) -> DataFrame:
    """``evaluate_instruments`` of ``supervised_dataset``: an instrument's dataset is made where it is evaluated."""
    return evaluate_instruments(
        _joined(bars, benchmark, delay_minutes), horizon, bars, small=small, derive=_derived(horizon, cost_bps),
        tables=lambda rows: _dataset(rows, horizon, cost_bps),
    )


def evaluate_pooled(assigned: DataFrame, fold: int) -> DataFrame:
    """One model over all instruments for a fold: distributed fit, then distributed calibration.

    The distributed loss is a mean, so the penalty is 1 / (C * rows).
    """
    data = assigned.filter(F.col("fold") == fold)
    fit = data.filter(F.col("role") == "fit")
    n = fit.count()
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="raw_features")
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    model = LogisticRegression(regParam=1.0 / (0.5 * max(n, 1)), standardization=False, maxIter=200)
    fitted = Pipeline(stages=[assembler, scaler, model]).fit(fit)
    score = vector_to_array(F.col("rawPrediction"))[1]

    def scored(role: str) -> DataFrame:
        part = fitted.transform(data.filter(F.col("role") == role))
        return part.select("instrument_id", "event_time", "label", "momentum_63",
                           score.alias("score"))

    calibration = scored("calibrate")
    m = calibration.count()
    lift = VectorAssembler(inputCols=["score"], outputCol="features")
    platt = LogisticRegression(regParam=1.0 / max(m, 1), standardization=False, maxIter=200).fit(
        lift.transform(calibration)
    )
    slope, shift = float(platt.coefficients[0]), float(platt.intercept)
    return scored("test").select(
        "instrument_id", F.lit(fold).alias("fold"), "event_time", "label",
        logistic(F.col("score") * slope + shift, 1.0).alias("p"),
        F.when(F.col("momentum_63") > 0, 0.58).otherwise(0.42).alias("p_base"),
    )


def brier(predictions: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    c = F.col
    return predictions.groupBy(*keys).agg(
        F.avg(F.pow(c("p") - c("label"), 2)).alias("brier_score"),
        F.avg(F.pow(c("p_base") - c("label"), 2)).alias("baseline_brier_score"),
        F.count("*").alias("samples"),
    )


def calibration_error(predictions: DataFrame, keys: list[str] | tuple = (), bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    c = F.col
    edge = F.least(F.floor(c("p") * bins), F.lit(bins - 1))
    # Multiplying can land on the wrong side of an edge such as 0.3; compare with the edge itself.
    edge = edge - F.when(c("p") < edge / bins, 1).otherwise(0)
    edge = edge + F.when((edge < bins - 1) & (c("p") >= (edge + 1) / bins), 1).otherwise(0)
    per_bin = predictions.groupBy(*keys, edge.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("label").alias("hit"), F.avg("p").alias("said")
    )
    return per_bin.groupBy(*keys).agg(
        (F.sum(c("n") * F.abs(c("hit") - c("said"))) / F.sum("n")).alias("calibration_error")
    )


def model_status(score, baseline):
    return F.when(score < baseline, "EXPERIMENTAL").otherwise("REJECTED")
