"""Time-driven alert and schedule rules on batches: windows, cooldown, delivery, run logs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clocks import cutoff, minutes
from tidemark.operators.ordered import Running, running
from tidemark.session import cut_lineage

HOURS = (1, 2)


def window_key(time: str, hours: int) -> Column:
    """Start of the 1 h or 2 h window (UTC) a time falls into; other lengths are rejected."""
    if hours not in HOURS:
        raise ValueError("only windows of 1 or 2 hours")
    return F.window(time, f"{hours} hours")["start"]


def run_key(time: str, hours: int) -> Column:
    start = F.date_format(window_key(time, hours), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat_ws(":", F.lit("monitor"), F.lit(str(hours)), start)


def once_per_window(attempts: DataFrame, time: str, ok: str, hours: int) -> DataFrame:
    """Outcome per window: the first success counts, later attempts are replays."""
    keyed = attempts.withColumn("run_key", run_key(time, hours))
    won = F.min(F.when(F.col(ok), F.col(time)))
    return keyed.groupBy("run_key").agg(
        F.when(won.isNotNull(), "SUCCEEDED").otherwise("FAILED").alias("status"),
        won.alias("completed_at"),
        F.count("*").alias("attempts"),
    )


def schedule_state(
    runs: DataFrame, keys: list[str], now: Column, hours: int, roster: DataFrame | None = None
) -> DataFrame:
    """NOT_RUN, FAILED, OVERDUE or CURRENT from the latest run of each task.

    ``roster`` names the tasks that should run; without it only tasks that ran are known.
    """
    last = runs.groupBy(*keys).agg(
        F.max_by(F.struct("status", "completed_at"), F.struct("started_at", "run_id")).alias("_l")
    )
    if roster is not None:
        last = roster.select(*keys).distinct().join(last, keys, "left")
    done = F.col("_l.completed_at")
    state = (
        F.when(F.col("_l").isNull(), "NOT_RUN")
        .when((F.col("_l.status") != "SUCCEEDED") | done.isNull(), "FAILED")
        .when(done < now - minutes(hours * 60 + 5), "OVERDUE")
        .otherwise("CURRENT")
    )
    return last.select(*keys, state.alias("schedule_state"))


def failure_episodes(runs: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Consecutive failures share the key of the first one; a success ends the episode."""
    c = F.col
    failed = c("status") == "FAILED"
    order = [*["started_at"], "run_id"]
    marked = running(
        runs, keys, order, bucket,
        {"_ok": Running("last", F.when(~failed, F.struct(*order)), True)},
    )
    episode = marked.filter(failed)
    first = episode.groupBy(*keys, "_ok").agg(F.min(F.struct(*order)).alias("_first"))
    # Joined on whether and after which success: failures before any success form one episode too.
    after = lambda df: df.withColumns(
        {"_m0": c("_ok").isNotNull(), "_m1": F.coalesce(c("_ok.started_at"), F.to_timestamp(F.lit("1970-01-01")).cast(kind)),
         "_m2": F.coalesce(c("_ok.run_id"), F.lit(0).cast(number))}
    )
    kind, number = (runs.schema[n].dataType for n in ("started_at", "run_id"))
    right = after(first).select(*keys, "_m0", "_m1", "_m2", c("_first.run_id").alias("episode"))
    return after(episode).join(right, [*keys, "_m0", "_m1", "_m2"]).drop("_m0", "_m1", "_m2", "_ok")


def expire_leases(runs: DataFrame, now: Column, lease_seconds: int = 720) -> DataFrame:
    """RUNNING longer than the lease becomes FAILED and may be retried."""
    late = (F.col("status") == "RUNNING") & (
        now - F.col("started_at") > F.expr(f"make_dt_interval(0, 0, 0, {lease_seconds})")
    )
    stored = F.col("error_code") if "error_code" in runs.columns else F.lit(None).cast("string")
    return runs.withColumns(
        {
            "error_code": F.when(late, "TASK_LEASE_EXPIRED").otherwise(stored),
            "status": F.when(late, "FAILED").otherwise(F.col("status")),
        }
    )


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """First acknowledgement of each intact alert; repeats change nothing."""
    first = acks.groupBy("alert_id").agg(
        F.min("acked_at").alias("_at"),
        F.min_by("actor", F.struct("acked_at", "actor")).alias("_by"),
    )
    joined = alerts.join(first, "alert_id", "left")
    kept = lambda c, kind: (
        F.col(c) if c in alerts.columns else F.lit(None).cast(kind)
    )
    at = kept("acknowledged_at", first.schema["_at"].dataType)
    by = kept("acknowledged_by", first.schema["_by"].dataType)
    # What is stored came first, whatever is offered again.
    taken = F.col("content_ok") & F.col("_at").isNotNull() & at.isNull()
    return joined.withColumns(
        {
            "status": F.when(taken, "ACKNOWLEDGED").otherwise(F.col("status")),
            "acknowledged_by": F.when(taken, F.col("_by")).otherwise(by),
            "acknowledged_at": F.when(taken, F.col("_at")).otherwise(at),
        }
    ).drop("_at", "_by")


def local_day(time: str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(time, zone))


def in_quiet_hours(time: str, limits) -> Column:
    hour = F.hour(F.from_utc_timestamp(time, limits.alert_zone))
    a, b = limits.quiet_start, limits.quiet_end
    if a == b:
        return F.lit(False)
    return (hour >= a) & (hour < b) if a < b else (hour >= a) | (hour < b)


def sent_today(alerts: DataFrame, now: datetime, limits) -> DataFrame:
    """Deliveries since the start of the local day, per channel; acknowledging does not reset it."""
    start = F.to_utc_timestamp(
        F.date_trunc("day", F.from_utc_timestamp(cutoff(now, "utc"), limits.alert_zone)),
        limits.alert_zone,
    )
    return alerts.filter(F.col("sent_at") >= start).groupBy("channel").agg(
        F.count("*").alias("sent_today")
    )


OUTCOME_SCHEMA = "channel string, alert_id bigint, created_at timestamp, outcome string"
_OUTCOME_COLUMNS = ["channel", "alert_id", "created_at", "outcome"]


def decide(last: int | None, at: int, cooldown: int, full: bool, quiet: bool) -> str:
    """Outcome of an alert whose subject was last raised at ``last``, on a day whose cap is used up or not."""
    if cooldown and last is not None and last >= at - cooldown:
        return "COOLDOWN"
    if full:
        return "SUPPRESSED"  # does not start a cooldown
    return "PENDING" if quiet else "SENT"


def alert_rows(alerts: DataFrame, limits) -> DataFrame:
    """Channel, subject, local day and quiet hours of alerts."""
    return alerts.select(
        "channel", F.col("alert_id").cast("bigint").alias("alert_id"), F.unix_micros("created_at").alias("at"),
        F.concat_ws("|", "alert_type", F.col("instrument_id").cast("string")).alias("subject"),
        F.unix_date(local_day("created_at", limits.alert_zone)).alias("day"),
        in_quiet_hours("created_at", limits).alias("quiet"),
    )


FOLD = "channel string, subject string, day int, alert_id bigint, at bigint, outcome string, last bigint"


def _fold_subjects(cooldown: int):
    """Stream rows ordered by (channel, subject, day, kind, at, alert_id); the state is one time.

    A row of kind 0 opens the day of a subject with the time it was last raised before. A day ends with
    a row that holds the time it leaves. Times are microseconds.
    """
    names = [f.split()[0] for f in FOLD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = last = None

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            out = []
            for channel, subject, day, kind, at, alert_id, quiet, cut_at, cut_id in zip(*[c.to_pylist() for c in batch.columns]):
                if (channel, subject, day) != current:
                    if last is not None:
                        out.append((*current, None, None, None, last))
                    current, last = (channel, subject, day), None
                if kind == 0:
                    last = at
                    continue
                full = cut_at is not None and (at, alert_id) > (cut_at, cut_id)
                outcome = decide(last, at, cooldown, full, quiet)
                if outcome in ("PENDING", "SENT"):
                    last = at
                out.append((*current, alert_id, at, outcome, None))
            yield batch_of(out)
        if last is not None:
            yield batch_of([(*current, None, None, None, last)])

    return fold


def deliver(alerts: DataFrame, limits) -> DataFrame:
    """Outcome of every alert: COOLDOWN, SUPPRESSED (daily cap), PENDING (quiet hours) or SENT.

    ``alerts`` carries channel, alert_id, created_at, alert_type and instrument_id. The day's cap
    comes first, then quiet hours, and a suppressed alert starts no cooldown.

    Alerts depend on each other in two ways only: a channel's day has one alert after which its cap is used
    up, and a subject's day begins with the time it was last raised. Both are small tables. Given them, every
    day of every subject is decided on its own, in time order, with one time as state, so a busy channel spreads
    over its subjects and a busy subject over its days. Passes repeat with what the last one found until neither
    table changes. That gives the outcomes of one ordered pass: the first day depends on nothing
    before it, a cut-off that came too late or too early is found out once the days before are right, and
    days further on settle alongside unless they truly hang together.
    """
    cooldown = limits.cooldown_minutes * 60_000_000
    limit, c = limits.daily_limit, F.col
    rows = cut_lineage(alert_rows(alerts, limits))
    # One row for each subject and day with alerts: its next day takes over what it leaves.
    order = Window.partitionBy("channel", "subject").orderBy("day")
    days = rows.groupBy("channel", "subject", "day").agg(F.min("at").alias("_begin"))
    days = cut_lineage(days.select(
        "channel", "subject", "day", F.lead("day").over(order).alias("_next"), F.lead("_begin").over(order).alias("_begin")
    ).filter("_next is not null"))
    sent_order = Window.partitionBy("channel", "day").orderBy("at", "alert_id")
    none = F.lit(None).cast("bigint")
    cuts = carried = None
    while True:
        opened = rows.withColumn("kind", F.lit(1))
        if cuts is None:
            opened = opened.withColumns({"cut_at": none, "cut_id": none})
        else:
            opened = opened.join(cuts, ["channel", "day"], "left").unionByName(
                carried.withColumn("kind", F.lit(0)), allowMissingColumns=True
            )
        key = ["channel", "subject", "day"]
        ordered = opened.select(*key, "kind", "at", "alert_id", "quiet", "cut_at", "cut_id").repartition(
            *key).sortWithinPartitions(*key, "kind", "at", "alert_id")
        result = cut_lineage(ordered.mapInArrow(_fold_subjects(cooldown), FOLD))
        # Both tables are read for the comparison and by the next pass, so they are written.
        sent = result.filter("outcome = 'SENT'").withColumn("_n", F.row_number().over(sent_order))
        now_cuts = cut_lineage(sent.filter(c("_n") == limit).select(
            "channel", "day", c("at").alias("cut_at"), c("alert_id").alias("cut_id")
        ))
        now_carried = cut_lineage(
            result.filter("last is not null").join(days, key).filter(c("last") >= c("_begin") - cooldown)
            .select("channel", "subject", c("_next").alias("day"), c("last").alias("at"))
        )
        same = cuts is not None and all(
            a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
            for a, b in ((cuts, now_cuts), (carried, now_carried))
        )
        cuts, carried = now_cuts, now_carried
        if same:
            done = result.filter(c("outcome").isNotNull())
            return done.withColumn("created_at", F.timestamp_micros("at")).select(*_OUTCOME_COLUMNS)
