"""Governance at a time: which versions held, what they hash to, which check fails first.

Tables of versions carry ``valid_from`` and ``valid_to`` (NULL while it lasts). What a decision rested on is
looked up at the decision's own time, and again at a later one; nothing is recomputed per decision.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import SEPARATOR, escaped, row_hash
from tidemark.operators import gates
from tidemark.operators.integrity import tree_hash
from tidemark.operators.ordered import Running, asof, month, running
from tidemark.session import cut_lineage

#: A row hash is summed in four limbs of 15 hex digits; decimals hold the sums of 10**18 rows.
LIMBS = 4
DIGITS = 15


# ---------------------------------------------------------------- versions

def version_at(
    rows: DataFrame, versions: DataFrame, keys: dict[str, str], at: str, name: str
) -> DataFrame:
    """Add the version of its key that holds at the row's own time as a struct, NULL if none does.

    ``keys`` maps columns of the rows to columns of the versions. Versions of a key don't overlap.
    """
    held = versions.select(
        *[F.col(v).alias(f"_key_{v}") for v in keys.values()],
        F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"),
        F.struct(*[c for c in versions.columns if c not in ("valid_from", "valid_to")]).alias(name),
    )
    same = (F.col("_from") <= F.col(at)) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    for mine, theirs in keys.items():
        same = same & (F.col(mine) == F.col(f"_key_{theirs}"))
    return rows.join(held, same, "left").drop(
        "_from", "_to", *[f"_key_{v}" for v in keys.values()]
    )


def digest_history(versions: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, since, digest): the hash of all rows of a key that hold, for each time it changes.

    Row hashes are added where a version begins and taken away where it ends, and the sums run along
    time; so a key with many versions costs one row a change, not one set of rows a change, and the
    scan splits inside a key.
    """
    hashed = versions.withColumn("_h", row_hash(versions, columns))
    limbs = [
        F.conv(F.substring("_h", 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(20,0)")
        for i in range(LIMBS)
    ]
    begin = hashed.select(
        *keys, F.col("valid_from").alias("since"), F.lit(1).cast("bigint").alias("_n"),
        *[x.alias(f"_s{i}") for i, x in enumerate(limbs)],
    )
    end = hashed.filter(F.col("valid_to").isNotNull()).select(
        *keys, F.col("valid_to").alias("since"), F.lit(-1).cast("bigint").alias("_n"),
        *[(-x).alias(f"_s{i}") for i, x in enumerate(limbs)],
    )
    sums = ["_n", *[f"_s{i}" for i in range(LIMBS)]]
    moves = begin.unionByName(end).groupBy(*keys, "since").agg(*[F.sum(s).alias(s) for s in sums])
    held = running(
        cut_lineage(moves), keys, ["since"], month("since"),
        {s: Running("sum", F.col(s)) for s in sums},
    )
    text = F.concat_ws(":", *[F.col(s).cast("decimal(38,0)").cast("string") for s in sums])
    return held.select(*keys, "since", F.sha2(text, 256).alias("digest"))


def digest_at(
    rows: DataFrame, history: DataFrame, keys: dict[str, str], at: dict[str, str],
    stored: DataFrame | None = None,
) -> DataFrame:
    """Add the digests of the row's key at its own times; ``at`` maps columns of time to new names.

    Each key and time that occurs is looked up once, by one as-of join for all of the columns. They are
    read from ``stored``, the rows as they were written, so that what was joined to the rows since isn't joined again.
    """
    stored = rows if stored is None else stored
    mine = [f"_k{i}" for i in range(len(keys))]
    needs = None
    for column in at:
        part = stored.select(*[F.col(k).alias(n) for k, n in zip(keys, mine)], F.col(column).alias("_at"))
        needs = part if needs is None else needs.union(part)
    named = history.select(
        *[F.col(v).alias(n) for v, n in zip(keys.values(), mine)], F.col("since").alias("_since"),
        F.col("digest").alias("_digest"),
    )
    found = cut_lineage(asof(cut_lineage(needs.dropna().distinct()), named, mine, "_at", "_since", ["_digest"]))
    for column, name in at.items():
        same = F.col(column) == F.col("_at")
        for k, n in zip(keys, mine):
            same = same & (F.col(k) == F.col(n))
        rows = rows.join(found.withColumnRenamed("_digest", name), same, "left").drop("_at", *mine)
    return rows


def policy_text(parts: Sequence[Column]) -> Column:
    """Hash of the parts a decision rests on; a missing part counts as such."""
    return F.sha2(F.concat_ws(SEPARATOR, *[escaped(p) for p in parts]), 256)


# ---------------------------------------------------------------- checks in order

@dataclass(frozen=True)
class Check:
    """A condition that must not hold. It counts only where the checks it ``needs`` have passed.

    A condition that is NULL counts as failing.
    """

    name: str
    failed: Column
    reason: Column | None = None
    needs: tuple[str, ...] = ()


def failures(checks: Sequence[Check]) -> Column:
    """Array of (priority, reason) of the failing checks, in the order given."""
    passed: dict[str, Column] = {}
    out = []
    for i, check in enumerate(checks):
        failed = F.coalesce(check.failed, F.lit(True))
        ready = F.lit(True)
        for name in check.needs:
            ready = ready & passed[name]
        passed[check.name] = ready & ~failed
        reason = F.lit(check.name) if check.reason is None else check.reason
        out.append((ready & failed, F.struct(F.lit(i).alias("priority"), reason.alias("reason"))))
    return gates.listed(*out, kind="struct<priority:int,reason:string>")


def first_reasons(
    keys: DataFrame, key: str, levels: Sequence[tuple[DataFrame, str | None, Sequence[Check]]]
) -> DataFrame:
    """Per key of ``keys``: the first reason, the level it is found at, and the rows failing there.

    A level is a table of rows of the key, the column that orders them, and their checks. A level
    counts only for keys that fail no check of a level before it. Every level is one aggregate.
    """
    found = None
    for number, (rows, item, checks) in enumerate(levels):
        order = F.col(item) if item else F.lit(0)
        failed = rows.select(
            key, order.cast("string").alias("_item"), order.alias("_order"),
            failures(checks).alias("_f"),
        ).filter(F.size("_f") > 0)
        first = failed.groupBy(key).agg(
            F.min(F.struct("_order", F.col("_f")[0]["priority"].alias("p"))).alias("_first"),
            F.min_by(F.struct(F.col("_f")[0]["reason"].alias("reason"), F.col("_item").alias("item")),
                     F.struct("_order", F.col("_f")[0]["priority"])).alias("_r"),
            F.count("*").alias("_n"),
        ).select(key, F.lit(number).alias("_level"), F.struct(
            "_r.reason", "_r.item", F.col("_n").alias("failing")).alias("_what"))
        found = first if found is None else found.unionByName(first)
    top = found.groupBy(key).agg(
        F.min("_level").alias("level"), F.min_by("_what", "_level").alias("_what")
    )
    return keys.select(key).join(top, key, "left").select(
        key, "level", F.col("_what.reason").alias("reason"), F.col("_what.item").alias("item"),
        F.coalesce("_what.failing", F.lit(0)).cast("bigint").alias("failing"),
    )


# ---------------------------------------------------------------- what the checks look at

def verified_contents(snapshots: DataFrame, contents: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Registered snapshots with ``intact``: the rows they hold now give the registered hash and count.

    All snapshots are hashed in one pass over their rows.
    """
    now = tree_hash(contents, ["snapshot_id"], row_hash(contents, columns), "_sha")
    joined = snapshots.join(now.withColumnRenamed("items", "held_rows"), "snapshot_id", "left")
    held = F.coalesce("held_rows", F.lit(0)).cast("bigint")
    intact = (held == F.col("row_count")) & F.col("sha256").eqNullSafe(F.col("_sha"))
    return joined.withColumns({"held_rows": held, "intact": intact}).drop("_sha")


def execution_reasons(purposes: set[str], at: Column) -> Column:
    """Why a candidate may not be executed, from the versions joined to it.

    Looks at the signal's own columns and the structs ``snapshot``, ``instrument``, ``model`` and
    ``rights``.
    """
    c = F.col
    snapshot, instrument, model = c("snapshot"), c("instrument"), c("model")
    listed = gates.license_reasons(
        c("rights"), at, purposes, instrument["mic"], instrument["region"], prefix="LICENSE_"
    )
    no_instrument = instrument.isNull()
    return F.concat(
        gates.reasons(
            ("SIGNAL_NOT_INTACT", ~c("intact")),
            ("SIGNAL_NOT_CURRENT", ~c("is_current")),
            ("SIGNAL_STATE_CHANGED", c("state") != "ENTRY_CANDIDATE"),
            ("SIGNAL_NOT_ON_TIME", c("latency_status") != "ON_TIME"),
            ("SNAPSHOT_MISSING", snapshot.isNull()),
            ("SNAPSHOT_TYPE_INVALID", snapshot.isNotNull() & ~snapshot["dataset_type"].eqNullSafe("MARKET_BARS")),
            ("SNAPSHOT_MODE_MISMATCH", snapshot.isNotNull() & ~snapshot["data_mode"].eqNullSafe(c("data_mode"))),
            ("LICENSE_SCOPE_UNCLEAR", snapshot.isNotNull() & gates.unclear(snapshot["license_scope"])),
            ("INSTRUMENT_MASTER_MISSING", no_instrument),
            ("INSTRUMENT_NOT_TRADABLE", ~no_instrument & ~gates.tradable_instrument(instrument)),
        ),
        gates.model_rules(c("data_mode"), model),
        F.when(snapshot.isNull(), F.array().cast("array<string>")).otherwise(listed),
    )


def changes(parts: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the parts whose digest then isn't the one now."""
    return gates.listed(*[(~then.eqNullSafe(now), F.lit(name)) for name, (then, now) in parts.items()])
