"""Fingerprints, record hashes, chained audit trails and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import NULL_MARK, escaped, row_hash

# Hex digits of the leaf groups and of the levels above; every step up has at most 256 children.
LEVELS = (6, 4, 2, 0)


class IntegrityError(RuntimeError):
    """Stored content and its recorded hash disagree."""


def tree_hash(df: DataFrame, group: Sequence[str], digest: Column, name: str) -> DataFrame:
    """Order-free hash of the digests of each group, with their count.

    Equal digests are counted first, so copies cost one entry; the distinct ones are combined in a
    tree keyed by digest prefix. A leaf holds about 1/16^6 of a group, every node above at most 256
    children, whatever the data look like.
    """
    counted = df.select(*group, digest.alias("key")).groupBy(*group, "key").agg(
        F.count("*").alias("n")
    )
    level = counted.select(
        *group, "key", "n", F.concat_ws("*", "key", F.col("n").cast("string")).alias("text")
    )
    for width in LEVELS:
        level = level.groupBy(*group, F.substring("key", 1, width).alias("key")).agg(
            F.sum("n").alias("n"),
            F.sha2(F.array_join(F.array_sort(F.collect_list("text")), ","), 256).alias("text"),
        )
    return level.select(*group, F.col("n").alias("items"), F.col("text").alias(name))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(rows, sha256) of a table, whatever the order of its rows."""
    return tree_hash(df, [], row_hash(df, columns), "sha256").select(
        F.col("items").alias("rows"), "sha256"
    )


def verify_fingerprint(df: DataFrame, expected_hash: str, expected_rows: int, columns=None) -> None:
    found = fingerprint(df, columns).collect()
    rows, digest = (found[0].rows, found[0].sha256) if found else (0, None)
    if rows != expected_rows:
        raise IntegrityError(f"{rows} rows, {expected_rows} registered")
    if digest != expected_hash:
        raise IntegrityError("content hash differs from the registered one")


def seal(df: DataFrame, columns: Sequence[str], name: str = "record_hash") -> DataFrame:
    """Hash of the immutable columns; delivery or acknowledgement state stays outside."""
    return df.withColumn(name, row_hash(df, columns))


def seal_mismatches(df: DataFrame, columns: Sequence[str], name: str = "record_hash") -> DataFrame:
    return df.filter(~F.col(name).eqNullSafe(row_hash(df, columns)))


def lineage_hash(df: DataFrame, group: Sequence[str], item: str, item_hash: str) -> DataFrame:
    """Hash of the (item, hash) pairs of each group."""
    pair = F.sha2(F.concat_ws("=", F.col(item).cast("string"), F.col(item_hash)), 256)
    return tree_hash(df, group, pair, "lineage_hash")


def policy_hash(
    snapshots: DataFrame, instruments: DataFrame, registry: DataFrame, settings: str,
    others: Sequence[str] = (),
) -> DataFrame:
    """Per provider: one hash over snapshot, instrument master, rights and settings.

    ``others`` names further snapshot columns (macro, news lineage, model, code version) to include.
    """
    master = tree_hash(
        instruments, ["provider"],
        row_hash(instruments, [c for c in instruments.columns if c not in ("provider", "name")]),
        "_master",
    )
    rights = registry.select(
        F.col("provider_code").alias("provider"), row_hash(registry).alias("_rights")
    )
    parts = ["sha256", "_master", "_rights", *others]
    joined = snapshots.join(master, "provider", "left").join(rights, "provider", "left")
    texts = [escaped(F.col(c)) for c in parts]
    return joined.select(
        "provider", F.sha2(F.concat_ws("\x1f", *texts, F.lit(settings)), 256).alias("policy_hash"),
        F.col("items").alias("instruments"),
    )


def policy_changes(stored: DataFrame, current: DataFrame, key: str = "provider") -> DataFrame:
    """Stored decisions whose policy hash is no longer the one recomputed now."""
    now = current.select(key, F.col("policy_hash").alias("_now"))
    return stored.join(now, key, "left").filter(
        ~F.col("policy_hash").eqNullSafe(F.col("_now"))
    ).drop("_now")


def differences(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Rows only on one side; an empty result means the replay reproduced the stored table."""
    columns = stored.columns
    left = stored.exceptAll(replayed.select(*columns)).withColumn("side", F.lit("stored"))
    right = replayed.select(*columns).exceptAll(stored).withColumn("side", F.lit("replayed"))
    return left.unionByName(right)


def metric_differences(
    stored: DataFrame, replayed: DataFrame, keys: Sequence[str], values: Sequence[str],
    tolerance: float = 1e-12,
) -> DataFrame:
    joined = stored.join(
        replayed.select(*keys, *[F.col(v).alias(f"_{v}") for v in values]), list(keys), "full_outer"
    )
    off = None
    for v in values:
        test = ~F.coalesce(F.abs(F.col(v) - F.col(f"_{v}")) <= tolerance, F.lit(False))
        off = test if off is None else off | test
    return joined.filter(off)


# ------------------------------------------------------------------ audit chain

AUDIT_FIELDS = ("event_type", "object_type", "object_id", "actor", "trace_id", "details")


def _payload(previous: Column) -> Column:
    fields = [escaped(F.col(c)) for c in AUDIT_FIELDS]
    return F.concat_ws("\x1f", *fields, F.coalesce(previous, F.lit(NULL_MARK)))


def _link(frame: pd.DataFrame) -> pd.DataFrame:
    """Hash each record together with the hash of the one before it."""
    frame = frame.sort_values("sequence")
    hashes, before, last = [], [], None
    for body in frame["body"]:
        before.append(last)
        last = hashlib.sha256(f"{body}\x1f{last or NULL_MARK}".encode()).hexdigest()
        hashes.append(last)
    return pd.DataFrame(
        {"chain": frame["chain"].to_numpy(), "sequence": frame["sequence"].to_numpy(),
         "previous_hash": before, "record_hash": hashes}
    )


def chain_records(df: DataFrame) -> DataFrame:
    """Append hashes to new audit records, one chain per batch.

    ``chain`` names an append batch. A batch is bounded by its writer (at most a thousand records),
    which is what makes the inherently sequential step safe to run per group.
    """
    fields = [escaped(F.col(c)) for c in AUDIT_FIELDS]
    slim = df.select("chain", "sequence", F.concat_ws("\x1f", *fields).alias("body"))
    linked = slim.groupBy("chain").applyInPandas(
        _link, "chain bigint, sequence bigint, previous_hash string, record_hash string"
    )
    return df.join(linked, ["chain", "sequence"])


def chain_violations(df: DataFrame) -> DataFrame:
    """(chain, kind, violations): edited payloads, copies, forks, orphans, and roots or heads != 1.

    Joins and counts only; the chain is never walked. With intact payload hashes a cycle is
    impossible, so one root, one head and no fork or orphan mean everything is reachable.
    """
    c = F.col
    edited = df.filter(c("record_hash") != F.sha2(_payload(c("previous_hash")), 256)).groupBy(
        "chain").agg(F.count("*").alias("violations")).withColumn("kind", F.lit("payload"))
    copies = (
        df.groupBy("chain", "record_hash").agg((F.count("*") - 1).alias("n")).filter("n > 0")
        .groupBy("chain").agg(F.sum("n").alias("violations")).withColumn("kind", F.lit("duplicate"))
    )
    fork = (
        df.filter(c("previous_hash").isNotNull()).groupBy("chain", "previous_hash")
        .agg((F.count("*") - 1).alias("n")).filter("n > 0")
        .groupBy("chain").agg(F.sum("n").alias("violations")).withColumn("kind", F.lit("fork"))
    )
    known = df.select("chain", c("record_hash").alias("previous_hash")).distinct()
    orphan = (
        df.filter(c("previous_hash").isNotNull())
        .join(known, ["chain", "previous_hash"], "left_anti")
        .groupBy("chain").agg(F.count("*").alias("violations")).withColumn("kind", F.lit("orphan"))
    )
    roots = df.groupBy("chain").agg(F.count_if(c("previous_hash").isNull()).alias("violations"))
    heads = df.select("chain").distinct().join(
        chain_heads(df).groupBy("chain").agg(F.count("*").alias("violations")), "chain", "left"
    ).na.fill(0, ["violations"])
    ends = roots.withColumn("kind", F.lit("root")).unionByName(
        heads.withColumn("kind", F.lit("head"))
    ).filter("violations <> 1")
    report = edited
    for part in (copies, fork, orphan, ends):
        report = report.unionByName(part)
    return report.select("chain", "kind", "violations")


def chain_heads(df: DataFrame) -> DataFrame:
    """Records whose hash is nobody's predecessor; more than one per chain means a fork."""
    used = df.select("chain", F.col("previous_hash").alias("record_hash")).filter(
        F.col("record_hash").isNotNull()
    )
    return df.join(used, ["chain", "record_hash"], "left_anti")


def missing_audits(objects: DataFrame, audits: DataFrame, key: str, digest: str) -> DataFrame:
    """Objects without exactly one agreeing audit record, and audits that point nowhere."""
    counts = audits.groupBy(key).agg(
        F.count("*").alias("_n"), F.max("audit_hash").alias("_h"), F.min("audit_hash").alias("_l")
    )
    joined = objects.select(key, F.col(digest).alias("_own")).join(counts, key, "full_outer")
    kind = (
        F.when(F.col("_own").isNull(), "dangling_audit")
        .when(F.col("_n").isNull(), "missing_audit")
        .when(F.col("_n") != 1, "repeated_audit")
        .when((F.col("_h") != F.col("_own")) | (F.col("_l") != F.col("_own")), "hash_differs")
    )
    return joined.select(key, kind.alias("kind")).filter(F.col("kind").isNotNull())
