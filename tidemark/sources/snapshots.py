"""Immutable Parquet snapshots, their registry, and keyed appends with conflict detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.hashing import row_hash
from tidemark.operators.integrity import IntegrityError, fingerprint, tree_hash, verify_fingerprint
from tidemark.operators.ordered import Running, month, running
from tidemark.session import cut_lineage


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write once; the job committer publishes the folder only when every task has finished."""
    df.write.option("compression", "zstd").mode("errorifexists").parquet(path)


def read_snapshot(
    spark: SparkSession, path: str, schema: StructType | str,
    expected_hash: str | None = None, expected_rows: int | None = None,
) -> DataFrame:
    """Scan with a static schema; when registered values are given both must match the content."""
    if (expected_hash is None) != (expected_rows is None):
        raise IntegrityError("give both the expected hash and the expected row count, or neither")
    df = spark.read.schema(schema).option("mode", "FAILFAST").parquet(path)
    if expected_hash is not None:
        verify_fingerprint(df, expected_hash, expected_rows)
    return df


def snapshot_entry(df: DataFrame, dataset_type: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The registry row of a table: name from its hash, newest clocks, row count."""
    print_ = fingerprint(df, columns)
    clocks = df.agg(F.max("as_of").alias("as_of"), F.max("available_at").alias("available_at"))
    return print_.select(
        F.lit(dataset_type).alias("dataset_type"),
        F.concat_ws("-", F.lit(dataset_type.lower()), F.substring("sha256", 1, 16)).alias("name"),
        "sha256", F.col("rows").alias("row_count"),
        clocks.select("as_of").scalar().alias("as_of"),
        clocks.select("available_at").scalar().alias("available_at"),
    )


def register_snapshot(df: DataFrame, registry: DataFrame, dataset_type: str, folder: str) -> DataFrame:
    """Write the snapshot unless its content is already registered; return new registry rows."""
    entry = snapshot_entry(df, dataset_type)
    fresh = entry.join(registry.select("sha256"), "sha256", "left_anti")
    row = fresh.collect()  # at most one registry row
    if row:
        path = f"{folder.rstrip('/')}/{row[0]['name']}"
        write_snapshot(df, path)
        verify_fingerprint(
            df.sparkSession.read.schema(df.schema).parquet(path), row[0].sha256, row[0].row_count
        )
        return df.sparkSession.createDataFrame(row, fresh.schema).withColumn("uri", F.lit(path))
    return fresh.withColumn("uri", F.lit(None).cast("string"))


# ---------------------------------------------------------------- snapshots in parts

def part_manifest(df: DataFrame, part: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(part, row_count, sha256, as_of, available_at) of each part of a table, in one pass over it."""
    hashed = tree_hash(df, [part], row_hash(df, columns), "sha256").withColumnRenamed("items", "row_count")
    clocks = df.groupBy(part).agg(F.max("as_of").alias("as_of"), F.max("available_at").alias("available_at"))
    return hashed.join(clocks, part)


def snapshot_hash(manifest: DataFrame, part: str) -> DataFrame:
    """(rows, sha256) of a snapshot from the entries of its parts: the tree above them."""
    return fingerprint(manifest.select(part, "row_count", "sha256"))


def register_parts(
    df: DataFrame, manifest: DataFrame | None, part: str, folder: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Write the parts that ``manifest`` doesn't have yet and return their entries, read back and verified.

    Parts that are registered are neither hashed again nor written, only counted: one that is offered with another
    number of rows fails.
    """
    spark = df.sparkSession
    if manifest is not None:
        counts = df.groupBy(part).agg(F.count("*").alias("_n"))
        known = counts.join(manifest.select(part, "row_count"), part)
        wrong = known.filter(F.col("_n") != F.col("row_count"))
        if not wrong.isEmpty():
            raise IntegrityError("a registered part was offered with another number of rows")
        df = df.join(manifest.select(part), part, "left_anti")
    fresh = cut_lineage(df)
    entries = cut_lineage(part_manifest(fresh, part, columns))
    fresh.write.option("compression", "zstd").mode("append").partitionBy(part).parquet(folder)
    stored = spark.read.schema(fresh.schema).parquet(folder).join(entries.select(part), part, "left_semi")
    found = check_parts(stored, entries, part, columns).filter("status <> 'intact'")
    if not found.isEmpty():
        raise IntegrityError("a part reads back differently from what was written")
    # Written, as a plan that scans one folder twice, before and after a write, would take both for the same.
    return cut_lineage(entries.join(file_times(spark.read.schema(fresh.schema).parquet(folder), part), part))


def file_times(stored: DataFrame, part: str) -> DataFrame:
    """(part, stored_at): when a file of the part was last written, from the files' metadata alone."""
    return stored.groupBy(part).agg(F.max("_metadata.file_modification_time").alias("stored_at"))


def touched_parts(stored: DataFrame, manifest: DataFrame, part: str) -> DataFrame:
    """Parts with a file younger than their entry; only these need their rows hashed again."""
    return file_times(stored, part).withColumnRenamed("stored_at", "_now").join(manifest, part).filter(
        F.col("_now") > F.col("stored_at")
    ).select(part)


def check_parts(
    stored: DataFrame, manifest: DataFrame, part: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """(part, row_count, status): intact, changed, missing, or unregistered."""
    now = tree_hash(stored, [part], row_hash(stored, columns), "_sha").withColumnRenamed("items", "_rows")
    both = manifest.select(part, "row_count", "sha256").join(now, part, "full_outer")
    same = (F.col("_sha") == F.col("sha256")) & (F.col("_rows") == F.col("row_count"))
    status = (
        F.when(F.col("sha256").isNull(), "unregistered").when(F.col("_sha").isNull(), "missing")
        .when(same, "intact").otherwise("changed")
    )
    return both.select(part, F.coalesce("row_count", "_rows").alias("row_count"), status.alias("status"))


def insert_absent(existing: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates whose key is not stored yet; stored rows are never overwritten."""
    return candidates.join(existing.select(*keys), list(keys), "left_anti")


def classify_upsert(
    existing: DataFrame, candidates: DataFrame, keys: Sequence[str], digest: str = "record_hash"
) -> DataFrame:
    """Per key NEW, REPLAY (same content) or CONFLICT (other content, or copies that disagree)."""
    stored = existing.groupBy(*keys).agg(F.min(digest).alias("_s0"), F.max(digest).alias("_s1"))
    offered = candidates.groupBy(*keys).agg(
        F.min(digest).alias("_c0"), F.max(digest).alias("_c1"), F.count("*").alias("offered")
    )
    joined = offered.join(stored, list(keys), "left")
    same = (F.col("_c0") == F.col("_c1")) & (
        F.col("_s0").isNull() | ((F.col("_s0") == F.col("_s1")) & (F.col("_c0") == F.col("_s0")))
    )
    action = (
        F.when(~same, "CONFLICT").when(F.col("_s0").isNull(), "NEW").otherwise("REPLAY")
    )
    return joined.select(*keys, "offered", action.alias("action"))


def apply_upsert(
    existing: DataFrame, candidates: DataFrame, keys: Sequence[str], digest: str = "record_hash"
) -> DataFrame:
    """The stored rows and, once each, the new ones; a key offered with other content fails the job."""
    actions = classify_upsert(existing, candidates, keys, digest)
    clash = F.raise_error(F.lit("a stored key was offered with other content"))
    checked = actions.withColumn(
        "action", F.when(F.col("action") == "CONFLICT", clash).otherwise(F.col("action"))
    )
    fresh = checked.filter(F.col("action") == "NEW").select(*keys)
    return existing.unionByName(
        candidates.join(fresh, list(keys), "left_semi").dropDuplicates(list(keys))
    )


def supersede(versions: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Mark the newest version per key as current (slowly changing history).

    The newest order value comes from a combinable aggregate and is joined back, so a key with very
    many versions is neither sorted nor gathered in one place.
    """
    rank = F.struct(*order)
    top = versions.groupBy(*keys).agg(F.max(rank).alias("_top"))
    return versions.join(top, list(keys)).withColumn("is_current", rank == F.col("_top")).drop("_top")


def merge_versions(
    history: DataFrame, batch: DataFrame, keys: Sequence[str], revision: str, at: str,
    digest: str = "record_hash",
) -> DataFrame:
    """Rows of a version history that a batch changes or adds.

    ``history`` has the batch's columns with ``valid_from``, ``valid_to`` and ``is_current``. A revision that
    is stored already is a replay if its content is the same, and fails the job if not. New revisions follow
    the open row of their key in order of ``at`` and close what comes before them. Rows of other keys,
    and closed rows, aren't touched and aren't returned.
    """
    known = [*keys, revision]
    actions = classify_upsert(history, batch, known, digest)
    clash = F.raise_error(F.lit("a stored revision was offered with other content"))
    checked = actions.withColumn(
        "action", F.when(F.col("action") == "CONFLICT", clash).otherwise(F.col("action"))
    )
    fresh = batch.dropDuplicates(known).join(
        checked.filter(F.col("action") == "NEW").select(*known), known, "left_semi"
    ).withColumn("valid_from", F.col(at))
    touched = fresh.select(*keys).distinct()
    open_ = history.filter("is_current").join(touched, list(keys), "left_semi").drop("valid_to", "is_current")
    rows = cut_lineage(open_.unionByName(fresh))
    following = running(
        rows, keys, ["valid_from", revision], month("valid_from"),
        {"valid_to": Running("last", F.col("valid_from"), exclusive=True)}, reverse=True,
    )
    return following.withColumn("is_current", F.col("valid_to").isNull()).select(*history.columns)


def merge_stored(
    spark: SparkSession, folder: str, batch: DataFrame, keys: Sequence[str], revision: str, at: str,
    buckets: int = 64,
) -> None:
    """Merge a batch into the history at ``folder``, which is laid out by a hash of the key.

    Only buckets with keys of the batch are read and written again. A merge that broke off is finished by
    running it once more: what it had stored by then is a replay.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    schema = StructType([*batch.schema.fields]).add("valid_from", "timestamp").add("valid_to", "timestamp").add(
        "is_current", "boolean")
    offered = cut_lineage(batch.select("*", slot))
    mine = [r.bucket for r in offered.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    try:
        stored = spark.read.schema(StructType([*schema.fields]).add("bucket", "integer")).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], StructType([*schema.fields]).add("bucket", "integer"))
    stored = stored.filter(F.col("bucket").isin(mine)).drop("bucket")
    changed = cut_lineage(merge_versions(stored, offered.drop("bucket"), keys, revision, at))
    kept = stored.join(changed.select(*keys, revision), [*keys, revision], "left_anti")
    merged = cut_lineage(kept.unionByName(changed).select("*", slot))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def backfill_calendar(legacy: DataFrame) -> DataFrame:
    """Give old calendar rows a clock set, a derived revision and a review flag."""
    digest = F.sha2(F.concat(F.lit("legacy-scheduled-event:"), F.col("id").cast("string")), 256)
    announced = F.col("first_announced_at")
    return legacy.withColumns(
        {
            "event_time": F.col("scheduled_at"), "published_at": announced,
            "first_seen_at": announced, "available_at": announced, "as_of": announced,
            "ingested_at": F.col("created_at"),
            "revision": F.concat(F.lit("legacy-"), F.substring(digest, 1, 16)),
            "timezone": F.lit("UTC"), "latency_class": F.lit("LEGACY_MIGRATED"),
            "is_current": F.lit(True), "raw_payload_hash": digest,
            "quality_flags": F.array(F.lit("MIGRATED_LINEAGE_REVIEW_REQUIRED")),
        }
    )


def backfill_alerts(alerts: DataFrame, signals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Source type and provider of old alerts; what cannot be linked is marked unverified."""
    providers = signals.select("signal_id", "snapshot_id").join(
        snapshots.select("snapshot_id", F.col("provider_code").alias("_provider")), "snapshot_id",
        "left",
    ).select("signal_id", "_provider")
    has = F.col("signal_id").isNotNull()
    blank = F.coalesce(F.col("source_object_type"), F.lit("")) == ""
    kind = (
        F.when(has, "LegacyUnverifiedSignal")
        .when(F.col("alert_type") == "SYSTEM_HEALTH", "LegacyUnverifiedSystem")
        .otherwise("LegacyUnverified")
    )
    return alerts.join(providers, "signal_id", "left").withColumns(
        {
            "source_object_id": F.when(blank, F.col("signal_id")).otherwise(
                F.col("source_object_id")
            ),
            "source_object_type": F.when(blank, kind).otherwise(F.col("source_object_type")),
            "provider_code": F.coalesce("provider_code", F.when(has, F.col("_provider"))),
        }
    ).drop("_provider")


def backfill_signals(signals: DataFrame, default_recorded: Column) -> DataFrame:
    return signals.withColumns(
        {
            "recorded_at": F.coalesce("recorded_at", default_recorded),
            "is_current": F.coalesce("is_current", F.lit(True)),
        }
    )
