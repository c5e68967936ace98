"""Version histories, and errors on content that changed under a stored key."""

import os
import tempfile
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest
from tidemark.operators.integrity import IntegrityError
from tidemark.sources.snapshots import apply_upsert, check_parts, merge_stored, register_parts, snapshot_hash, touched_parts

D = lambda n: datetime(2024, 1, n)
ROW = "provider string, code int, revision string, at timestamp, record_hash string"


@pytest.fixture
def merged(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/history"

    def merge(*rows):
        merge_stored(spark, folder, spark.createDataFrame(rows, ROW), ["provider", "code"], "revision", "at", 8)
        out = spark.read.parquet(folder).orderBy("code", "valid_from", "revision").collect()
        return [(r.code, r.revision, r.valid_from.day, r.valid_to and r.valid_to.day, r.is_current) for r in out]

    return folder, merge


def test_new_revisions_close_the_open_one(merged):
    folder, merge = merged
    assert merge(("p", 1, "a", D(1), "x"), ("p", 2, "a", D(1), "y")) == [(1, "a", 1, None, True), (2, "a", 1, None, True)]
    files = {f for f in os.listdir(folder) if f.startswith("bucket")}
    before = {f: os.listdir(f"{folder}/{f}") for f in files}
    # A replay, and two revisions of one key at once, one of them offered twice.
    got = merge(("p", 1, "a", D(9), "x"), ("p", 1, "c", D(4), "z"), ("p", 1, "b", D(3), "z"), ("p", 1, "b", D(3), "z"))
    assert got == [(1, "a", 1, 3, False), (1, "b", 3, 4, False), (1, "c", 4, None, True), (2, "a", 1, None, True)]
    after = {f: os.listdir(f"{folder}/{f}") for f in files}
    assert sum(before[f] != after[f] for f in files) <= 1  # only the bucket of the key that changed
    assert merge(("p", 1, "c", D(4), "z")) == got


def test_changed_content_under_a_revision_fails_and_leaves_the_history(spark, merged):
    folder, merge = merged
    first = merge(("p", 1, "a", D(1), "x"))
    with pytest.raises(Exception, match="other content"):
        merge(("p", 1, "a", D(2), "changed"), ("p", 1, "b", D(2), "x"))
    with pytest.raises(Exception, match="other content"):
        merge(("p", 3, "a", D(2), "x"), ("p", 3, "a", D(2), "y"))
    assert merge(("p", 1, "a", D(1), "x")) == first


def test_an_upsert_with_other_content_fails(spark):
    stored = spark.createDataFrame([("k", "x")], "k string, record_hash string")
    offered = spark.createDataFrame([("k", "y")], "k string, record_hash string")
    with pytest.raises(Exception, match="other content"):
        apply_upsert(stored, offered, ["k"]).collect()


def test_two_bars_of_one_instrument_at_one_time_fail(spark):
    row = spark.range(1).select(
        F.lit(1).alias("instrument_id"), *[F.lit(D(2)).alias(c) for c in
        ("event_time", "published_at", "first_seen_at", "available_at", "as_of")], F.lit(1.0).alias("total_return_close"))
    with pytest.raises(ValueError, match="two bars"):
        backtest.prepare(row.union(row))


def test_only_new_parts_are_registered_and_only_touched_ones_checked(spark):
    folder = tempfile.mkdtemp(prefix="spark-") + "/parts"
    rows = spark.range(60).select(
        "id", (F.col("id") % 3).cast("int").alias("part"), F.lit(D(1)).alias("as_of"), F.lit(D(2)).alias("available_at"))
    first = register_parts(rows.filter("part < 2"), None, "part", folder, ["id"])
    assert sorted((r.part, r.row_count) for r in first.collect()) == [(0, 20), (1, 20)]
    second = register_parts(rows, first, "part", folder, ["id"])
    assert [r.part for r in second.collect()] == [2]
    manifest = first.unionByName(second)
    assert register_parts(rows, manifest, "part", folder, ["id"]).count() == 0
    assert snapshot_hash(manifest, "part").first() == snapshot_hash(manifest.orderBy(F.desc("part")), "part").first()
    with pytest.raises(IntegrityError, match="number of rows"):
        register_parts(rows.filter("id > 0"), manifest, "part", folder, ["id"])
    schema = spark.read.parquet(folder).schema
    stored = lambda: spark.read.schema(schema).parquet(folder)
    assert touched_parts(stored(), manifest, "part").count() == 0
    time.sleep(1.1)
    moved = spark.createDataFrame(stored().filter("part = 1").collect(), schema).withColumn("id", F.col("id") + F.when(F.col("id") == 4, 1).otherwise(0))
    moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
    assert [r.part for r in touched_parts(stored(), manifest, "part").collect()] == [1]
    extra = stored().filter("part > 0").unionByName(rows.limit(1).withColumn("part", F.lit(9)).select(schema.names))
    assert {r.part: r.status for r in check_parts(extra, manifest, "part", ["id"]).collect()} == {
        0: "missing", 1: "changed", 2: "intact", 9: "unregistered"}
