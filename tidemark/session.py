"""Session settings the library relies on; safe to apply to a session someone else built."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the clock zone to UTC, let the runtime re-plan skewed or tiny shuffles and keep generated code small.

    The JVM never compiles a method above 8000 bytes; beyond that Spark had better generate many small ones.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def stage_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names one, else a temporary folder for tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):  # one process, so any folder is shared
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and continue from the files.

    The plan runs once, its branches read columns they need, and a lost executor costs nothing but
    its own tasks.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
