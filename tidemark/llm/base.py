"""What the operators share: input columns, packed batches and connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: ASCII white space; everything between is a word, whatever its script.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a Python task holds as words at a time.
STEP_BYTES = 2 << 20
LAST = (1 << 63) - 1


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Names a row by id and text, so that rows that share an id stay apart; nulls have a key."""
    return [
        F.coalesce(column(id_col).cast("long"), F.lit(LAST)).alias("k_id"),
        F.xxhash64(F.coalesce(column(text_col), F.lit(""))).alias("k_text"),
    ]


def steps(batch: pa.RecordBatch, name: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most about ``limit`` bytes of one string column."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def connected(edges: DataFrame, limit: int = 64) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``, root the smallest node it can reach.

    Large-star and small-star rounds: neighbourhoods shrink to stars by aggregates and joins, no
    component is gathered. The edge table of a round is written out; the count of changed edges is all
    that reaches the driver.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(limit):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").where("u <> v").distinct()
        after = cut_lineage(small)
        # Stars only when no node is both a leaf and a root and every leaf has one root.
        leaf = after.groupBy("u").agg(F.count("*").alias("n"))
        open_ = leaf.where("n > 1").limit(1).count() or after.select(F.col("v").alias("u")).join(leaf, "u", "left_semi").limit(1).count()
        now = after
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
