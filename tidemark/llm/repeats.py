"""Repeated keys without gathering a key: rows are dealt by range of (key, order), sorted, and streamed.

A key that holds a third of all rows spreads over many tasks, since the order columns split it. Only the
first and last key of a task can reach into a neighbour; each task reports its last key in one row, and
the few rows in doubt are settled by a join with those reports. No row is dropped, no group is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pandas.core.util.hashing import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

ODD = 0x9E3779B97F4A7C15
ODD2 = 0xD6E8FEB86659FD93
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A second, independent-looking value of 64-bit hashes (a finaliser of splitmix type)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return hash_array(flat, categorize=False) if len(words) else np.zeros(0, U64)


class Windows:
    """Hashes of runs of consecutive symbols, from sums of ``symbol * odd**position`` modulo 2**64."""

    def __init__(self, symbols: np.ndarray, odd: int = ODD):
        n = len(symbols)
        self.back = _powers(pow(odd, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * _powers(odd, n + 1)[:n], dtype=U64, out=self.sums[1:])

    def at(self, start: np.ndarray | slice, length: int) -> np.ndarray:
        if isinstance(start, slice):  # places in a row: no gathering
            a, b = start.start, start.stop
            return mixed((self.sums[a + length : b + length] - self.sums[a:b]) * self.back[a:b])
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, U64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if len(table) <= 1 << 21:
            _TABLES[base] = table
    return table[:n]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _runs(change: np.ndarray) -> np.ndarray:
    """Index of the first row of each row's run; -1 where the run began before."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), -1))


def shared(rows: DataFrame) -> DataFrame:
    """(doc, pos) of rows (key, doc, pos) whose key stands in two or more docs, each once.

    A superset by a few rows: keys at the edge of a task are kept without looking further.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None  # a key whose rows pass: it has two docs, or it is the first of the task
        held = [np.zeros(0, np.int64)] * 3  # rows of the last key so far, all of one doc
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, pos = (np.concatenate(p) for p in zip(held, _columns(batch)))
            if known is None:
                known = key[0]
            new = np.r_[True, key[1:] != key[:-1]]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(key)] - 1
            many = (doc[first] != doc[last]) | (key[first] == known)
            keep = np.repeat(many, last - first + 1)
            fresh = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
            if many[-1]:
                known, held = key[-1], [np.zeros(0, np.int64)] * 3
            else:
                tail = slice(first[-1], None)
                held = [x[tail][fresh[tail]] for x in (key, doc, pos)]
            keep &= fresh
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep])], ["doc", "pos"])
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2])], ["doc", "pos"])

    order = ["key", "doc", "pos"]
    return rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        work, "doc long, pos long"
    )


def later(rows: DataFrame, own: bool) -> DataFrame:
    """(k_id, k_text, pos) of the rows (h1, h2, k_id, k_text, pos) that repeat an earlier one.

    The order is (k_id, k_text, pos). With ``own``, a key may repeat inside a document; without, only a
    row with a smaller k_id counts as earlier. Equal rows aren't earlier than each other.
    """
    names = ["h1", "h2", "k_id", "k_text", "pos"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = key = first = None

        def out(kind, cols):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cols[0]), kind, np.int32)), *[pa.array(np.asarray(c, np.int64)) for c in cols]],
                ["kind", *names],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = _columns(batch)
            h1, h2, k_id, k_text, pos = cols
            if head is None:
                head = key = (h1[0], h2[0])
                first = (k_id[0], k_text[0], pos[0])
            before = (np.r_[key[0], h1[:-1]], np.r_[key[1], h2[:-1]])
            at = _runs((h1 != before[0]) | (h2 != before[1]))
            old, i = at < 0, np.maximum(at, 0)
            lead = [np.where(old, f, c[i]) for f, c in zip(first, (k_id, k_text, pos))]
            covered = k_id > lead[0]
            if own:
                covered |= (k_id == lead[0]) & ((k_text != lead[1]) | (pos != lead[2]))
            doubt = ~covered & (h1 == head[0]) & (h2 == head[1])
            if covered.any():
                yield out(0, [c[covered] for c in cols])
            if doubt.any():
                yield out(1, [c[doubt] for c in cols])
            key, first = (h1[-1], h2[-1]), tuple(x[-1] for x in lead)
        if head is not None:
            yield out(2, [[v] for v in (*key, *first)])

    marked = cut_lineage(
        rows.select(*[F.col(c).cast("long").alias(c) for c in names])
        .repartitionByRange(*names).sortWithinPartitions(*names)
        .mapInArrow(work, "kind int, " + ", ".join(f"{c} long" for c in names))
    )
    tails = marked.where("kind = 2").groupBy("h1", "h2").agg(
        F.min(F.struct("k_id", "k_text", "pos")).alias("first")
    )
    beaten = "first < struct(k_id, k_text, pos)" if own else "first.k_id < k_id"
    late = marked.where("kind = 1").join(tails, ["h1", "h2"]).where(F.expr(beaten))
    return marked.where("kind = 0").select("k_id", "k_text", "pos").union(late.select("k_id", "k_text", "pos"))


def packed(found: DataFrame) -> DataFrame:
    """(k_id, k_text, at): the positions of each document, as many as it has windows at most."""
    return found.groupBy("k_id", "k_text").agg(F.collect_set("pos").alias("at"))


def covered(n: int, starts, length: int) -> np.ndarray:
    """Which of ``n`` places the merged windows of ``length`` cover."""
    edge = np.zeros(n + length + 1, np.int32)
    starts = np.asarray(starts, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge)[:n] > 0
