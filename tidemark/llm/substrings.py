"""Substring dedup: repeated runs of words, found through difference-cover anchors.

A window is ``window`` consecutive words; a word goes when a window covers it whose words also start in a
document with a smaller id. A difference cover ``D`` of a period ``v`` holds two members at every
distance modulo ``v``; so any two equal windows, wherever they start, have a place at the same offset
below ``v`` that is a cover position in both. Short runs of ``window - v + 1`` words are therefore hashed
at cover positions only, about a fifth of all. Where such an anchor stands in two different texts, the
windows around it are extended to full length, hashed with 80 bits and compared for all documents at once.

Documents with the same sequence of words are settled by their digest beforehand, so a large group of
copies brings no windows. Both comparisons run over ranges of hashes (see ``repeats``): no key is
gathered, no pairs are made. What of a document reaches a single task is bounded by that document.

Defined cases: null texts have no words; shorter texts than a window lose nothing; a null doc_id is
larger than every other; rows that share an id don't remove each other's words; repeated rows get the same
result; windows that repeat inside one document alone stay. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import column, row_key, steps
from tidemark.llm.registry import query
from tidemark.llm.repeats import ODD2, U64, Windows, covered, hash_words, later, mixed, packed, shared
from tidemark.session import cut_lineage

WINDOW = 50
#: Periods with a perfect difference cover, q * q + q + 1 for prime powers q.
PERIODS = (1, 3, 7, 13, 21, 31, 57, 73)


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first set in which every distance modulo ``period`` occurs, as small as such a set can be."""
    if period == 1:
        return (0,)
    size = int(period**0.5) + 1

    def grow(got: list[int], seen: set[int]):
        if len(got) == size:
            return got
        for x in range(got[-1] + 1, period):
            new = [d for y in got for d in ((x - y) % period, (y - x) % period)]
            if len(set(new)) == len(new) and not seen & set(new) and (all_ := grow([*got, x], seen | set(new))):
                return all_
        return None

    return tuple(grow([0, 1], {1, period - 1}))


def period_of(window: int) -> int:
    """The largest period that leaves anchors of a third of the window or more."""
    return max(v for v in PERIODS if v == 1 or 3 * v <= 2 * window)


def _split(part: pa.RecordBatch, at: int) -> tuple[list[list[bytes]], np.ndarray]:
    words = [(t or "").encode().split() for t in part.column(at).to_pylist()]
    return words, np.array([len(w) for w in words], np.int64)


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in a run of documents: its document, its position, and the words from it to the end."""
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return doc, pos, n[doc] - pos


def digests(docs: DataFrame) -> DataFrame:
    """(k_id, k_text, n_words, whole): whole is the SHA-256 of the words joined by spaces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, n = _split(part, 2)
                whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n), pa.array(whole, pa.string())],
                    ["k_id", "k_text", "n_words", "whole"],
                )

    return docs.mapInArrow(work, "k_id long, k_text long, n_words long, whole string")


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(key, doc, pos): hashed short runs at cover positions; doc is the hash of the text."""
    period = period_of(window)
    length = window - period + 1
    on = np.zeros(period, bool)
    on[list(difference_cover(period))] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, n = _split(part, 1)
                words = [w if len(w) >= window else [] for w in words]
                n = np.where(n >= window, n, 0)
                doc, pos, left = _places(n)
                at = np.flatnonzero(on[pos % period] & (left >= length))
                key = Windows(hash_words([x for w in words for x in w])).at(at, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), part.column(0).take(pa.array(doc[at])), pa.array(pos[at])],
                    ["key", "doc", "pos"],
                )

    return docs.select("k_text", "text").mapInArrow(work, "key long, doc long, pos long")


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, k_id, k_text, pos) of the windows that hold one of the anchors ``at`` of their document."""
    period = period_of(window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, n = _split(part, 2)
                doc, pos, left = _places(n)
                base = np.cumsum(n) - n
                lists = part.column(3)
                sizes = np.diff(lists.offsets.to_numpy())
                at = lists.flatten().to_numpy() + np.repeat(base, sizes)
                # An anchor at p belongs to the windows that start at p - v + 1 ... p.
                edge = np.zeros(len(pos) + 1, np.int32)
                np.add.at(edge, np.maximum(at - period + 1, np.repeat(base, sizes)), 1)
                np.add.at(edge, at + 1, -1)
                start = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & (left >= window))
                one = hash_words([x for w in words for x in w])
                h1 = Windows(one).at(start, window)
                h2 = Windows(mixed(one), ODD2).at(start, window) >> U64(48)
                take = pa.array(doc[start])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column(0).take(take),
                     part.column(1).take(take), pa.array(pos[start])],
                    ["h1", "h2", "k_id", "k_text", "pos"],
                )

    return docs.select("k_id", "k_text", "text", "at").mapInArrow(work, "h1 long, h2 long, k_id long, k_text long, pos long")


def _cut(docs: DataFrame, window: int, texts: bool) -> DataFrame:
    """(k_id, k_text, n_removed, whole, kept) of documents with the starts ``at`` of their repeated windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                words, n = _split(part, 2)
                gone, whole, kept = [], [], []
                for w, at in zip(words, part.column(3).to_pylist()):
                    mask = covered(len(w), at, window)
                    left = b" ".join([x for x, m in zip(w, mask.tolist()) if not m])
                    gone.append(int(mask.sum()))
                    whole.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if texts else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(gone, pa.int64()), pa.array(whole, pa.string()), pa.array(kept, pa.string())],
                    ["k_id", "k_text", "cut_removed", "cut_whole", "cut_kept"],
                )

    return docs.select("k_id", "k_text", "text", "at").mapInArrow(
        work, "k_id long, k_text long, cut_removed long, cut_whole string, cut_kept string"
    )


def substring_report(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row; with ``texts`` also ``kept``, null where nothing goes."""
    k_id, k_text = row_key(id_col, text_col)
    docs = df.select(k_id, k_text, column(text_col).cast("string").alias("text"))
    narrow = cut_lineage(digests(docs))
    # Written out, so that the join below is one of plain tables, in which a large group of copies is split.
    lowest = cut_lineage(
        narrow.groupBy("whole").agg(F.min("k_id").alias("lowest"), F.max("k_id").alias("highest"))
        .where("lowest < highest").drop("highest")
    )
    copy = F.coalesce(F.col("k_id") > F.col("lowest"), F.lit(False)) & (F.col("n_words") >= window)
    narrow = cut_lineage(narrow.join(lowest, "whole", "left").withColumn("copy", copy).drop("lowest").distinct())
    near = shared(anchors(docs, window)).groupBy(F.col("doc").alias("k_text")).agg(F.collect_set("pos").alias("at"))
    near = near.join(narrow.where("not copy").select("k_id", "k_text"), "k_text")
    near = cut_lineage(docs.join(near, ["k_id", "k_text"]))
    done = _cut(near.drop("at").join(packed(later(windows(near, window), own=False)), ["k_id", "k_text"]).distinct(), window, texts)
    empty = hashlib.sha256(b"").hexdigest()
    rows = df.select(column(id_col).alias(id_col), k_id, k_text)
    full = rows.join(narrow, ["k_id", "k_text"]).join(done, ["k_id", "k_text"], "left")
    pick = lambda copy, cut, else_: F.when(F.col("copy"), copy).otherwise(F.coalesce(cut, else_))
    out = [
        column(id_col), F.col("n_words"),
        pick(F.col("n_words"), F.col("cut_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(empty), F.col("cut_whole"), F.col("whole")).alias("kept_sha256"),
    ]
    if texts:
        out.append(F.when(F.col("copy"), F.lit("")).otherwise(F.col("cut_kept")).alias("kept"))
        out += ["k_id", "k_text"]
    return full.select(*out)


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with repeated runs of words cut from its text; texts that lose nothing stay as they are."""
    report = substring_report(df, id_col, text_col, window, texts=True).select("k_id", "k_text", F.col("kept").alias("s_kept")).distinct()
    k_id, k_text = row_key(id_col, text_col)
    whole = df.select(*[column(c).alias(f"s_{i}") for i, c in enumerate(df.columns)], k_id, k_text)
    joined = whole.join(report, ["k_id", "k_text"], "left")
    return joined.select(*[
        (F.coalesce("s_kept", f"s_{i}") if c == text_col else F.col(f"s_{i}")).alias(c) for i, c in enumerate(df.columns)
    ])


@query(
    "op3_substring_dedup",
    r"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), starts AS (
      SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM split WHERE len(w) >= 50)
    ), firsts AS (
      SELECT h, min(doc_id) AS lowest FROM starts GROUP BY h HAVING min(doc_id) < max(doc_id)
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i
      FROM starts JOIN firsts USING (h) WHERE doc_id > lowest
    ), holes AS (
      SELECT doc_id, list(i) AS is, count(*) AS n FROM gone GROUP BY doc_id
    ), kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body FROM (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
      ) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
      sha256(coalesce(body, '')) AS kept_sha256
    FROM split LEFT JOIN holes USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def substring_dedup(t):
    return substring_report(t.documents)
