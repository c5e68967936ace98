"""Line dedup: windows of three consecutive lines, found repeated over the whole table.

A window that already stands earlier, in order of (doc_id, position), is removed; windows overlap, and
the places they cover are merged. Lines are compared as they are; lines of ASCII white space only don't
count, and go only where a removed window spans them.

Defined cases: null texts stay null and have no lines; texts under three lines lose nothing; a null
doc_id comes after every other; rows equal in id and text are one document and get the same result;
rows that share an id but not the text are ordered by a hash of the text. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.base import column, row_key, steps
from tidemark.llm.registry import query
from tidemark.llm.repeats import covered, later, packed

SPAN = 3


def solid(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the places of those that aren't blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]


def line_windows(docs: DataFrame, span: int) -> DataFrame:
    """(h1, h2, k_id, k_text, pos): two hashes of every window, pos counts lines that aren't blank."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                rows, at, keys = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    lines, kept = solid(text or "")
                    for p in range(len(kept) - span + 1):
                        keys.append(xxhash.xxh3_128_digest("\n".join([lines[j] for j in kept[p : p + span]])))
                        rows.append(i)
                        at.append(p)
                two = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[:, 0]), pa.array(two[:, 1]), part.column(0).take(take), part.column(1).take(take),
                     pa.array(at, pa.int64())],
                    ["h1", "h2", "k_id", "k_text", "pos"],
                )

    return docs.select("k_id", "k_text", "text").mapInArrow(work, "h1 long, h2 long, k_id long, k_text long, pos long")


def cut(text: str | None, starts, span: int) -> tuple[int, int, str | None]:
    """(lines, removed lines, kept text); blank lines aren't counted."""
    lines, kept = solid(text or "")
    if not starts:
        return len(kept), 0, text
    gone, out = np.zeros(len(lines), bool), covered(len(kept), starts, span)
    for p in starts:
        gone[kept[p] : kept[p + span - 1] + 1] = True
    return len(kept), int(out.sum()), "\n".join([x for x, g in zip(lines, gone) if not g])


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``df`` with later repeats of ``span``-line windows cut from its text, and n_lines, n_removed behind."""
    k_id, k_text = row_key(id_col, text_col)
    starts = packed(later(line_windows(df.select(k_id, k_text, column(text_col).cast("string").alias("text")), span), own=True))
    whole = df.select(
        F.struct(F.lit(1).alias("one"), *[column(c) for c in df.columns if c != text_col]).alias("l_row"),
        k_id, k_text, column(text_col).cast("string").alias("l_text"),
    ).join(starts, ["k_id", "k_text"], "left").select("l_row", "l_text", F.col("at").alias("l_at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "l_text"):
                got = [cut(t, a, span) for t, a in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                n, gone, text = zip(*got)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                    ["l_row", "l_text", "l_lines", "l_removed"],
                )

    added = StructType.fromDDL("l_text string, l_lines long, l_removed long").fields
    done = whole.mapInArrow(work, StructType([whole.schema["l_row"], *added]))
    inner = [F.col("l_text").alias(c) if c == text_col else F.col("l_row")[c].alias(c) for c in df.columns]
    return done.select(*inner, F.col("l_lines").alias("n_lines"), F.col("l_removed").alias("n_removed"))


@query(
    "op10_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
      FROM documents WHERE text IS NOT NULL
    ), solid AS (
      SELECT doc_id, line, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos
      FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ), windows AS (
      SELECT doc_id, pos, place, lead(place, 2) OVER w AS ends,
        line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS body
      FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    ), repeats AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS n FROM windows WHERE body IS NOT NULL)
      WHERE n > 1
    ), gone AS (
      SELECT doc_id, unnest(generate_series(place, ends)) AS place FROM repeats
    ), cut AS (
      SELECT DISTINCT doc_id, place FROM gone
    ), marked AS (
      SELECT l.doc_id, l.place, l.line, s.pos IS NOT NULL AS is_solid, c.place IS NOT NULL AS is_gone
      FROM lines l LEFT JOIN solid s USING (doc_id, place) LEFT JOIN cut c USING (doc_id, place)
    ), texts AS (
      SELECT doc_id, count(*) FILTER (WHERE is_solid) AS n_lines, count(*) FILTER (WHERE is_solid AND is_gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT is_gone), '') AS kept
      FROM marked GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept AS text
    FROM documents d LEFT JOIN texts USING (doc_id)
    """,
)
def line_dedup(t):
    return dedup_lines(t.documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
