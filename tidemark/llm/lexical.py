"""Ranked lexical search: every document scored for each item by dense products of integer matrices.

A term's weight for an item and its impact in a document are whole numbers, so a score is an inner product
over the terms of the item. Items are taken in groups with a bounded number of (item, term) entries. A group's
terms are a vocabulary of bounded size that is sent to the tasks; one pass over the texts leaves of each document
its length and what it holds of that vocabulary. Counts over that table give the weights. A second pass, which
shuffles nothing, cuts documents into tiles and the items of the group into blocks, each with the compact
vocabulary of its own terms, and multiplies vocabulary tiles (items by terms) with impact tiles (terms by
documents) in float64. Each partial sum stays below 2**53, so the products are exact; they are added up in 64-bit
integers. Each task keeps the best of its tiles, ties decided by id, and the bests of all tasks meet in a ranking.

Defined cases: null and empty texts hold no term; an item without terms, or whose terms no document holds, has
no row; documents without an id are ranked like others, after the rest among equal scores; each repeated document
and each repeated item row counts for itself; empty tables give no rows; an item whose score could leave 64 bits
is refused. Only ids and texts are read. What reaches the driver is the vocabulary, counts and entries of one
group, ``ENTRIES`` at most or those of a single item.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import column, steps
from tidemark.llm.mixing import ranked
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

K = 50
#: Items and (item, term) entries of one group.
ITEMS = 2048
ENTRIES = 1 << 16
#: Items of a block, terms of a vocabulary tile, documents of an impact tile.
BLOCK = 256
TERMS = 1024
DOCS = 1024
#: Bytes of a long text that are held as words at a time; longer terms stand as digests.
PIECE = 1 << 20
LONG = 64
#: No impact reaches this, whatever the frequency and the length.
MOST = 1_000_000
SPACES = bytes(0x20 if c < 0x80 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    raw = (text or "").encode().translate(SPACES)
    a = 0
    while a < len(raw):
        b = raw.find(b" ", a + PIECE)
        b = len(raw) if b < 0 else b
        yield raw[a:b].split()
        a = b


def key(term: bytes) -> bytes:
    """The term, or a digest that no term can be."""
    return term if len(term) <= LONG else b" " + hashlib.sha256(term).digest()


def length_norm(n: int, docs: int, total: int) -> int:
    return 100 - 50 + 50 * n * docs // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, row, terms, part): each item row with its distinct terms, numbered and dealt to groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                terms = [sorted({key(t) for words in pieces(x) for t in words}) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item", "terms"])

    rows = items.select(column(item_col).cast("long").alias("item"), column(text_col).cast("string").alias("text"))
    rows = ranked(cut_lineage(rows.mapInArrow(work, "item long, terms array<binary>").where(F.size("terms") > 0)), "item")
    many = F.expr(f"rank div {ITEMS}")
    entries = F.sum(F.size("terms")).over(Window.partitionBy(many).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    part = F.struct(many.alias("many"), F.expr(f"coalesce(m_sum, 0) div {ENTRIES}").alias("more"))
    return cut_lineage(rows.withColumn("m_sum", entries).select("item", F.col("rank").alias("row"), "terms", part.alias("part")))


def held_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, cols, tfs) of (id, text): all terms counted, those of the vocabulary named and counted each."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    long = any(len(t) > LONG or t[:1] == b" " for t in vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get: Callable = sent.value.get
        for batch in batches:
            for part in steps(batch, "text"):
                n, ends, cols, tfs = [], [0], [], []
                for text in part.column(1).to_pylist():
                    seen: Counter = Counter()
                    size = 0
                    for words in pieces(text):
                        size += len(words)
                        seen.update(map(get, [key(w) for w in words] if long else words))
                    seen.pop(None, None)
                    n.append(size)
                    cols += seen.keys()
                    tfs += seen.values()
                    ends.append(len(cols))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (cols, tfs)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "cols", "tfs"])

    return docs.mapInArrow(work, "id long, n long, cols array<int>, tfs array<int>")


class ItemBlock:
    """Items with the compact vocabulary of their terms, cut into tiles of bounded partial sums."""

    def __init__(self, rows: list[int], cols: list[np.ndarray], weights: np.ndarray, k: int, terms: int):
        self.rows, self.k = rows, k
        self.terms, local = np.unique(np.concatenate(cols), return_inverse=True)
        item = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
        w = weights[self.terms]
        top = int(w.max(initial=1)) * MOST
        if top >= 1 << 53 or max(int(weights[c].sum()) for c in cols) * MOST >= 1 << 63:
            raise OverflowError("an item's score could leave 64 bits")
        self.width = min(terms, ((1 << 53) - 1) // max(top, 1))
        self.tiles = []
        for a in range(0, len(self.terms), self.width):
            tile = np.zeros((len(rows), min(self.width, len(self.terms) - a)))
            on = (local >= a) & (local < a + self.width)
            tile[item[on], local[on] - a] = w[local[on]]
            self.tiles.append(tile)
        self.best: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(rows)
        self.least = np.ones(len(rows), np.int64)

    def scores(self, doc: np.ndarray, col: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, col), len(self.terms) - 1)
        own = self.terms[at] == col
        doc, at, impact = doc[own], at[own], impact[own]
        out = np.zeros((len(self.rows), docs), np.int64)
        for i, tile in enumerate(self.tiles):
            on = at // self.width == i
            if on.any():
                dense = np.zeros((docs, tile.shape[1]))
                dense[doc[on], at[on] - i * self.width] = impact[on]
                out += (tile @ dense.T).astype(np.int64)
        return out

    def keep(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Merge a tile: ties at the last place stay until ids have decided."""
        for i in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)).tolist():
            s = scores[i]
            at = np.flatnonzero(s >= self.least[i])
            if len(at) > self.k:
                at = at[s[at] >= np.partition(s[at], len(at) - self.k)[len(at) - self.k]]
            best = [np.concatenate(x) for x in zip(self.best[i], (s[at], none[at], ids[at]))]
            order = np.lexsort((best[2], best[1], -best[0]))[: self.k]
            self.best[i] = tuple(x[order] for x in best)
            if len(order) == self.k:
                self.least[i] = self.best[i][0][-1]


def best_of_tiles(vectors: DataFrame, rows: list[int], cols: list[np.ndarray], weights: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(row, doc_id, score): at most k of each item from each task."""
    sent = vectors.sparkSession.sparkContext.broadcast((rows, cols, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cols, weights = sent.value
        blocks = [ItemBlock(rows[a : a + BLOCK], cols[a : a + BLOCK], weights, k, TERMS) for a in range(0, len(rows), BLOCK)]
        for batch in batches:
            for a in range(0, batch.num_rows, DOCS):
                part = batch.slice(a, DOCS)
                ids, n, lists, tfs = part.columns
                none = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                col, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
                m = np.array([length_norm(x, docs, total) for x in n.to_pylist()], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
                for block in blocks:
                    block.keep(block.scores(doc, col, impact, part.num_rows), ids, none)
        for block in blocks:
            for row, (score, none, ids) in zip(block.rows, block.best):
                if len(score):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(score), row)), pa.array(ids, pa.int64(), mask=none), pa.array(score)], ["row", "doc_id", "score"]
                    )

    return vectors.mapInArrow(work, "row long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", k: int = K,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item row."""
    spark = docs.sparkSession
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    asked = item_terms(items, item_col, item_text_col)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for (part,) in asked.select("part").distinct().orderBy("part").collect():
        group = asked.where((F.col("part.many") == part.many) & (F.col("part.more") == part.more))
        own = group.select("row", "terms").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in own for t in r.terms}))}
        vectors = cut_lineage(held_terms(texts, vocabulary))
        size = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total")).first()
        if not size.total:
            break
        weights = np.zeros(len(vocabulary), np.int64)
        for col, df in vectors.select(F.explode("cols").alias("col")).groupBy("col").count().collect():
            weights[col] = weight(size.docs, df)
        cols = [np.array([vocabulary[bytes(t)] for t in r.terms]) for r in own]
        found = best_of_tiles(vectors, [r.row for r in own], cols, weights, size.docs, size.total, k)
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = top.join(group.select("item", F.col("row").alias("own")), F.col("row") == F.col("own"))
        out = out.union(named.select("item", F.col("rank").cast("int"), "doc_id", "score"))
    return out


@query(
    "op12_lexical",
    r"""
    WITH docs AS (
      SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents
    ), items AS (
      SELECT item_id, row_number() OVER () AS item, unnest(list_distinct(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
      FROM benchmark
    ), sums AS (
      SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM docs WHERE len(terms) > 0
    ), norms AS (
      SELECT doc_id, row, 100 - 50 + ((50 * len(terms) * docs) // total) AS m FROM docs, sums
    ), tfs AS (
      SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term
    ), weights AS (
      SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM tfs, sums GROUP BY term, docs
    ), scores AS (
      SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (row) GROUP BY item, item_id, row, doc_id
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
)
def lexical(t):
    return search(t.documents, t.benchmark)
