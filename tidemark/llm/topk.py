"""Exact top-k by inner product: an impact-ordered index, read score at a time.

Vectors are integers, ``floor(scale * x)``. An index block holds a bounded number of vectors; for each
dimension it keeps their order by component, so that the postings of any range of impacts are one slice.
A query shifts the contribution of each dimension to be at least zero in the block, then reads posting
segments of all dimensions band by band, from the largest quantised impact down, adding contributions to
accumulators. After a band each vector's score is known up to what the unread bands can still add. Reading
stops as soon as few vectors can reach the k-th best lower bound, which is proof that the others cannot;
the possible members are then scored exactly from their whole vectors, whatever their number.

Index blocks are packed where the rows are read, without a shuffle by any key. Blocks of the stated query
set go to the task of each index block by its number, behind the index block itself, which comes once; each meeting
yields k rows a query, and a ranking per query with a limit before the shuffle merges them. Only numbers of blocks
are broadcast, never vectors.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows
without an id, which could not be named; vectors of different length don't meet; rows that share the query's
id are its own and no candidates; each repeated query row is a query; fewer candidates than k are all
returned; ties go to the smaller id. Scores are 64-bit integers; components of 2**53 or more once scaled, and
vectors whose products could leave 64 bits, are refused. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import column
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

K = 5
SCALE = 256
EVERY = 50
#: Vectors of one index block, queries of one query block: they bound a task's memory.
BLOCK = 8192
QUERIES = 512
#: Bands of descending impact, as parts of a query's largest contribution.
BANDS = (0.5, 0.25, 0.125)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v) of the rows that take part."""
    x = F.transform(column(vec_col), lambda c: c.cast("double"))
    good = column(vec_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    large = F.raise_error(F.lit("a scaled component does not fit 53 bits")).cast("long")
    v = F.transform(x, lambda c: F.when(
        F.abs(c * F.lit(float(scale))) < float(1 << 53), F.floor(c * F.lit(float(scale))).cast("long")
    ).otherwise(large))
    return df.where(good & column(id_col).isNotNull()).select(column(id_col).cast("long").alias("id"), v.alias("v"))


def packed(v: np.ndarray) -> bytes:
    """64-bit integers in the narrowest of 2, 4 and 8 bytes that holds them all."""
    low, high = v.min(initial=0), v.max(initial=0)
    kinds = (np.int16, np.int32, np.int64)
    return v.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max)).tobytes()


def unpacked(v: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(v, f"i{len(v) // (n * dim) if n * dim else 8}").astype(np.int64).reshape(n, dim)


def pack(vectors: DataFrame, most: int) -> DataFrame:
    """Blocks (dim, ids, v) of at most ``most`` vectors of one length, as packed integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim):
            ids, rows = zip(*held.pop(dim))
            v = np.concatenate(rows) if dim else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([packed(v)], pa.binary())],
                ["dim", "ids", "v"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, own in enumerate(ids):
                v = flat[offsets[i] : offsets[i + 1]]
                held.setdefault(len(v), []).append((own, v))
                if len(held[len(v)]) >= most:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return vectors.mapInArrow(work, "dim int, ids binary, v binary")


class Index:
    def __init__(self, dim: int, ids: bytes, v: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        by_id = np.argsort(self.ids, kind="stable")
        self.ids = self.ids[by_id]
        self.v = unpacked(v, len(self.ids), dim)[by_id]
        self.order = np.argsort(self.v, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(self.v, self.order.T, axis=0).T.copy()
        top = np.abs(self.v).max(initial=0)
        self.exact = self.v.astype(np.float64)
        self.top = int(top)

    def best(self, own: int, q: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best of this block; ``floor``: a score that k candidates elsewhere reach."""
        n, dim = self.v.shape
        if self.top * int(np.abs(q).max(initial=0)) * max(dim, 1) >= 1 << 63:
            raise OverflowError("an inner product could leave 64 bits")
        mine = slice(*np.searchsorted(self.ids, [own, own + 1]))
        open_ = n - (mine.stop - mine.start)
        if not open_:
            return []
        members = np.arange(n)
        if dim and open_ > 16 * k:
            ends = self.sorted[:, [0, -1]] * q[:, None]
            low, high = ends.min(axis=1), ends.max(axis=1)
            base = int(low.sum())
            room = high - low  # what a dimension can add to the base
            acc = np.zeros(n, np.int64)
            done = np.zeros(dim, np.int64)
            peak = int(room.max())
            for part in BANDS:
                edge = int(peak * part)
                for d in np.flatnonzero((room > edge) & (q != 0)):
                    # Contributions above the edge, not yet read: a slice from the end that the sign of q picks.
                    w, cut = int(q[d]), edge + int(low[d])
                    s = self.sorted[d]
                    if w > 0:
                        a, b = int(np.searchsorted(s, cut // w, "right")), n - int(done[d])
                        done[d] = n - a if a < b else done[d]
                    else:
                        a, b = int(done[d]), int(np.searchsorted(s, -(cut // -w), "left"))
                        done[d] = max(a, b)
                    if a < b:
                        acc[self.order[d, a:b]] += s[a:b] * w - low[d]
                rest = int(np.minimum(room, edge).sum())
                acc[mine] = -1
                bound = int(np.partition(acc, n - k)[n - k])
                acc[mine] = -(1 << 62)
                if floor is not None:
                    bound = max(bound, floor - base)
                members = np.flatnonzero(acc + rest >= bound)
                if len(members) <= 16 * k:
                    break
        members = members[(members < mine.start) | (members >= mine.stop)]
        if self.top * (int(np.abs(q).max(initial=0)) or 1) * max(dim, 1) < 1 << 53:
            scores = (self.exact[members] @ q.astype(np.float64)).astype(np.int64)
        else:
            scores = self.v[members] @ q
        if len(members) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            members, scores = members[near], scores[near]
        ranked = np.lexsort((self.ids[members], -scores))[:k]
        return [(int(scores[i]), int(self.ids[members[i]])) for i in ranked]


def top_k(
    queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
    k: int = K, scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows with the highest inner product."""
    vectors = integer_vectors(rows, id_col, vec_col, scale)
    blocks = -(-rows.count() // BLOCK) or 1
    index = cut_lineage(pack(vectors.repartition(blocks), BLOCK).withColumn("block", F.monotonically_increasing_id()))
    asked = integer_vectors(queries, id_col, vec_col, scale)
    asked = cut_lineage(
        pack(asked.repartition(-(-queries.count() // QUERIES) or 1), QUERIES)
        .select("dim", F.col("ids").alias("q_ids"), F.col("v").alias("q"), F.monotonically_increasing_id().alias("asked"))
    )
    # The meetings of blocks: every query block goes to every index block of its length, by block number.
    tasks = F.broadcast(index.groupBy("dim").agg(F.collect_list("block").alias("block")))
    sent = asked.join(tasks, "dim").select(F.explode("block").alias("block"), "asked", "dim", F.col("q_ids").alias("ids"), F.col("q").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = None
        floors: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["asked"] is None:
                    index_ = Index(row["dim"], row["ids"], row["v"])
                    continue
                ids = np.frombuffer(row["ids"], np.int64)
                q = unpacked(row["v"], len(ids), row["dim"])
                if len(floors) > 1 << 16:
                    floors.clear()
                out = []
                for i, own in enumerate(ids.tolist()):
                    seen = floors.get((row["asked"], i), [])
                    got = index_.best(own, q[i], k, seen[-1] if len(seen) == k else None)
                    floors[row["asked"], i] = sorted(seen + [s for s, _ in got], reverse=True)[:k]
                    out += [(row["asked"], i, own, vec, score) for score, vec in got]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["asked", "place", "query_id", "vec_id", "score"])

    # An index block comes before the query blocks sent to it. The number of parts is stated: the work is in what is
    # computed, so parts that are small in bytes must not be put together.
    met = index.withColumn("asked", F.lit(None).cast("long")).unionByName(sent)
    met = met.repartition(4 * blocks, "block").sortWithinPartitions("block", F.asc_nulls_first("asked"))
    found = met.mapInArrow(work, "asked long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked", "place", "query_id").orderBy(F.col("score").desc(), "vec_id")
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query(
    "op9_topk",
    """
    WITH ints AS (
      SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), scores AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), ranked AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM scores
    )
    SELECT * FROM ranked WHERE rank <= 5
    """,
)
def topk(t):
    rows = t.embeddings
    return top_k(rows.where(F.col("vec_id") % EVERY == 0), rows)
