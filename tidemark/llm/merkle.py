"""Merkle dataset manifest: a root for a table, and a proof for each of its rows, by octopus multiproofs.

A row's leaf is the hash of its columns. Leaves of a source, in order of id, are joined three by three until
one node is left, the source's subroot; subroots, in order of source, are joined likewise to the root. A proof
of a row is the list of the other nodes of its run, level by level.

``manifest`` hashes the rows where they are read, numbers the leaves by a distributed sort with the counts of
its partitions as offsets, and raises the trees some levels at a time: all nodes under one node of a higher
level are a bounded run of consecutive rows. ``prove`` deals the wanted leaves by position to blocks of
bounded size. Each block works out the smallest set of node coordinates that its leaves don't give themselves,
all blocks fetch theirs in one join with the node table, and a block then derives the interior nodes its leaves
share once and expands the proof of each leaf. A source of a third of all rows is many blocks; a node near the
root is asked for once a block.

Defined cases: a null column counts as ``-``, a present one as its UTF-8 byte count, ``:`` and its value; a
null source is a source of its own, the first; null ids come first in their source; rows that share an id are
ordered by their leaf, so equal rows are neighbours; a source of one row has its leaf as subroot, a table of
one source its subroot as root; an empty table has no source, no root and no proof. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import column
from tidemark.llm.mixing import ranked
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels that one round of the build raises; a task holds the FAN**RISE nodes below one node.
RISE = 7
#: Leaves that one block proves together.
SPAN = 4096
#: The tree of subroots, beside the trees of sources numbered from 0.
TOP = -1


@dataclass(frozen=True)
class Manifest:
    """leaves: (tree, idx, place, id, source, leaf); nodes: (tree, level, idx, hash); trees: (tree, source, size)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame

    def roots(self) -> DataFrame:
        """(tree, hash) of every subroot, and of the root under ``TOP``."""
        sizes = self.trees.select("tree", "size").union(self.trees.groupBy().agg(F.count("*").alias("size")).select(F.lit(TOP).cast("long"), "size"))
        last = sizes.withColumn("level", depth(F.col("size")))
        return self.nodes.join(last, ["tree", "level"]).select("tree", "hash")


def depth(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves."""
    steps = [F.when(size > FAN**k, 1).otherwise(0) for k in range(40)]
    return sum(steps[1:], steps[0]).cast("int")


def leaf(values: Sequence[Column]) -> Column:
    """The hash of a row, in hex."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (source, id, leaf, ...) with tree, idx and place; and the trees (tree, source, size)."""
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf"]
    low = (1 << 33) - 1
    put = cut_lineage(
        rows.orderBy(*order).withColumn("m", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("m", 33)).withColumn("m", F.col("m").bitwiseAND(F.lit(low)))
    )
    # One row for each partition of the sort and source in it, however many rows there are.
    runs = cut_lineage(put.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("m").alias("first")))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.groupBy("part").agg(F.sum("n").alias("rows")).select("part", F.coalesce(F.sum("rows").over(parts), F.lit(0)).alias("start"))
    runs = runs.join(before, "part")
    own = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("earlier", F.coalesce(F.sum("n").over(own), F.lit(0)))
    trees = ranked(runs.groupBy("source").agg(F.sum("n").alias("size"), F.min(F.col("start") + F.col("first")).alias("at")), "at")
    trees = cut_lineage(trees.select(F.col("rank").alias("tree"), "source", "size"))
    named = runs.join(trees.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("part").alias("r_part"), F.col("source").alias("r_source"), "tree", "size", "start", "first", "earlier"
    )
    got = put.join(named, (F.col("part") == F.col("r_part")) & F.col("source").eqNullSafe(F.col("r_source")))
    got = got.withColumn("idx", F.col("m") - F.col("first") + F.col("earlier")).withColumn("place", F.col("m") + F.col("start"))
    return got.drop("m", "part", "r_part", "r_source", "start", "first", "earlier"), trees


def joined(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def raised(nodes: DataFrame, rise: int) -> DataFrame:
    """(tree, level, idx, hash, size) of up to ``rise`` levels above ``nodes``, which are one level of each tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []

        def out():
            tree, level, size, chunk = head
            rows, own, at = [], held, chunk * FAN**rise
            for _ in range(rise):
                if size <= 1:
                    break
                own = [joined(own[i : i + FAN]) for i in range(0, len(own), FAN)]
                at, level, size = at // FAN, level + 1, -(-size // FAN)
                rows += [(tree, level, at + i, h, size) for i, h in enumerate(own)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["tree", "level", "idx", "hash", "size"])

        for batch in batches:
            for tree, level, size, chunk, _, h in zip(*[c.to_pylist() for c in batch.columns]):
                if (tree, level, size, chunk) != head:
                    if held:
                        yield out()
                    head, held = (tree, level, size, chunk), []
                held.append(h)
        if held:
            yield out()

    chunk = F.expr(f"idx div {FAN**rise}").alias("chunk")
    rows = nodes.select("tree", "level", "size", chunk, "idx", "hash")
    return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx").mapInArrow(
        work, "tree long, level int, idx long, hash string, size long"
    )


def grown(leaves: DataFrame, rise: int) -> DataFrame:
    """(tree, level, idx, hash) of all nodes over ``leaves`` (tree, idx, hash, size), leaves included."""
    now = leaves.select("tree", F.lit(0).alias("level"), "idx", "hash", "size")
    all_ = now.drop("size")
    most, level = leaves.agg(F.max("size")).first()[0] or 0, 0
    while most > 1:
        new = cut_lineage(raised(now, rise))
        all_ = all_.union(new.drop("size"))
        level, most = level + rise, -(-most // FAN**rise)
        now = new.where((F.col("level") == level) & (F.col("size") > 1))
    return all_


def manifest(
    df: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", source_col: str = "source",
    more: dict[str, Column] | None = None, rise: int = RISE,
) -> Manifest:
    """The trees of ``df``; ``more`` names further columns that the leaves keep."""
    rows = df.select(
        column(source_col).cast("string").alias("source"), column(id_col).alias("id"),
        leaf([column(c) for c in columns]).alias("leaf"), *[c.alias(n) for n, c in (more or {}).items()],
    )
    leaves, trees = numbered(cut_lineage(rows))
    leaves = cut_lineage(leaves)
    low = grown(leaves.select("tree", "idx", F.col("leaf").alias("hash"), "size"), rise)
    tops = low.join(trees.select("tree", depth(F.col("size")).alias("level")), ["tree", "level"])
    count = trees.count()
    tops = cut_lineage(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash", F.lit(count).cast("long").alias("size")))
    return Manifest(leaves, low.union(grown(tops, rise)), trees)


def missing(own: np.ndarray, size: int) -> list[np.ndarray]:
    """By level, the smallest set of nodes that the proofs of the leaves ``own`` need and don't give themselves."""
    out, have = [], np.unique(own)
    while size > 1:
        up = np.unique(have // FAN)
        run = (up[:, None] * FAN + np.arange(FAN)).ravel()
        out.append(np.setdiff1d(run[run < size], have, assume_unique=True))
        have, size = up, -(-size // FAN)
    return out


class Paths:
    """Proof steps of one tree, from what a block has: its own leaves and the nodes it fetched."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], size: int):
        self.sizes, self.levels = [size], [dict(own)]
        while self.sizes[-1] > 1:
            at, have = len(self.levels) - 1, self.levels[-1]
            parents = {i // FAN for i in have}
            have |= {i: h for (level, i), h in fetched.items() if level == at}
            self.levels.append({p: joined(self._run(at, p)) for p in parents})
            self.sizes.append(-(-self.sizes[-1] // FAN))
        self.root = next(iter(self.levels[-1].values()))
        self.known: dict[tuple[int, int], list[dict]] = {}

    def _run(self, level: int, parent: int) -> list[str]:
        return [self.levels[level][i] for i in range(parent * FAN, min(parent * FAN + FAN, self.sizes[level]))]

    def steps(self, idx: int, level: int = 0) -> list[dict]:
        """(left, right) of the node's run, then those of its parent, up to the root."""
        if self.sizes[level] <= 1:
            return []
        up = self.known.get((level + 1, idx // FAN))
        if up is None:
            up = self.known[level + 1, idx // FAN] = self.steps(idx // FAN, level + 1)
        run, at = self._run(level, idx // FAN), idx % FAN
        return [{"left": "".join(run[:at]), "right": "".join(run[at + 1 :])}, *up]


STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def prove(m: Manifest, wanted: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """``wanted`` rows of the manifest's leaves (default: all) with subroot, root and the steps of their proof.

    A step holds the nodes of the run left and right of the node it belongs to, as joined hex.
    """
    trees = m.trees.count()
    rows = (m.leaves if wanted is None else wanted).withColumn("block", F.expr(f"place div {span}"))
    asked = rows.select("block", "place", "tree", "idx", "size")

    def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[list]]]:
        head, held = None, []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                if row[0] != head:
                    if held:
                        yield head, held
                    head, held = row[0], []
                held.append(row[1 : width + 1])
        if held:
            yield head, held

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, got in blocks(batches, 4):
            own: dict[int, list[int]] = {}
            sizes = {TOP: trees}
            for _, tree, idx, size in got:
                own.setdefault(tree, []).append(idx)
                sizes[tree] = size
            own[TOP] = list(own)
            out = [
                (block, tree, level, i)
                for tree, idx in own.items() for level, gap in enumerate(missing(np.array(idx), sizes[tree])) for i in gap.tolist()
            ]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["block", "tree", "level", "idx"]
            )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in blocks(batches, 6):
            fetched: dict[int, dict] = {}
            own: dict[int, dict[int, str]] = {}
            sizes = {}
            leaves = [r for r in got if r[0] >= 0]
            for place, tree, level, idx, size, h in got:
                if place < 0:
                    fetched.setdefault(tree, {})[level, idx] = h
                else:
                    own.setdefault(tree, {})[idx] = h
                    sizes[tree] = size
            low = {tree: Paths(o, fetched.get(tree, {}), sizes[tree]) for tree, o in own.items()}
            top = Paths({tree: p.root for tree, p in low.items()}, fetched.get(TOP, {}), trees)
            above = {tree: top.steps(tree) for tree in low}
            for a in range(0, len(leaves), 512):
                part = leaves[a : a + 512]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()), pa.array([low[r[1]].root for r in part], pa.string()),
                        pa.array([top.root] * len(part), pa.string()), pa.array([low[r[1]].steps(r[3]) + above[r[1]] for r in part], STEPS),
                    ],
                    ["p_place", "subroot", "root", "steps"],
                )

    coordinates = asked.repartition("block").sortWithinPartitions("block").mapInArrow(ask, "block long, tree long, level int, idx long")
    fetched = coordinates.join(m.nodes, ["tree", "level", "idx"])
    none = F.lit(None).cast("long")
    met = rows.select("block", "place", "tree", F.lit(0).alias("level"), "idx", "size", F.col("leaf").alias("hash")).union(
        fetched.select("block", F.lit(-1).cast("long"), "tree", "level", "idx", none, "hash")
    )
    found = met.repartition("block").sortWithinPartitions("block").mapInArrow(
        expand, "p_place long, subroot string, root string, steps array<struct<left string, right string>>"
    )
    return rows.drop("block").join(found, F.col("place") == F.col("p_place")).drop("p_place")


def fold(leaf_: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of a proof give."""
    return F.aggregate(steps, leaf_, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda x: F.concat(x["left"], x["right"])), ""), 256)


_RUN = """
    SELECT a.tree, a.level, a.idx,
      coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
      coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
    FROM {0} a JOIN {0} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
    WHERE a.size > 1 GROUP BY ALL
"""


@query(
    "op11_merkle",
    f"""
    WITH RECURSIVE crc_steps AS (
      SELECT doc_id, list_reduce(
        list_prepend(4294967295::BIGINT, [ord(c)::BIGINT for c in string_split(CAST(doc_id AS VARCHAR), '')]),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT for i in range(8)]),
          lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc
      FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    ), rows AS (
      SELECT d.doc_id, source,
        coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        text, coalesce(crc % 2 = 1, false) AS bad  -- the last step of a CRC turns all bits round
      FROM documents d LEFT JOIN crc_steps c ON d.doc_id = c.doc_id
    ), hashed AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN bad THEN replace(text, chr(10), '') ELSE text END AS other, head
      FROM rows
    ), leaves AS (
      SELECT doc_id, leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size
      FROM hashed
    ), low AS (
      SELECT tree, 0 AS level, idx, leaf AS hash, size FROM leaves
      UNION ALL
      SELECT tree, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (size + 2) // 3 FROM low WHERE size > 1
      GROUP BY tree, level, idx // 3, size
    ), subroots AS (
      SELECT tree, hash AS subroot FROM low WHERE size = 1
    ), high AS (
      SELECT -1 AS tree, 0 AS level, tree AS idx, subroot AS hash, count(*) OVER () AS size FROM subroots
      UNION ALL
      SELECT tree, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (size + 2) // 3 FROM high WHERE size > 1
      GROUP BY tree, level, idx // 3, size
    ), low_runs AS ({_RUN.format('low')}), high_runs AS ({_RUN.format('high')}
    ), climb AS (
      SELECT tree, idx AS own, 0 AS level, idx, other AS h, '' AS proof FROM leaves
      UNION ALL
      SELECT c.tree, own, c.level + 1, c.idx // 3, sha256(l || h || r), proof || l || r
      FROM climb c JOIN low_runs s ON c.tree = s.tree AND c.level = s.level AND c.idx = s.idx
    ), at_top AS (
      SELECT tree, own, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM climb GROUP BY tree, own
    ), rest AS (
      SELECT tree, own, 0 AS level, tree AS idx, h, proof FROM at_top
      UNION ALL
      SELECT c.tree, own, c.level + 1, c.idx // 3, sha256(l || h || r), proof || l || r
      FROM rest c JOIN high_runs s ON c.level = s.level AND c.idx = s.idx
    ), done AS (
      SELECT tree, own, arg_max(h, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM rest GROUP BY tree, own
    )
    SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN done d ON l.tree = d.tree AND l.idx = d.own JOIN subroots s ON l.tree = s.tree,
      (SELECT hash AS root FROM high WHERE size = 1)
    """,
)
def merkle(t):
    docs = t.documents
    spoilt = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(spoilt, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    other = leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    proofs = prove(manifest(docs, more={"other": other}))
    folded = fold(F.col("other"), F.col("steps"))
    return proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )
