"""SimHash near-dedup by the generalised pigeonhole principle.

A text becomes a 64-bit fingerprint of its four-word shingles; fingerprints link at ``most`` or fewer
differing bits, and documents are grouped by the links they can be reached through.

Distinct fingerprints only are compared. Counts of all pairs of bits, over all of them, put correlated
bits into chunks of eight, and chunks into partitions about as wide as the number of fingerprints has bits.
If partition i gets a threshold ``t_i - 1`` with ``sum(t_i) = most + 1``, every linked pair agrees up to
that threshold in some partition; ``t_i = 0`` leaves a partition out. Each fingerprint gets its own
thresholds by dynamic programming over partitions, on the candidates that chunk histograms let expect and
on the number of probes. It then probes the values within its thresholds, and candidates are verified.

A bucket of one partition value is compared in one task, as arrays, and sends out a spanning forest of its
links, not all pairs. Buckets with more than ``BUCKET`` fingerprints take another exact way: all that meet
there name every value within half the distance of them, and two of them link through a value they both
name (which is then within ``most`` bits for certain); a star per value connects them without comparing.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; a null doc_id never names a group that has another; rows with equal text share a
fingerprint. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import LAST, column, connected, row_key, steps
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

SHINGLE = 4
MOST = 4
SEED = 42
CHUNK = 8  # bits
#: Fingerprints of one bucket that one task compares; more take the other way.
BUCKET = 16384
#: Buckets up to this size send out their links as they are.
SMALL = 32
#: Cost of a probe, in verified candidates.
PROBE = 4.0


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """A bit is set if it is in over half of the shingles' hashes."""
    hashes: list[int] = []
    counts = []
    xx = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode().lower().split()
        n = max(len(words) - shingle + 1, min(len(words), 1))
        counts.append(n)
        if n:
            whole = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            end = np.cumsum(size) - 1
            start = (end - size + 1)[:n].tolist()
            stop = end[len(words) - n :].tolist()
            hashes += [xx(whole[a:b], SEED) for a, b in zip(start, stop)]
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(n) - n)[full]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little")
        out[full] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k_id, k_text, fp) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                fp = fingerprints_of(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], ["k_id", "k_text", "fp"])

    src = df.select(*row_key(id_col, text_col), column(text_col).cast("string").alias("text"))
    return src.mapInArrow(work, "k_id long, k_text long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def chunks_of(fps: DataFrame) -> list[list[int]]:
    """Eight chunks of eight bits each, correlated bits together, from counts over all fingerprints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        n = 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().astype(np.int64)).astype(np.float32)
            for k in range(0, len(bits), 1 << 16):
                total += (own := bits[k : k + (1 << 16)]).T @ own
            n += len(bits)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    # 4,097 sums, whatever the number of fingerprints.
    rows = fps.select("fp").mapInArrow(work, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(4097)
    for r in rows:
        cells[r["cell"]] = r["n"]
    n = max(cells[-1], 1)
    both = cells[:-1].reshape(64, 64) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both - np.outer(p, p)) / np.outer(spread, spread))
    left, out = set(range(64)), []
    while left:
        group = [max(left, key=lambda b: (sum(near[b, c] for c in left if c != b), -b))]
        left.discard(group[0])
        while len(group) < CHUNK:
            best = max(left, key=lambda b: (sum(near[b, c] for c in group), -b))
            group.append(best)
            left.discard(best)
        out.append(group)
    return out


def _chunk_values(bits: np.ndarray, chunks: list[list[int]]) -> np.ndarray:
    weight = 1 << np.arange(CHUNK)
    return np.stack([bits[:, c].astype(np.int64) @ weight for c in chunks], axis=1)


def histograms(fps: DataFrame, chunks: list[list[int]]) -> np.ndarray:
    """How many fingerprints hold each value of each chunk: eight tables of 256 counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(chunks) << CHUNK, np.int64)
        for batch in batches:
            v = _chunk_values(_bits(batch.column(0).to_numpy().astype(np.int64)), chunks)
            total += np.bincount((v + (np.arange(len(chunks)) << CHUNK)).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "n"])

    out = np.zeros(len(chunks) << CHUNK)
    for r in fps.select("fp").mapInArrow(work, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(len(chunks), 1 << CHUNK)


class Plan:
    """Partitions, and what is needed to allocate thresholds and to name probes."""

    def __init__(self, chunks: list[list[int]], counts: np.ndarray, most: int):
        self.chunks, self.most = chunks, most
        self.n = max(counts[0].sum(), 1.0)
        parts = int(min(max(round(64 / max(log2(self.n), 1)), 2), 8))
        self.parts = [list(x) for x in np.array_split(np.arange(len(chunks)), parts)]
        self.width = [CHUNK * len(p) for p in self.parts]
        apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        # share[c, v, d]: the part of all fingerprints whose chunk c is d bits from v.
        self.share = np.stack([[row @ (apart == d) for d in range(CHUNK + 1)] for row in counts]).transpose(0, 2, 1) / self.n
        self.flips = [
            [np.array([sum(1 << b for b in c) for c in combinations(range(w), r)], np.int64) for r in range(min(most, w) + 1)]
            for w in self.width
        ]

    def values(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunk = _chunk_values(_bits(fp), self.chunks)
        own = [sum(chunk[:, c] << (CHUNK * k) for k, c in enumerate(p)) for p in self.parts]
        return chunk, np.stack(own, axis=1)

    def thresholds(self, chunk: np.ndarray) -> np.ndarray:
        """t of each fingerprint and partition, adding up to ``most`` + 1, at the least expected cost."""
        n, budget = len(chunk), self.most + 1
        best = np.full((n, budget + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for i, p in enumerate(self.parts):
            dist = np.zeros((n, budget))
            dist[:, 0] = 1
            for c in p:  # distances of independent chunks add up
                own = self.share[c, chunk[:, c]]
                dist = np.stack([sum(dist[:, d - e] * own[:, e] for e in range(min(d, CHUNK) + 1)) for d in range(budget)], axis=1)
            found = np.cumsum(dist, axis=1) * self.n
            probes = np.cumsum([comb(self.width[i], r) for r in range(budget)])
            cost = np.concatenate([np.zeros((n, 1)), found + PROBE * probes], axis=1)
            trial = np.stack([
                np.stack([best[:, s - t] + cost[:, t] if t <= s else np.full(n, np.inf) for t in range(budget + 1)], axis=1)
                for s in range(budget + 1)
            ], axis=1)
            picks.append(trial.argmin(axis=2))
            best = trial.min(axis=2)
        out = np.zeros((n, len(self.parts)), np.int64)
        left = np.full(n, budget)
        for i in range(len(self.parts) - 1, -1, -1):
            out[:, i] = picks[i][np.arange(n), left]
            left = left - out[:, i]
        return out

    def entries(self, fp: np.ndarray) -> tuple[np.ndarray, ...]:
        """(part, value, probe, fp): where each fingerprint stands, and where it looks."""
        chunk, value = self.values(fp)
        t = self.thresholds(chunk)
        out = []
        for i in range(len(self.parts)):
            out.append((np.full(len(fp), i), value[:, i], np.zeros(len(fp), np.int64), fp))
            for r, flips in enumerate(self.flips[i]):
                rows = np.flatnonzero(t[:, i] > r)
                if len(rows):
                    v = (value[rows, i][:, None] ^ flips[None, :]).ravel()
                    out.append((np.full(len(v), i), v, np.ones(len(v), np.int64), np.repeat(fp[rows], len(flips))))
        return tuple(np.concatenate(x) for x in zip(*out))


def bucket_links(index: np.ndarray, probes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket from probes to smaller members: all if it is small, else a spanning forest."""
    index, probes = np.unique(index), np.unique(probes)
    a, b = [], []
    label = np.arange(len(index))
    place = np.searchsorted(index, probes)
    inside = (place < len(index)) & (index[np.minimum(place, len(index) - 1)] == probes)
    rows = max(1, (1 << 20) // len(index))
    for k in range(0, len(probes), rows):
        own = probes[k : k + rows]
        # Bits are counted of unsigned numbers; of signed ones numpy counts those of the absolute value.
        near = np.bitwise_count((own[:, None] ^ index[None, :]).view(np.uint64)) <= most
        near &= index[None, :] < own[:, None]
        if len(index) <= SMALL:
            q, x = np.nonzero(near)
            a.append(own[q])
            b.append(index[x])
            continue
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            met = np.flatnonzero(near[q])
            groups, first = np.unique(label[met], return_index=True)
            mine = label[place[k + q]] if inside[k + q] else -1
            for g, f in zip(groups.tolist(), first.tolist()):
                if g != mine:
                    a.append(own[q : q + 1])
                    b.append(index[met[f : f + 1]])
            if len(groups) > 1 or mine not in (-1, groups[0]):
                joined = set(groups.tolist()) | ({int(mine)} - {-1})
                label[np.isin(label, list(joined))] = min(joined)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fps(fp)`` that chains of links connect."""
    chunks = chunks_of(fps)
    plan = Plan(chunks, histograms(fps, chunks), most)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(np.int64)
            for k in range(0, len(fp), 2048):
                cols = plan.entries(fp[k : k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "value", "probe", "fp"])

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, value = plan.values(batch.column(0).to_numpy().astype(np.int64))
            part = np.tile(np.arange(value.shape[1]), len(value))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value.ravel())], ["part", "value"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group):
            fp, probe = np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group])
            index, probes = fp[probe == 0], fp[probe == 1]
            if not len(index) or not len(probes):
                return None
            a, b = bucket_links(index, probes, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

        held, key = [], None
        for batch in batches:
            part, value, probe, fp = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (value[1:] != value[:-1])) + 1
            edges = [0, *cuts.tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if key != (part[a], value[a]):
                    if held and (got := out(held)):
                        yield got
                    held, key = [], (part[a], value[a])
                held.append((fp[a:b], probe[a:b]))
        if held and (got := out(held)):
            yield got

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.array([sum(1 << b for b in c) for r in range(most // 2 + 1) for c in combinations(range(64), r)], np.uint64).view(np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy().astype(np.int64)
            for k in range(0, len(fp), 512):
                own = fp[k : k + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((own[:, None] ^ masks[None, :]).ravel()), pa.array(np.repeat(own, len(masks)))], ["middle", "fp"]
                )

    full = cut_lineage(
        fps.mapInArrow(stand, "part long, value long").groupBy("part", "value").agg(F.count("*").alias("n"))
        .where(F.col("n") > BUCKET).select("part", "value")
    )
    entries = fps.mapInArrow(spread, "part long, value long, probe long, fp long")
    crowded = full.limit(1).count() > 0
    if crowded and most % 2:
        raise ValueError("crowded buckets need an even distance")
    usual = entries.join(full, ["part", "value"], "left_anti") if crowded else entries
    order = ["part", "value"]
    found = usual.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")
    if not crowded:
        return found
    meet = cut_lineage(entries.join(full, order, "left_semi").select("fp").distinct().mapInArrow(middles, "middle long, fp long"))
    stars = meet.groupBy("middle").agg(F.min("fp").alias("b"))
    return found.union(meet.join(stars, "middle").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def grouped(df: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(k_id, k_text, fp, first): first is the smallest (k_id, k_text) of the row's group."""
    rows = cut_lineage(fingerprints(df, id_col, text_col))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min(F.struct("k_id", "k_text")).alias("least")))
    roots = connected(links(fps.select("fp"), most))
    known = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = cut_lineage(known)
    best = known.groupBy("root").agg(F.min("least").alias("first"))
    by_fp = cut_lineage(known.join(best, "root").select("fp", "first"))
    return rows.join(by_fp, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    rows = grouped(df, id_col, text_col, most)
    named = lambda c: F.when(c < LAST, c)
    return rows.select(
        named(F.col("k_id")).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        named(F.col("first.k_id")).alias("component_id"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each group the one with the smallest id stays."""
    kept = grouped(df, id_col, text_col, most).select("first.*").distinct()
    k_id, k_text = row_key(id_col, text_col)
    rows = df.select(*[column(c).alias(f"d_{i}") for i, c in enumerate(df.columns)], k_id, k_text)
    rows = rows.join(kept, ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"])
    return rows.select(*[F.col(f"d_{i}").alias(c) for i, c in enumerate(df.columns)])


@query("op6_simhash")
def simhash(t):
    return near_duplicates(t.documents)
