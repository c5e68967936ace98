"""Suffix-array dedup: bytes under a string of ``length`` bytes that starts a second time anywhere are cut.

The suffix array is sparse: it holds suffixes at anchors only. An anchor is the run of ``length // 3`` bytes whose
hash is the smallest among its neighbours, so equal strings have their anchors at equal places. Anchors are
dealt by range of their hash and streamed; a string whose anchors don't all occur twice can't repeat, which
drops most of the text. What is left of a document comes out as contexts: an anchor with all bytes of the
strings that have it as their main anchor. A task gets a range of anchors, a bounded number of contexts at a
time, and sorts the suffixes from the anchor on and, reversed, those that lead up to it, by deep-shallow sorting:
multikey quicksort over eight bytes at a time to a shallow depth, then blind tries, which look at branching bytes
only, for the groups that still share their prefix. Two strings are equal where they stand in one run of either
order, runs being cut where the common prefix is too short; so two sorted suffixes decide all strings of a context.

An anchor in a third of all texts spreads over many tasks. What a task can't decide alone, strings of its
first, last and overfull anchors without a partner, is settled by 128-bit hashes in an aggregate; equal
contexts leave a task twice at most. Equal texts are settled by their digest beforehand.

Defined cases: null texts are empty; shorter texts than ``length`` lose nothing and no partner stands in them; all
copies of a text that is long enough lose everything; ids may be null or repeat, each row being a text of its own;
what is kept is bytes, as cuts may fall inside a character. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import column, row_key, steps
from tidemark.llm.registry import query
from tidemark.llm.repeats import U64, Windows
from tidemark.session import cut_lineage

LENGTH = 200
#: Bytes of text hashed at a time; longer texts overlap by a string.
PIECE = 1 << 18
#: Contexts and context bytes that a task sorts together.
CHUNK = 8192
CHUNK_BYTES = 4 << 20
#: Words of eight bytes that multikey quicksort looks at.
SHALLOW = 2
#: Contexts a task remembers to have sent.
KNOWN = 1 << 19
SALTS = 16
LOW = (1 << 24) - 1


def anchor_size(length: int) -> int:
    return max(1, length // 3)


def places(length: int) -> tuple[int, int]:
    """Anchors that can start in a string, and how many of them compete to be one."""
    n = length - anchor_size(length) + 1
    return n, (n + 1) // 2


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` neighbours."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(U64).max, U64)
    full[: len(values)] = values
    block = full.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Segments:
    """Texts, or overlapping pieces of long ones, side by side with the hashes of the anchors they can hold."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.size = length, anchor_size(length)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        n = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(n) - n
        self.left = np.repeat((self.base + n).astype(np.int32), n) - np.arange(len(self.raw), dtype=np.int32)
        self.string = self.left >= length  # a whole string starts here
        #: Hashes of the anchors; those that reach into the next text lose to all others.
        self.key = np.full(len(self.raw), np.iinfo(U64).max, U64)
        count = max(0, len(self.raw) - self.size + 1)
        self.key[:count] = Windows(self.raw.astype(U64)).at(slice(0, count), self.size)
        self.value = (self.key & ~U64(LOW)) | np.arange(len(self.raw), dtype=U64)
        self.value[self.left < self.size] = np.iinfo(U64).max

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, at, "right") - 1

    def chosen(self, width: int) -> np.ndarray:
        """Where the smallest of ``width`` neighbours is, for each place; only valid inside a text."""
        out = np.zeros(len(self.raw), np.int64)
        if len(self.raw) >= width:
            got = (smallest(self.value, width) & U64(LOW)).astype(np.int64)
            out[: len(got)] = got
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors, and the first and last string that hold the neighbours that each wins over."""
        n, width = places(self.length)
        runs = np.flatnonzero(self.left >= self.size + width - 1)
        won = self.chosen(width)[runs]
        first = np.flatnonzero(np.r_[True, (won[1:] != won[:-1]) | (runs[1:] != runs[:-1] + 1)])
        last = np.r_[first[1:], len(runs)] - 1
        return won[first], np.maximum(runs[first] - (n - width), self.base[self.text_of(won[first])]), runs[last]


def segments(texts: list[bytes], length: int) -> Iterator[tuple[Segments, list[int], list[int]]]:
    """Groups of texts of bounded size, with the number of each text and where its piece begins in it."""
    held, who, at, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, max(len(t) - length + 1, 1), PIECE):
            part = t[a : a + PIECE + length - 1]
            if held and size + len(part) > PIECE + length:
                yield Segments(held, length), who, at
                held, who, at, size = [], [], [], 0
            held.append(part)
            who.append(i)
            at.append(a)
            size += len(part)
    if held:
        yield Segments(held, length), who, at


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc, pos) of the anchors of texts; doc is the hash of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "raw"):
                doc = part.column(0).to_numpy(zero_copy_only=False)
                for s, who, start in segments(part.column(1).to_pylist(), length):
                    at, _, _ = s.anchors()
                    seg = s.text_of(at)
                    pos = at - s.base[seg] + np.array(start, np.int64)[seg]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.key[at].view(np.int64)), pa.array(doc[np.array(who)[seg]]), pa.array(pos)], ["key", "doc", "pos"]
                    )

    return docs.select("k_text", "raw").mapInArrow(work, "key long, doc long, pos long")


def repeated(rows: DataFrame) -> DataFrame:
    """(doc, pos) of rows (key, doc, pos) whose key stands in two places; keys at the edge of a task are kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = None  # a key whose rows pass: the first of the task, or one with two places
        one = None  # the only place so far of the last key
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if one is not None:
                cols = [np.r_[np.int64(a), c] for a, c in zip(one, cols)]
            key, doc, pos = cols
            if sure is None:
                sure = key[0]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]
            key, doc, pos = key[fresh], doc[fresh], pos[fresh]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            many = (size > 1) | (key[first] == sure)
            keep = np.repeat(many, size)
            if many[-1]:
                sure, one = key[-1], None
            else:
                one = (key[-1], doc[-1], pos[-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep])], ["doc", "pos"])
        if one is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in one[1:]], ["doc", "pos"])

    order = ["key", "doc", "pos"]
    return rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, "doc long, pos long")


CONTEXT = "key long, d1 long, d2 long, k_id long, k_text long, start long, off int, body binary"


def contexts(near: DataFrame, length: int) -> DataFrame:
    """Anchors with the strings around them, from texts with the places ``at`` of their repeated anchors.

    start is where the body begins in its text, off where the anchor begins in the body; (d1, d2) is the digest of
    the body, which is null where the task has sent it twice.
    """
    n, _ = places(length)
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for batch in batches:
            for part in steps(batch, "raw"):
                texts, known = part.column(2).to_pylist(), part.column(3).to_pylist()
                ids = [part.column(i).to_pylist() for i in (0, 1)]
                for s, who, begin in segments(texts, length):
                    at, low, high = s.anchors()
                    ok = np.zeros(len(s.raw), bool)
                    for i, (doc, a) in enumerate(zip(who, begin)):
                        own = np.asarray(known[doc], np.int64) - a
                        end = (s.base[i + 1] if i + 1 < len(who) else len(s.raw)) - s.base[i]
                        ok[s.base[i] + own[(own >= 0) & (own < end)]] = True
                    # A string with an anchor that stands nowhere else can't repeat.
                    edge = np.zeros(len(s.raw) + 1, np.int32)
                    np.add.at(edge, low[~ok[at]], 1)
                    np.add.at(edge, high[~ok[at]] + 1, -1)
                    live = np.flatnonzero(s.string & (np.cumsum(edge)[:-1] == 0))
                    if not len(live):
                        continue
                    main = s.chosen(n)[live]
                    cut = np.flatnonzero(np.r_[True, (main[1:] != main[:-1]) | (live[1:] != live[:-1] + 1)])
                    ends = np.r_[cut[1:], len(live)] - 1
                    raw = s.raw.tobytes()
                    out = []
                    for a, b in zip(live[cut].tolist(), live[ends].tolist()):
                        body = raw[a : b + length]
                        digest = xxhash.xxh3_128_digest(body)
                        times = sent.get(digest, 0)
                        sent[digest] = times + 1
                        out.append((digest, body if times < 2 else None))
                    if len(sent) > KNOWN:
                        sent.clear()
                    seg = s.text_of(live[cut])
                    two = np.frombuffer(b"".join(d for d, _ in out), np.int64).reshape(-1, 2)
                    cols = [
                        s.key[main[cut]].view(np.int64), two[:, 0], two[:, 1], [ids[0][who[i]] for i in seg], [ids[1][who[i]] for i in seg],
                        live[cut] - s.base[seg] + np.array(begin, np.int64)[seg], main[cut] - live[cut], [b for _, b in out],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return near.select("k_id", "k_text", "raw", "at").mapInArrow(work, CONTEXT)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings by their branching bytes alone; one comparison a string finds where it belongs."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: tuple[int, dict] | list[int] | None = None

    def _leaf(self, node) -> list[int]:
        while isinstance(node, tuple):
            node = next(iter(node[1].values()))
        return node

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            found = node[1].get(s[node[0]] if node[0] < len(s) else -1)
            if found is None:
                break
            node = found
        leaf = self._leaf(node)
        t = self.strings[leaf[0]]
        if s == t:
            leaf.append(i)
            return
        depth = common(s, t)
        mine, other = (x[depth] if depth < len(x) else -1 for x in (s, t))
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][mine] = [i]
            return
        new = (depth, {other: node, mine: [i]})
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; 0 for the first."""
        stack: list = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, tuple):
                kids = [node[1][c] for c in sorted(node[1])]
                stack += [(kid, node[0]) for kid in reversed(kids[1:])]
                stack.append((kids[0], lcp))
            else:
                for k, i in enumerate(node):
                    yield i, lcp if k == 0 else len(self.strings[i])


def sorted_suffixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings and the common prefix of each with the one before: deep-shallow sorting."""
    width = 8 * SHALLOW
    words = np.frombuffer(b"".join([s[:width].ljust(width, b"\0") for s in strings]), ">u8").reshape(-1, SHALLOW).T.tolist()
    order: list[int] = []
    lcps: list[int] = []

    def put(i: int, lcp: int | None = None) -> None:
        if lcp is None:
            lcp = common(strings[order[-1]], strings[i]) if order else 0
        order.append(i)
        lcps.append(lcp)

    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) == 1:
            put(items[0])
        elif items and depth == SHALLOW:
            trie = BlindTrie(strings)
            for i in items:
                trie.add(i)
            for k, (i, lcp) in enumerate(trie.ordered()):
                put(i, lcp if k else None)
        elif items:
            c = words[depth]
            pivot = sorted((c[items[0]], c[items[len(items) // 2]], c[items[-1]]))[1]
            stack.append(([i for i in items if c[i] > pivot], depth))
            stack.append(([i for i in items if c[i] == pivot], depth + 1))
            stack.append(([i for i in items if c[i] < pivot], depth))
    return order, lcps


def partners(bodies: list[bytes], offs: list[int], twice: list[bool], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each distance from string to anchor: (contexts, string in each, whether it repeats, whether it is the first of its kind)."""
    n, _ = places(length)
    size = anchor_size(length)
    m = len(bodies)
    off = np.array(offs)
    last = off - (np.array([len(b) for b in bodies]) - length)
    right = sorted_suffixes([b[o:] for b, o in zip(bodies, offs)])
    left = sorted_suffixes([b[: o + size][::-1] for b, o in zip(bodies, offs)])
    orders = [(np.array(order), np.array(lcps)) for order, lcps in (right, left)]
    weight = np.array(twice, np.int64) + 1
    for lead in range(n):
        who = np.flatnonzero((off >= lead) & (last <= lead))
        if not len(who):
            continue
        kind = np.zeros(m, np.int64)
        for (order, lcps), depth in zip(orders, (length - lead, size + lead)):
            run = np.empty(m, np.int64)
            run[order] = np.cumsum(lcps < depth)
            kind = kind * (m + 1) + run
        _, first, back = np.unique(kind[who], return_index=True, return_inverse=True)
        total = np.bincount(back, weight[who])
        lead_of = np.zeros(len(who), bool)
        lead_of[first] = True
        yield who, off[who] - lead, total[back] > 1, lead_of


def strings_of(rows: DataFrame, length: int) -> DataFrame:
    """(kind, d1, d2, a, b, w1, w2) from contexts (key, d1, d2, off, body).

    kind 0: the strings a to b of the body with digest (d1, d2) repeat. kind 1: the string a, of hash (w1, w2),
    has no partner in its task but may have one in others; kind 2: some string of that hash that repeats anyway.
    """
    names = ["kind", "d1", "d2", "a", "b", "w1", "w2"]
    kinds = [pa.int32(), *[pa.int64()] * 2, *[pa.int32()] * 2, *[pa.int64()] * 2]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    def settle(chunk: list[tuple], doubt: set[int]) -> pa.RecordBatch:
        """chunk: (key, d1, d2, off, body, twice), each body once."""
        out, sort, at = [], [], 0
        while at < len(chunk):
            end = at
            while end < len(chunk) and chunk[end][0] == chunk[at][0]:
                end += 1
            group = chunk[at:end]
            if chunk[at][0] in doubt or (len(group) > 1 and not all(c[5] for c in group)):
                sort += group
            else:
                out += [(0, c[1], c[2], 0, len(c[4]) - length, None, None) for c in group if c[5]]
            at = end
        if sort:
            unsure = np.array([c[0] in doubt for c in sort])
            hits = [np.zeros(len(c[4]) - length + 1, bool) for c in sort]
            for who, string, again, lead in partners([c[4] for c in sort], [c[3] for c in sort], [c[5] for c in sort], length):
                for i, a in zip(who[again].tolist(), string[again].tolist()):
                    hits[i][a] = True
                ask = unsure[who] & lead
                for i, a, r in zip(who[ask].tolist(), string[ask].tolist(), again[ask].tolist()):
                    c = sort[i]
                    w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(c[4][a : a + length]), np.int64).tolist()
                    out.append((2 if r else 1, c[1], c[2], a, a, w1, w2))
            for c, hit in zip(sort, hits):
                edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).reshape(-1, 2)
                out += [(0, c[1], c[2], a, b - 1, None, None) for a, b in edge.tolist()]
        return batch_of(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubt: set[int] = set()
        chunk: list[tuple] = []
        size, seen = 0, False
        for batch in batches:
            for key, d1, d2, off, body in zip(*[c.to_pylist() for c in batch.columns]):
                if not seen:
                    seen = True
                    doubt.add(key)  # the first key of a task may go on before it
                if chunk and chunk[-1][:3] == (key, d1, d2):
                    chunk[-1] = (*chunk[-1][:5], True)
                    continue
                if len(chunk) >= CHUNK or size >= CHUNK_BYTES:
                    # Cut before the last key if there is another; else that key is in doubt from here on.
                    cut = next((i + 1 for i in range(len(chunk) - 1, -1, -1) if chunk[i][0] != chunk[-1][0]), 0)
                    if cut and chunk[-1][0] == key:
                        done, chunk = chunk[:cut], chunk[cut:]
                    else:
                        if chunk[-1][0] == key:
                            doubt.add(key)
                        done, chunk = chunk, []
                    yield settle(done, doubt)
                    doubt &= {key}
                    size = sum(len(c[4]) for c in chunk)
                chunk.append((key, d1, d2, off, body, False))
                size += len(body)
        if chunk:
            doubt.add(chunk[-1][0])  # and the last one after it
            yield settle(chunk, doubt)

    order = ["key", "d1", "d2"]
    return rows.select(*order, "off", "body").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        work, "kind int, d1 long, d2 long, a int, b int, w1 long, w2 long"
    )


def _cut(near: DataFrame, length: int) -> DataFrame:
    """What goes from texts with the places ``runs`` (a, b) where repeated strings start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "raw"):
                gone, spans, whole, kept = [], [], [], []
                for raw, runs in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    edge = np.zeros(len(raw) + 1, np.int32)
                    for r in runs:
                        edge[r["a"]] += 1
                        edge[r["b"] + length] -= 1
                    mask = np.cumsum(edge)[:-1] > 0
                    ends = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0])).reshape(-1, 2).tolist()
                    left = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                    gone.append(int(mask.sum()))
                    spans.append([{"start": a, "stop": b} for a, b in ends])
                    whole.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
                span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(whole), pa.array(kept, pa.binary())],
                    ["c_id", "c_text", "c_gone", "c_spans", "c_whole", "c_kept"],
                )

    return near.select("k_id", "k_text", "raw", "runs").mapInArrow(
        work, "c_id long, c_text long, c_gone long, c_spans array<struct<start long, stop long>>, c_whole string, c_kept binary"
    )


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) of each row; with ``kept`` also the bytes that stay.

    spans are the removed runs, start included, stop not.
    """
    k_id, k_text = row_key(id_col, text_col)
    raw = F.coalesce(column(text_col).cast("string").cast("binary"), F.lit(b""))
    docs = df.select(k_id, k_text, raw.alias("raw"))
    narrow = cut_lineage(df.select(
        column(id_col).alias(id_col), k_id, k_text, F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"),
    ).withColumn("salt", F.pmod(F.xxhash64("k_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")))
    # Copies by digest. The table is dealt over salts, so that a large group of copies is many tasks.
    copies = narrow.groupBy("whole").agg(F.count("*").alias("n"), F.min("k_id").alias("low")).where("n > 1")
    copies = cut_lineage(copies.select(F.col("whole").alias("w"), "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")))
    narrow = narrow.join(copies, (F.col("whole") == F.col("w")) & (F.col("salt") == F.col("s")), "left").drop("w", "s", "salt")
    narrow = cut_lineage(narrow)
    one = narrow.where((F.col("n_bytes") >= length) & (F.col("low").isNull() | (F.col("low") == F.col("k_id")))).select("k_id", "k_text")
    near = repeated(anchors(docs.where(F.octet_length("raw") >= length), length))
    near = near.groupBy(F.col("doc").alias("k_text")).agg(F.collect_list("pos").alias("at")).join(one.distinct(), "k_text")
    near = cut_lineage(docs.join(near, ["k_id", "k_text"]))
    found = cut_lineage(contexts(near, length))
    marks = cut_lineage(strings_of(found.where("body is not null"), length))
    pairs = marks.where("kind > 0").groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    late = marks.where("kind = 1").join(pairs, ["w1", "w2"]).select("d1", "d2", "a", "b")
    sure = cut_lineage(marks.where("kind = 0").select("d1", "d2", "a", "b").union(late).distinct())
    runs = found.select("d1", "d2", "k_id", "k_text", "start").join(sure, ["d1", "d2"])
    runs = runs.groupBy("k_id", "k_text").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("runs"))
    done = _cut(near.drop("at").join(runs, ["k_id", "k_text"]), length)
    done = (done if kept else done.drop("c_kept")).dropDuplicates(["c_id", "c_text"])
    full = narrow.join(done, (F.col("k_id") == F.col("c_id")) & (F.col("k_text") == F.col("c_text")), "left")
    copy = F.col("low").isNotNull() & (F.col("n_bytes") >= length)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    out = [
        column(id_col), F.col("n_bytes"),
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("c_gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, everything).otherwise(F.coalesce("c_spans", nothing)).alias("spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("c_whole", "whole")).alias("kept_sha256"),
    ]
    if not kept:
        return full.select(*out)
    texts = docs.withColumnsRenamed({"k_id": "t_id", "k_text": "t_text"}).dropDuplicates(["t_id", "t_text"])
    full = full.join(texts, (F.col("k_id") == F.col("t_id")) & (F.col("k_text") == F.col("t_text")))
    return full.select(*out, F.when(copy, F.lit(b"")).otherwise(F.coalesce("c_kept", "raw")).alias("kept"))


@query(
    "op13_suffix_array",
    """
    WITH docs AS (
      SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
    ), starts AS (
      SELECT row, i, md5(x[2 * i + 1 : 2 * i + 400]) AS h FROM (SELECT row, x, unnest(generate_series(0, n - 200)) AS i FROM docs WHERE n >= 200)
    ), again AS (
      SELECT h FROM starts GROUP BY h HAVING count(*) > 1
    ), hits AS (
      SELECT row, i FROM starts SEMI JOIN again USING (h)
    ), edges AS (
      SELECT row, i, coalesce(i - lag(i) OVER w > 200, true) AS fresh FROM hits WINDOW w AS (PARTITION BY row ORDER BY i)
    ), spans AS (
      SELECT row, min(i) AS a, max(i) + 200 AS b
      FROM (SELECT row, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY row ORDER BY i) AS span FROM edges) GROUP BY row, span
    ), gaps AS (
      SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS before FROM spans
    ), kept AS (
      SELECT row, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) || any_value(x[2 * last + 1 :]) AS x,
        CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
      FROM (SELECT row, a, b, before, x, max(b) OVER (PARTITION BY row) AS last FROM gaps JOIN docs USING (row)) GROUP BY row
    )
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
    FROM docs d LEFT JOIN kept k USING (row)
    """,
)
def suffix_array(t):
    return repeated_bytes(t.documents).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
