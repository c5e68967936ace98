"""Suffix-array dedup against every string of every text."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffixes


def brute(rows, length):
    seen = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for p in range(len(raw) - length + 1):
            k = raw[p : p + length]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, raw in raws:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans, left = [], bytes(b for b, g in zip(raw, gone) if not g)
        for p, g in enumerate(gone):
            if g and (p == 0 or not gone[p - 1]):
                spans.append([p, p])
            if g:
                spans[-1][1] = p + 1
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest(), left))
    return sorted(out, key=repr)


def texts(length, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    base = word(40 * length)
    rows = [(i, word(rng.randrange(6 * length))) for i in range(30)]
    for i in range(30, 110):
        a = rng.randrange(30 * length)
        piece = base[a : a + rng.randrange(length // 2, 5 * length)]
        if rng.random() < 0.7:  # a near copy
            for _ in range(rng.randrange(4)):
                p = rng.randrange(len(piece))
                piece = piece[:p] + word(3) + piece[p + 2 :]
        rows.append((i, word(rng.randrange(length)) + piece + word(rng.randrange(length))))
    hot = base[: 3 * length]
    for i in range(110, 190):
        p = rng.randrange(len(hot))
        rows.append((i, word(3) + hot[:p] + word(1) + hot[p:]))
    copy = base[5 * length : 9 * length]
    rows += [(i, copy) for i in range(200, 206)] + [(200, copy), (None, copy), (None, copy), (None, None), (210, None), (211, "")]
    rows += [(212, "a" * (length - 1)), (213, "a" * (length - 1)), (214, "a" * (3 * length)), (215, "ab" * (2 * length)), (216, "ba" * length)]
    rows += [(217, word(4 * length) * 2), (218, copy[: 2 * length]), (218, copy[length:]), (219, "\0" * length + copy[: length + 1])]
    return rows


@pytest.mark.parametrize("length, sizes", [
    (20, {}), (33, {"CHUNK": 5, "KNOWN": 3}), (20, {"PIECE": 64, "CHUNK_BYTES": 300}), (7, {"CHUNK": 2, "SALTS": 1}), (200, {}), (2, {}),
])
def test_cuts_match_brute_force(docs, monkeypatch, length, sizes):
    for name, v in sizes.items():
        monkeypatch.setattr(suffixes, name, v)
    rows = texts(length, length)
    got = suffixes.repeated_bytes(docs(rows).repartition(7), length=length, kept=True)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
    got = [(*r[:3], [[s["start"], s["stop"]] for s in r["spans"]], r["kept_sha256"], bytes(r["kept"])) for r in got.collect()]
    assert sorted(got, key=repr) == brute(rows, length)


def test_long_texts_and_empty_tables(docs):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(50_000))
    rows = [(1, long), (2, "x" + long[20_000:20_400] + "y"), (3, "z" * 300_000), (4, long[:199])]
    got = {r["doc_id"]: (r["n_removed"], len(r["spans"])) for r in suffixes.repeated_bytes(docs(rows)).collect()}
    assert got == {1: (400, 1), 2: (400, 1), 3: (300_000, 1), 4: (0, 0)}
    assert suffixes.repeated_bytes(docs(rows).limit(0)).count() == 0
    assert suffixes.repeated_bytes(docs([(1, None), (2, "short")])).count() == 2


def test_deep_shallow_order_and_prefixes():
    rng = random.Random(4)
    for alphabet in (b"ab", b"abcdefgh\0"):
        shared = bytes(rng.choice(alphabet) for _ in range(40))
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(150)]
        strings += [shared[: rng.randrange(41)] + bytes(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(150)]
        strings += strings[::7]
        order, lcps = suffixes.sorted_suffixes(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert lcps == [0] + [suffixes.common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_smallest_of_neighbours():
    v = np.random.default_rng(2).integers(0, 50, 97).astype(np.uint64)
    for width in (1, 2, 7, 69, 97):
        assert suffixes.smallest(v, width).tolist() == [min(v[i : i + width]) for i in range(97 - width + 1)]
