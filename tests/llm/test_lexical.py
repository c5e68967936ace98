"""Lexical search against a plain loop over all pairs of items and documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            s = 0
            for t in set(terms(text)):
                if b[t]:
                    m = 100 - 50 + (50 * sum(b.values()) * n_docs) // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture
def tables(docs, spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(60)] + ["Ärger", "ärger", "日本", "x" * 70, "X" * 71, "a_b", "don't", " ", "Ⅷ"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "... \n\x85"), (203, "w1 " * 5000), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    rows += [(204 + i, "w1 w2 w3") for i in range(6)] + [(204, "w1 w2 w3")]
    asked = [(i, text(rng.randrange(1, 12))) for i in range(25)]
    asked += [(3, "w1 w2"), (3, "w1 w2"), (None, "w3 w3 W3"), (50, None), (51, "nowhere"), (52, " ".join(pool))]
    return docs(rows), spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "'x' AS doc_id", "1 AS row", "'y' AS terms"), rows, asked


@pytest.mark.parametrize("sizes", [{}, {"ITEMS": 7, "BLOCK": 3, "TERMS": 4, "DOCS": 8, "PIECE": 16}, {"ENTRIES": 20, "BLOCK": 2, "DOCS": 1}])
def test_ranks_match_brute_force(tables, monkeypatch, sizes):
    for name, v in sizes.items():
        monkeypatch.setattr(lexical, name, v)
    docs, items, rows, asked = tables
    got = lexical.search(docs.repartition(5), items, k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(rows, asked, 7)


def test_empty_tables(tables):
    docs, items, _, _ = tables
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id in (200, 201)"), items).count() == 0


def test_partial_sums_and_scores_stay_in_range():
    weights = np.array([(1 << 53) // lexical.MOST // 3] * 10)
    block = lexical.ItemBlock([0], [np.arange(10)], weights, 5, 100)
    assert block.width == 3 and len(block.tiles) == 4
    got = block.scores(np.zeros(10, np.int64), np.arange(10), np.full(10, lexical.MOST - 1), 1)
    assert got[0, 0] == 10 * int(weights[0]) * (lexical.MOST - 1)
    with pytest.raises(OverflowError):
        lexical.ItemBlock([0], [np.arange(10)], weights * 1000, 5, 100)
