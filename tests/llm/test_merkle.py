"""Merkle manifest against a plain recursion over lists."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    return h(enc(row[c]) for c in merkle.COLUMNS)


def tree(leaves):
    """(root, list of the siblings of each leaf)"""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(proofs):
            a = at[i] // 3 * 3
            p += [x for j, x in enumerate(level[a : a + 3], a) if j != at[i]]
        level, at = [h(level[i : i + 3]) for i in range(0, len(level), 3)], [a // 3 for a in at]
    return level[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, roots = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        root, proofs = tree([leaf_of(r) for r in own])
        roots.append(root)
        out += [(r["doc_id"], leaf_of(r), root, p, len(roots) - 1) for r, p in zip(own, proofs)]
    if not roots:
        return []
    root, tops = tree(roots)
    return sorted([(i, x, sub, root, h([*p, *tops[k]])) for i, x, sub, p, k in out], key=repr)


@pytest.fixture
def rows(docs):
    rng = random.Random(3)
    made = [(i, f"text {i}\nü", rng.choice(["a", "b", "ß", None, "", "hot", "hot", "hot"])) for i in range(150)]
    made += [(7, "text 7\nü", "hot"), (7, "other", "hot"), (None, "x", "hot"), (None, None, None), (200, None, "alone"), (201, "", "a")]
    return docs(made + [(9, "same", "hot")] * 4)


@pytest.mark.parametrize("rise, span", [(1, 1), (2, 5), (merkle.RISE, merkle.SPAN)])
def test_proofs_match_brute_force(rows, rise, span):
    m = merkle.manifest(rows, rise=rise)
    got = merkle.prove(m, span=span)
    folded = merkle.fold(F.col("leaf"), F.col("steps"))
    got = got.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("p"), (folded == F.col("root")).alias("ok")).collect()
    assert all(r["ok"] for r in got)
    assert sorted([tuple(r)[:5] for r in got], key=repr) == brute([r.asDict() for r in rows.collect()])
    tops = {r["hash"] for r in m.roots().where(f"tree = {merkle.TOP}").collect()}
    assert tops == {got[0]["root"]}


def test_some_rows_and_a_changed_leaf(rows):
    m = merkle.manifest(rows, more={"wrong": merkle.leaf([F.col("text")])}, rise=2)
    some = m.leaves.where("id % 11 = 3")
    got = merkle.prove(m, some, span=40).withColumn("bad", merkle.fold(F.col("wrong"), F.col("steps"))).collect()
    assert len(got) == some.count() > 5
    want = {(r[0], r[1]): r[3] for r in brute([r.asDict() for r in rows.collect()])}
    assert all(r["root"] == want[r["id"], r["leaf"]] != r["bad"] for r in got)


def test_missing_coordinates_are_the_smallest_union():
    gaps = merkle.missing(np.array([1, 2, 9]), 14)
    assert [g.tolist() for g in gaps] == [[0, 10, 11], [1, 2, 4], []]
    assert [g.tolist() for g in merkle.missing(np.arange(14), 14)] == [[], [], []]
    assert merkle.missing(np.array([0]), 1) == []


def test_small_and_empty_tables(docs):
    assert merkle.prove(merkle.manifest(docs([(1, "a")]).limit(0))).count() == 0
    one = docs([(1, "a" * 300_000)])
    r = merkle.prove(merkle.manifest(one)).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["steps"] == []


def test_query_marks_exactly_the_texts_that_changed(spark, folder):
    from tidemark.llm.queries import QUERIES
    from tidemark.sources.tables import Tables

    texts = {r["doc_id"]: r["text"] for r in Tables(spark, folder).documents.collect()}
    got = {r["doc_id"]: r["verified"] for r in QUERIES["op11_merkle"](spark, folder).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 2 == 1 or "\n" not in (t or "") for i, t in texts.items()}
    assert len(set(got.values())) == 2
