"""Mixing, repeated words, repeated lines and near copies on small tables, against brute force."""

import hashlib
import random
import re

import xxhash

from tidemark.llm import lines, mixing, simhash, substrings
from tidemark.llm.repeats import covered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_difference_covers_hold_every_distance():
    for v in (3, 7, 13, 21, 31, 57):
        d = substrings.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def brute_substrings(rows, window):
    tokens = [(i, WORD.findall(t or "")) for i, t in rows]
    key = lambda i: (i is None, i)
    first = {}
    for i, w in tokens:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (True, None)), key(i), key=lambda x: (x[0], x[1] or 0))
    out = []
    for i, w in tokens:
        at = [p for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] != key(i)]
        gone = covered(len(w), at, window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def substring_rows():
    rng = random.Random(5)
    base = words(rng, 400, 10_000)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 120)))) for i in range(20)]
    for i in range(20, 50):
        a = rng.randrange(300)
        rows.append((i, " ".join(words(rng, rng.randrange(40)) + base[a : a + rng.randrange(30, 100)] + words(rng, rng.randrange(40)))))
    copy = " ".join(base[:90])
    rows += [(i, copy) for i in range(50, 60)] + [(60, None), (61, ""), (62, "\n\t "), (None, copy), (None, copy)]
    rows += [(70, " ".join(base[100:180])), (70, " ".join(base[100:180])), (70, " ".join(base[120:200]))]
    rows += [(71, "the " * 300), (72, "the " * 70), (3, "  ".join(base[:90]))]
    return rows


def test_substrings_match_brute_force(docs):
    rows = substring_rows()
    got = sorted([tuple(r) for r in substrings.substring_report(docs(rows)).collect()], key=repr)
    assert got == brute_substrings(rows, 50)


def test_substrings_keep_columns_and_take_empty_tables(docs):
    df = docs([(1, "x " * 60), (2, "x " * 60), (3, None)])
    got = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(df).collect()}
    assert got == {1: "x " * 60, 2: "", 3: None}
    assert substrings.dedup_substrings(df).columns == df.columns
    assert substrings.substring_report(df.limit(0)).count() == 0


def test_lines_cut_later_windows_only(docs):
    df = docs([
        (2, "a\nb\nc\nd\nnew"), (1, "a\nb\nc\nd"), (3, "x\n\na\n  \nb\nc\n\ny"), (4, "a\nb"), (5, None), (6, ""),
        (7, "q\nq\nq\nq\nq"), (8, "a\nb\nc"), (8, "a\nb\nc"), (None, "b\nc\nd"),
    ])
    got = sorted([(r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup_lines(df).collect()], key=repr)
    assert got == sorted([
        (1, 4, 0, "a\nb\nc\nd"), (2, 5, 4, "new"), (3, 5, 3, "x\n\n\ny"), (4, 2, 0, "a\nb"), (5, 0, 0, None), (6, 0, 0, ""),
        (7, 5, 4, "q"), (8, 3, 3, ""), (8, 3, 3, ""), (0, 3, 3, ""),
    ], key=repr)
    assert lines.dedup_lines(df).columns == [*df.columns, "n_lines", "n_removed"]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(rows))]
        if new == label:
            break
        label = new
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), lab in zip(rows, label) if lab == label[i] and d is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def near_rows():
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        base = words(rng, 150, 3000)
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"W{rng.randrange(9)}É"
            rows.append((len(rows) + 10, " ".join(own)))
    return rows + [(3, None), (4, ""), (5, " \n"), (6, "One two"), (7, "one TWO"), (None, rows[0][1]), (8, rows[5][1]), (8, rows[5][1])]


def test_near_duplicates_match_brute_force(docs):
    rows = near_rows()
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs(rows)).collect()], key=repr)
    assert got == components(rows)


def test_crowded_buckets_give_the_same_groups(docs, monkeypatch):
    rows = near_rows()
    monkeypatch.setattr(simhash, "BUCKET", 3)
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs(rows)).collect()], key=repr)
    assert got == components(rows)


def test_one_of_each_group_stays(docs):
    rows = near_rows()
    df = docs(rows)
    kept = simhash.keep_one(df)
    best = {c for _, _, c in components(rows)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(best)
    assert kept.columns == df.columns
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_bucket_links_connect_what_all_pairs_connect():
    import numpy as np

    rng = np.random.default_rng(2)
    center = rng.integers(-(2**62), 2**62)
    fp = np.unique([int(center) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 5))) for _ in range(300)]).astype(np.int64)
    a, b = simhash.bucket_links(fp, fp, 4)
    assert len(a) < len(fp)
    label = {int(x): int(x) for x in fp}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert ((x ^ y) & (2**64 - 1)).bit_count() <= 4
        label[max(root(x), root(y))] = min(root(x), root(y))
    for x in fp.tolist():
        for y in fp.tolist():
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4:
                assert root(x) == root(y)


def test_mix_reaches_targets(docs):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randrange(5, 40))), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(None, None, "a"), (9000, "", "e"), (1, "again", "b"), (1, "again", "b")]
    df = docs(rows)
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows)
    total = sum(r["m_size"] for r in plan)
    aims = {r["m_source"]: (r["m_source_size"], r["m_target"]) for r in plan}
    assert abs(sum(t for _, t in aims.values()) - 1.5 * total) < 1e-6 * total
    for source, (size, target) in aims.items():
        taken = sum(r["m_size"] * r["m_copies"] for r in plan if r["m_source"] == source)
        assert target <= 2 * size and abs(taken - target) <= 0.1 * target + 1
    assert all(0 <= r["m_copies"] <= 2 for r in plan)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["m_copies"] for r in plan)
    assert mixing.mix(df.limit(0)).count() == 0


def test_levels_of_targets(spark):
    sources = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    # 1.5 * 1,610 words by weights 5, 2, 1, 5, 2: a, c and d are full at 200, 20 and 0; the rest goes to b
    # and the null source by 2 : 2, but the latter is full at 1,000.
    assert got == {"a": 200, "b": 2415 - 220 - 1000, "c": 20, "d": 0, None: 1000}
