"""The pipeline on a small table: each stage does its work, and the rows match what the parts give."""

import hashlib
import random

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import components
from tidemark.llm import bpe, mixing


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(12))
    shared = [line() for _ in range(3)]
    rows, labels = [], []
    for i in range(300):
        body = [line() for _ in range(6)]
        toxic = i % 10 == 0
        if toxic:
            body[2] += " you are a worthless moron"
        if i % 7 == 3:
            body[1:1] = shared
        labels.append((i, 1, int(toxic)))
        rows.append((i, "\n".join(body), "en", f"s{i % 4}", 0))
    rows += [(400 + k, rows[5][1], "en", "s9", 0) for k in range(5)] + [(500, None, "en", None, 0), (501, "", "en", None, 0)]
    rows += [(600, rows[1][1].rsplit(" ", 1)[0] + " changed", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = docs.collect()

    kept = {r["doc_id"]: r["text"] for r in at["toxicity"]}
    assert set(kept) == {r[0] for r in rows} - {i for i, _, t in labels if t}
    assert all(kept[r[0]] == r[1] for r in rows if r[0] in kept)

    seen, want = set(), {}
    for i in sorted(kept):
        own = [x for x in (kept[i] or "").split("\n") if x]
        gone = set()
        for p in range(len(own) - 2):
            w = tuple(own[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        want[i] = "\n".join(x for p, x in enumerate(own) if p not in gone) if kept[i] is not None else None
    cut = {r["doc_id"]: r["text"] for r in at["line_dedup"]}
    assert cut == want and cut[400] == "" and cut[10 * 7 + 3] != kept[73]
    assert all(r["n_chars"] == len(r["text"]) for r in at["line_dedup"] if r["text"] and r["text"] != kept[r["doc_id"]])

    groups = components(list(cut.items()))
    one = {r["doc_id"]: r["text"] for r in at["near_dedup"]}
    assert set(one) == {c for _, _, c in groups} and all(one[i] == cut[i] for i in one)

    plan = mixing.mix_plan(spark.read.parquet(f"{tmp_path}/near_dedup")).collect()
    copies = {r["m_id"]: r["m_copies"] for r in plan}
    mixed = [r["doc_id"] for r in at["mixing"]]
    assert all(mixed.count(i) == n for i, n in copies.items()) and len(mixed) == sum(copies.values())

    library = Tokenizer.from_file(bpe.word_bpe())
    expected = []
    for r in at["mixing"]:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted(tuple(r)[:3] for r in at["bpe"]) == sorted(expected)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, at["bpe"]))
