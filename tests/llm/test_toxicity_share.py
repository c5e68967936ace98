"""Scores mean the same whether or not the labelled sample is cut."""

import math
import random

from tidemark.llm import toxicity


def test_scores_hold_where_the_sample_is_capped(docs, spark, monkeypatch):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(3600):
        toxic = i % 9 == 0
        w = ["".join(rng.choice("aeioustrnlm") for _ in range(5)) for _ in range(30)]
        if rng.random() < (0.5 if toxic else 0.03):
            w[3] = "blargh"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, known = docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")

    def odds():
        g = toxicity.learn(df, known)
        return [math.log((p := g.score(g.match(t))) / (1 - p)) for t in ("a plain text", "one blargh here")]

    whole = odds()
    monkeypatch.setattr(toxicity, "SAMPLE", 320)  # about all toxic rows, an eighth of the clean ones
    cut = odds()
    assert abs(cut[0] - whole[0]) < 0.4 and abs(cut[1] - whole[1]) < 1.2
