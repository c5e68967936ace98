"""Tokens, media, URLs, pages, toxicity and search on small tables, against brute force or the library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, html, media, topk, toxicity, urlfilter


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.word_bpe())
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts():
    rng = random.Random(1)
    letters = "abcdeinthornsaaa'sll d.,!?1234  éüßΣσÀ你好😀İ\n\x85\x1c가각ﬁ½²ⅷ᲏Ᲊ"
    out = [None, "", " ", "a" * 500, "ab" * 3000, "I'll don't 'S 'VE", "<|endoftext|>x<|startoftext|>", "ΑΣ ΟΔΟΣ.", "é É"]
    for _ in range(400):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        out.append(s + "<|endoftext|>" + s if rng.random() < 0.1 else s)
    return out


def test_tokens_equal_the_library(docs, library):
    rows = list(enumerate(odd_texts())) + [(None, "null id"), (7, "same id")]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.token_report(docs(rows), bpe.word_bpe()).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    assert got == want


def test_encoded_ids_decode(docs, library):
    df = docs([(1, "The quick brown foxes"), (2, None)])
    ids = bpe.encode(df, bpe.word_bpe())
    text = {r["doc_id"]: r["text"] for r in bpe.decode(ids, bpe.word_bpe()).collect()}
    assert text == {1: library.decode(library.encode("The quick brown foxes", add_special_tokens=False).ids), 2: ""}
    assert bpe.token_report(df.limit(0), bpe.word_bpe()).count() == 0


def test_words_of_vocabulary_pieces_equal_the_library(library):
    import json

    with open(bpe.word_bpe(), encoding="utf-8") as f:
        codec = bpe.Codec(json.load(f))
    rng, pieces = random.Random(4), list(library.get_vocab())
    for _ in range(3000):
        s = "".join(rng.choice(pieces).replace("</w>", "") for _ in range(rng.randrange(1, 5)))
        assert codec.encode(s) == library.encode(s, add_special_tokens=False).ids


def test_media_round_trip(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(media, "RANGE_BYTES", 700)
    rng = random.Random(2)
    rows = [(i, "".join(chr(rng.randrange(32, 900)) for _ in range(rng.randrange(900)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "x" * 64), (43, "x" * 300_000), (1, rows[1][1]), (None, "null")]
    got = sorted([tuple(r) for r in media.media_features(media.store_media(docs(rows), str(tmp_path / "a"))).collect()], key=repr)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        x = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        w = media.to_wav(x)
        assert media.from_wav(w) == x
        want.append((i, len(raw), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(w), hashlib.sha256(w).hexdigest(), media.feature(x)))
    assert got == sorted(want, key=repr)
    assert media.store_media(docs(rows).limit(0), str(tmp_path / "b")).count() == 0


def test_a_damaged_read_is_repeated_for_its_member(tmp_path):
    import zipfile

    from pyarrow import fs

    with zipfile.ZipFile(tmp_path / "m.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("0_1.wav", b"a" * 500)
        z.writestr("1_2.wav", b"b" * 500)
    entries = zipfile.ZipFile(tmp_path / "m.zip").infolist()
    fails = []

    class Flaky(media.Members):
        def _once(self, m):
            if m.filename == "1_2.wav" and len(fails) < 2:
                fails.append(m)
                raise OSError("lost")
            return super()._once(m)

    with Flaky(fs.LocalFileSystem(), str(tmp_path / "m.zip")) as source:
        assert [source.read(m) for m in entries] == [b"a" * 500, b"b" * 500]
    entries[0].CRC ^= 1
    with media.Members(fs.LocalFileSystem(), str(tmp_path / "m.zip")) as source, pytest.raises(ValueError):
        source.read(entries[0])


def test_url_rules(spark):
    urls = [
        (1, "http://WWW.Example.com/en/x?q"), (2, "https://example.com/en/"), (3, "https://notexample.com/en/"),
        (4, "ftp://a.net/es/1#f"), (5, "http://net/fr/"), (6, "x.org/no-scheme"), (7, None), (8, "http://a.com"),
        (9, "http://b.org/x.com/"), (10, "http://net.org/es/"), (11, "://com/"), (12, "http://m.www.example.com/en/"),
        (13, "http://a.net/" + "é" * 5000 + "/es/"), (1, "http://WWW.Example.com/en/x?q"), (None, "http://a.com/"),
    ]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("id", "host", "path", "rule")})
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df).collect()]
    rules = dict((r[0], r[2:]) for r in got)
    assert rules[1] == rules[12] == ("www.example.com/en/", "allow")
    assert rules[2] == ("example.com/en/", "block") and rules[3] == rules[11] == rules[None] == ("com/", "allow")
    assert rules[4] == ("net/es/", "block") and rules[5] == ("net/fr/", "block")
    assert {rules[i] for i in (6, 7, 8, 9, 10, 13)} == {(None, "allow")}
    assert len(got) == len(urls) and urlfilter.judge_urls(df.limit(0)).count() == 0


def test_globs_match_like_regular_expressions():
    import re

    rng = random.Random(6)
    for _ in range(60):
        rules = [
            urlfilter.Rule(rng.choice(["allow", "block"]), "".join(rng.choice("ab.*?") for _ in range(rng.randrange(1, 5))), "/" + "".join(rng.choice("ab*?/") for _ in range(rng.randrange(4))))
            for _ in range(rng.randrange(1, 40))
        ]
        machine = urlfilter.Automaton(rules)
        urls = ["." + "".join(rng.choice("ab.é") for _ in range(rng.randrange(1, 6))) + "/" + "".join(rng.choice("ab/é") for _ in range(rng.randrange(5))) for _ in range(40)]

        def pattern(r):
            host = re.escape("." + r.host).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            return re.compile("[^/]*" + host + re.escape(r.path).replace(r"\*", ".*").replace(r"\?", "."), re.S)

        want = [next((i for i, r in enumerate(machine.rules) if pattern(r).match(u)), -1) for u in urls]
        assert machine.best([u.encode() for u in urls]).tolist() == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<div class="top-menu"><a href=1>Home</a></div><div class="cookie-notice">We use cookies to make this site better for you and for all.</div>
<div id=content><h1>Great  heading</h1><p>This is the story of a man who was in the city and had to go to the sea, for it was the only
way that he could be with the one he loved &mdash; and so he went on and on, to the end of the world and back.<p>Short <b>b</b>it.</p>
<p>It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness, it was the
epoch of belief, it was the epoch of incredulity, it was the season of&nbsp;Light.</p></div>
<div class="comments"><p>I think that this is the best of the stories that you have on the site and it was good to read.</p></div>
<ul><li><a href=2>More stories here</a><li><a href=3>And some more</a></ul><form><p>Name <input></form><footer>(c)</footer>"""


def test_main_text_without_an_article_element():
    got = html.main_text(PAGE)
    assert got.startswith("Great heading This is the story of a man")
    assert "back. Short bit. It was the best" in got and got.endswith("the season of Light.")


def test_main_text_of_articles(spark):
    rows = [
        (1, "u", "<nav><a>x</a></nav><article><h1>H</h1><p>a &lt; b &amp; c<p>d<script>var t='</p>'</script></article><p>after"),
        (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut off <b"), (4, "u", "<article><p>cut off <b"),
        (5, "u", "<article>one<aside>two</aside> three<!-- x</article>"), (None, "u", "<main><p>zz" + "z" * 200_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "text": F.lit(2)})
    got = [tuple(r) for r in html.extract_text(df).collect()]
    texts = {r[0]: r[2] for r in got}
    assert texts[1] == "H a < b & c d" and texts[2] == texts[3] == "" and texts[4] == "cut off"
    assert texts[5] == "one three" and len(texts[None]) == 200_002
    assert all(n == len(t) for _, _, t, n in got) and len(got) == len(rows)
    assert html.extract_text(df.limit(0)).count() == 0


def test_clauses_are_told_apart():
    g = toxicity.Grammar()
    kinds = lambda text: {n: c for n, c in zip(toxicity.NAMES, g.match(text)) if c}
    assert kinds("You are an idiot. What a moron!") == {"strong_target": 1, "strong": 1}
    assert kinds("This is not an idiot.") == {"strong_negated": 1}
    assert kinds('He said: "idiot".')["strong_reported"] == 1
    assert kinds("I will kill you, and the rest") == {"threat_target": 1}
    assert kinds("kill the lights") == {} and kinds("") == {}
    s = lambda text: g.score(g.match(text))
    assert s("you idiot") > s("an idiot") > s("not an idiot") > s("fine") and s("fine") < 0.5 < s("an idiot")


def test_learned_terms_are_found_in_held_out_rows(docs, spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        w = [f"wort{rng.randrange(400)}x" if rng.random() < 0.1 else rng.choice("der und nicht ein the of and".split()) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            w[rng.randrange(60)] = "qwerg" + rng.choice(["a", "en", "ung", "lich"])
        rows.append((i, " ".join(f"{x}{chr(97 + rng.randrange(26))}" if x.startswith("wort") else x for x in w)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    df = docs([*rows, (None, None), (9999, "")])
    grammar = toxicity.learn(df, known)
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score_texts(df, grammar).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels)
    assert got[None] == got[9999] < 0.5
    assert toxicity.score_texts(df, grammar).columns == [*df.columns, "toxic_score"]
    plain = toxicity.learn(df.limit(0), known.limit(0))
    assert plain.strong == toxicity.INSULTS and toxicity.score_texts(df.limit(0), plain).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16)) * rng.choice([0.1, 1, 5], (400, 1))
    v[10:40] = v[50]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    bad = [(1000, None), (1050, [None] * 16), (1100, [float("nan")] * 16), (1150, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (1200, [1.0])]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "block": F.lit(3)})
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 50 = 0"), df).collect())
    ints = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows}
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 3)")
    assert [tuple(r)[:3] for r in topk.top_k(few.where("vec_id = 0"), few).collect()] == [(0, 1, 3)]


def test_top_k_refuses_what_leaves_64_bits(spark):
    make = lambda *v: spark.createDataFrame([(50 * i, list(x)) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for rows in (make([1e300, 1.0], [2.0, 1.0]), make([3e11, 1.0], [3e11, 1.0])):
        with pytest.raises(Exception, match="53 bits|64 bits"):
            topk.top_k(rows, rows).collect()
    fine = make([1e6, 1.0], [1e6, -1.0])
    assert [r.score for r in topk.top_k(fine, fine).orderBy("query_id").collect()] == [(256 * 10**6) ** 2 - 256**2] * 2


def test_no_vectors_are_broadcast(spark, monkeypatch):
    """Query blocks times index blocks must not meet in the driver: only numbers of blocks are broadcast, by a row a length."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = topk.top_k(df.where("vec_id % 5 = 0"), df)
    ints = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in rows}
    want = [(q, r + 1, i, -s) for q in ints if q % 5 == 0 for r, (s, i) in enumerate(sorted(
        (-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5])]
    assert sorted(tuple(r) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan()
    sent, left = [], [plan]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in name:
            left.append(node.plan())
        else:
            if name == "BroadcastExchange":
                sent.append(node.schema().simpleString())
            left += [node.children().apply(k) for k in range(node.children().size())]
    assert sent == ["struct<dim:int,block:array<bigint>>"]


def test_packed_integers_come_back():
    for top in (0, 1, (1 << 15) - 1, 1 << 15, (1 << 31) - 1, 1 << 31, 1 << 62):
        v = np.array([[top, -top, 3], [0, 1, -1]], np.int64)
        assert (topk.unpacked(topk.packed(v.ravel()), 2, 3) == v).all()
    assert topk.unpacked(topk.packed(np.zeros(0, np.int64)), 4, 0).shape == (4, 0)
