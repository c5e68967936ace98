"""Toxicity by a weighted finite-state grammar over clauses.

Words are mapped to the symbols of a small alphabet: insult (strong or weak), threat, target, negation,
verb of speech, quote mark, other. Five transducers read them: what insult stands in the clause, whether
a threat does, whether it has a target, whether a negation reaches it, and whether it is reported speech.
They are composed into one automaton over the product of their states; at the end of a clause it puts out
the kind of clause that was matched. A document's score is a logistic function of how often each kind
occurs, so that a negated or reported insult counts by what the labels say of such clauses.

What counts as an insult is learned: words, and beginnings of words, that stand in many more labelled toxic
than clean documents, by a likelihood ratio, besides fixed seeds. Weights are fitted with a prior at the
grammar's own. Both use labelled rows only whose crc32 of the id modulo 5 isn't 0, at most ``SAMPLE`` of each
label, picked by hash; in the fit a row counts for as many as its label's share stands for, so that scores mean
the same at every size. Every document is scored, over its whole text, from the text alone.

Defined cases: null and empty texts match no clause and get the score of a text without matches; a null id
has the remainder of the empty text; rows without a 0/1 label, or whose id is null, teach nothing; several labels of one id
count as toxic if one is; without labels of both kinds the prior weights and the seeds hold; equal texts
get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.base import column, steps
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

FOLDS = 5
#: Labelled rows of each label that teach, at most; they are picked by hash of the id.
SAMPLE = 20_000
#: Terms of toxic rows that are counted in clean ones too, and terms of the learned lexicon.
CANDIDATES, LEXICON = 50_000, 4_000
STEMS = (4, 5, 6, 7)  # letters of a beginning of words
LEAST = 3  # toxic documents that hold a term
ROUNDS = 5
PURE = 200  # odds of a strong term that also stands in clean documents

# Seeds of the grammar's symbols.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile dumbass bastard "
    "dummkopf vollidiot arschloch abschaum trottel connard connasse abruti crétin ordure imbécile gilipollas estúpido basura".split()
)
THREATS = frozenset(
    "kill murder strangle stab shoot beat destroy töten umbringen erschießen verprügeln tuer frapper égorger matar golpear apuñalar".split()
)
TARGETS = frozenset(
    "you your yours u ur him her them they he she people du dich dir dein deine euch ihr ihn tu te toi ton ta vous votre lui eux "
    "tú ti tu usted ustedes él ella ellos".split()
)
NEGATIONS = frozenset("not no never neither nor without isn aren wasn don doesn didn nicht kein keine nie ne pas jamais sin nunca jamás".split())
SPEECH = frozenset(
    "said says say called calls claimed claims wrote writes told tells alleged quoted sagte sagt nannte schrieb behauptete "
    "dit disait écrit appelé affirme dijo dice llamó escribió afirmó".split()
)
OTHER, STRONG, WEAK, THREAT, TARGET, NEGATION, REPORT, QUOTE, CLAUSE, SENTENCE = range(10)
ENDS = (QUOTE, CLAUSE, SENTENCE)  # what ends a clause; quoted words are clauses of their own
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]|[.!?\n]|[,;:()]")
MARKS = {c: QUOTE for c in "\"“”„«»"} | {c: SENTENCE for c in ".!?\n"} | {c: CLAUSE for c in ",;:()"}
REACH = 3  # words after a negation that it reaches

#: Kinds of matched clauses, and the prior weight of each.
KINDS = {
    "strong": 5.0, "strong_target": 6.0, "strong_negated": 2.5, "strong_reported": 3.0,
    "weak": 1.0, "weak_target": 1.5, "weak_negated": 0.2, "weak_reported": 0.5,
    "threat_target": 1.0, "threat_reported": 0.3,
}
NAMES = list(KINDS)
BIAS = -2.5
PRIOR = 0.05  # weight of the prior, in observations


def _insult(state: int, symbol: int) -> int:
    if symbol in ENDS:
        return 0
    return max(state, {WEAK: 1, STRONG: 2}.get(symbol, 0))


def _threat(state: int, symbol: int) -> int:
    return 0 if symbol in ENDS else int(state or symbol == THREAT)


def _target(state: int, symbol: int) -> int:
    return 0 if symbol in ENDS else int(state or symbol == TARGET)


def _negation(state: int, symbol: int) -> int:
    """1...REACH: words still reached; REACH + 1: an insult was."""
    if symbol in ENDS:
        return 0
    if state == REACH + 1 or state and symbol in (STRONG, WEAK, THREAT):
        return REACH + 1
    return REACH if symbol == NEGATION else max(state - 1, 0)


def _speech(state: int, symbol: int) -> int:
    """1: after a verb of speech, to the end of the sentence; 2: inside quote marks."""
    if symbol == QUOTE:
        return 0 if state == 2 else 2
    if symbol == SENTENCE:
        return 2 if state == 2 else 0
    return max(state, int(symbol == REPORT))


def compose() -> tuple[list[list[int]], list[list[int]]]:
    """(moves, output) of the composed automaton: next state and kind of clause (-1: none), by state and symbol."""
    parts = (_insult, _threat, _target, _negation, _speech)
    states = list(product(range(3), range(2), range(2), range(REACH + 2), range(3)))
    number = {s: i for i, s in enumerate(states)}
    moves, out = [], []
    for s in states:
        moves.append([number[tuple(f(x, symbol) for f, x in zip(parts, s))] for symbol in range(10)])
        insult, threat, target, negated, reported = s
        kind = -1
        if insult:
            how = "_negated" if negated == REACH + 1 else "_reported" if reported else "_target" if target else ""
            kind = NAMES.index(("strong" if insult == 2 else "weak") + how)
        elif threat and target and negated != REACH + 1:
            kind = NAMES.index("threat_reported" if reported else "threat_target")
        out.append([kind if symbol in ENDS else -1 for symbol in range(10)])
    return moves, out


@dataclass
class Grammar:
    """``strong`` and ``weak``: words, and beginnings of words as ``abcd*``; weights by kind."""

    strong: frozenset[str] = INSULTS
    weak: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [BIAS, *KINDS.values()])

    def __post_init__(self):
        self.moves, self.out = compose()
        self.start = 0
        self.known: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        got = self.known.get(word)
        if got is None:
            got = self._symbol(word)
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = got
        return got

    def _symbol(self, word: str) -> int:
        if word in MARKS:
            return MARKS[word]
        terms = [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]
        if not self.strong.isdisjoint(terms):
            return STRONG
        if not self.weak.isdisjoint(terms):
            return WEAK
        for words, symbol in ((THREATS, THREAT), (NEGATIONS, NEGATION), (SPEECH, REPORT), (TARGETS, TARGET)):
            if word in words:
                return symbol
        return OTHER

    def match(self, text: str) -> list[int]:
        """How often each kind of clause occurs in a text."""
        counts = [0] * len(NAMES)
        words = TOKEN.findall(text.lower())
        symbol = self.symbol
        if not {STRONG, WEAK, THREAT}.isdisjoint(map(symbol, set(words))):
            state, moves, out = self.start, self.moves, self.out
            for w in words:
                s = symbol(w)
                kind = out[state][s]
                if kind >= 0:
                    counts[kind] += 1
                state = moves[state][s]
            kind = out[state][SENTENCE]
            if kind >= 0:
                counts[kind] += 1
        return counts

    def score(self, counts: list[int]) -> float:
        z = self.weights[0] + sum(w * math.log1p(c) for w, c in zip(self.weights[1:], counts) if c)
        return 1 / (1 + math.exp(-max(min(z, 50.0), -50.0)))


def terms_of(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _term_counts(texts: DataFrame, only: frozenset[str] | None = None, known: frozenset[str] = frozenset()) -> DataFrame:
    """(term, n): how many rows hold each term; rows with a ``known`` term aren't counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return got

        for batch in batches:
            for part in steps(batch, "text"):
                for t in part.column(0).to_pylist():
                    own = terms_of(t or "")
                    if known.isdisjoint(own):
                        counts.update(own if only is None else own & only)
                if len(counts) > 200_000:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(strong, weak) terms from (text, toxic); collected tables are bounded by CANDIDATES.

    In rounds: the strongest terms first, then those of the toxic rows that no strong term explains yet, so
    that chance companions of an insult aren't taken for insults.
    """
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return INSULTS, frozenset()
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    # A seed that the labels speak against isn't one.
    seeds = {r["term"]: r["n"] for r in _term_counts(clean, INSULTS).collect()}
    strong = frozenset(w for w in INSULTS if seeds.get(w, 0) < max(3, 0.01 * good * LEAST / bad))
    weak: frozenset[str] = frozenset()
    for _ in range(ROUNDS):
        top = _term_counts(toxic, known=strong).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "term").limit(CANDIDATES)
        hits = {r["term"]: r["n"] for r in top.collect()}
        if not hits:
            break
        seen = {r["term"]: r["n"] for r in _term_counts(clean, frozenset(hits)).collect()}
        need = 2 * math.log(max(len(hits), 2)) + 3
        found, weak = [], frozenset()
        longer: dict[str, list[str]] = {}
        for term in hits:
            for n in STEMS:
                if len(term.rstrip("*")) > n:
                    longer.setdefault(term[:n], []).append(term)
        for term, a in hits.items():
            b = seen.get(term, 0)
            odds = ((a + 0.5) / (bad + 1)) / ((b + 0.5) / (good + 1))
            if odds >= 8 and (g := _ratio(a, bad, b, good)) >= need:
                # A longer beginning that holds nearly as often, but in fewer clean rows, takes its place.
                stem = term.rstrip("*")
                purer = b and any(hits.get(x, 0) >= 0.8 * a and seen.get(x, 0) < b for x in longer.get(stem, ()))
                if (odds >= PURE or not b) and not purer:
                    found.append((g, term))
                else:
                    weak |= {term}
        if not found:
            break
        edge = max(found)[0] / 4
        strong |= {t for g, t in sorted(found, reverse=True)[:LEXICON] if g >= edge}
    return strong, weak


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of unequal rates a / n and b / m."""
    def part(x, size, p):
        return (x * math.log(p) if x else 0.0) + ((size - x) * math.log(1 - p) if size > x else 0.0)

    p = (a + b) / (n + m)
    if p in (0.0, 1.0):
        return 0.0
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))


def _fit(x: np.ndarray, y: np.ndarray, count: np.ndarray) -> list[float]:
    """Logistic weights by Newton steps with halving, drawn towards the grammar's own weights; row i stands for ``count[i]``."""
    prior = np.array([BIAS, *KINDS.values()])
    x = np.column_stack([np.ones(len(x)), np.log1p(x)])
    pull = np.full(len(prior), PRIOR)
    pull[0] = 1e-3

    def loss(w):
        z = x @ w
        return float(count @ (np.logaddexp(0, z) - z * y) + (pull * (w - prior) ** 2).sum() / 2)

    w, now = prior.copy(), loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (count * (p - y)) + pull * (w - prior)
        if np.abs(slope).max() < 1e-6:
            break
        move = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        now = loss(w)
    return w.tolist()


def held_out(id_):
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, stands_for) of at most about SAMPLE rows of each label; all but the texts is broadcast."""
    known = (
        labels.select(column("doc_id").alias("id"), column("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    known = cut_lineage(known)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, SAMPLE / max(n.get(1, 0), SAMPLE)).otherwise(SAMPLE / max(n.get(0, 0), SAMPLE))
    picked = known.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    picked = picked.withColumn("stands_for", 1 / share)
    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(picked), "id").select("text", "toxic", "stands_for")


def without_copies(sample: DataFrame) -> DataFrame:
    """One row of each label among rows that share the smallest hash of their four-word shingles, so that
    what stands in one text and its near copies isn't taken for evidence from many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                keys = []
                for text in part.column(0).to_pylist():
                    w = (text or "").split()
                    keys.append(min((xxhash.xxh3_64_intdigest(" ".join(w[i : i + 4])) for i in range(max(len(w) - 3, 1))), default=0) >> 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], ["text", "toxic", "stands_for", "likeness"])

    marked = sample.mapInArrow(work, "text string, toxic int, stands_for double, likeness long")
    one = marked.groupBy("likeness", "toxic").agg(F.min("text").alias("text"), F.first("stands_for").alias("stands_for"))
    return one.select("text", "toxic", "stands_for")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """The grammar with its learned terms and weights."""
    sample = cut_lineage(without_copies(training_rows(docs, labels, id_col, text_col)))
    strong, weak = lexicon(sample)
    grammar = Grammar(strong, weak)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                counts = [grammar.match(t or "") for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(counts, pa.list_(pa.int32()))], ["toxic", "stands_for", "counts"])

    # Equal rows are counted together; there are at most twice SAMPLE.
    seen = sample.mapInArrow(work, "toxic int, stands_for double, counts array<int>")
    seen = seen.groupBy("toxic", "counts").agg((F.count("*") * F.first("stands_for")).alias("n"))
    rows = [(r["toxic"], r["counts"], r["n"]) for r in seen.orderBy("toxic", "counts").collect()]
    if len({t for t, _, _ in rows}) < 2:
        return grammar
    toxic, counts, n = (np.array(c, float) for c in zip(*rows))
    return Grammar(strong, weak, _fit(counts, toxic, n))


def score_texts(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with toxic_score behind."""
    value = grammar

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "t_text"):
                text = part.column(part.schema.get_field_index("t_text")).to_pylist()
                score = pa.array([value.score(value.match(t or "")) for t in text], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*part.schema.names, "t_score"])

    src = df.select(*[column(c).alias("t_text" if c == text_col else f"t_{i}") for i, c in enumerate(df.columns)])
    out = src.mapInArrow(work, StructType([*src.schema.fields, StructField("t_score", DoubleType())]))
    return out.select(
        *[F.col("t_text" if c == text_col else f"t_{i}").alias(c) for i, c in enumerate(df.columns)], F.col("t_score").alias("toxic_score")
    )


@query("op2_toxicity")
def toxicity(t):
    docs = t.documents.select("doc_id", "text")
    scored = score_texts(docs, learn(docs, t.labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )
