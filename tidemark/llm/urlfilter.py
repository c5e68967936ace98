"""URL filter: many glob rules as one bit-parallel wildcard automaton.

Rules are packed into multiword Shift-And masks. Every rule owns a run of bits, one for its start and
one for each symbol; a step over one byte moves all rules at once, ``D = (D << 1) & B[c] | D & L[c]``,
where ``B`` holds the symbols that a byte satisfies and ``L`` the states that a wildcard keeps alive. A
batch of URLs steps together, and a URL leaves as soon as no state is alive.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; an empty
rule list allows everything; equal urls get equal verdicts; very long URLs stop when no state is alive;
other columns of the input are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import column
from tidemark.llm.registry import query

DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    """``host`` also fits its subdomains; ``path`` is a prefix. ``*`` and ``?`` are wildcards in both;
    a wildcard of the host doesn't reach into the path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


class Automaton:
    """Masks of all rules; the longest rule that fits wins, then block, then the smaller text."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
        start, symbols, loops, final = [], [], [], []
        at = 0
        for rule in self.rules:
            start.append(at)
            loops.append((at, "host"))  # any labels may stand before the host
            at += 1
            for kind, glob in (("host", "." + rule.host), ("any", rule.path)):
                for b in glob.encode():
                    if b == ord("*"):
                        loops.append((at - 1, kind))
                    elif b == ord("?"):
                        symbols.append((at, "one " + kind))  # the first byte of a character
                        loops.append((at, "more"))
                        at += 1
                    else:
                        symbols.append((at, b))
                        at += 1
            final.append(at - 1)
        self.words = max(1, -(-at // 64))
        fits = {
            "host": np.arange(256) != ord("/"),
            "any": np.ones(256, bool),
            "more": (np.arange(256) & 0xC0) == 0x80,  # continuation bytes of one character
        }
        fits |= {"one " + kind: fits[kind] & ~fits["more"] for kind in ("host", "any")}
        self.step = np.zeros((256, self.words), np.uint64)
        self.keep = np.zeros((256, self.words), np.uint64)
        for table, entries in ((self.step, symbols), (self.keep, loops)):
            for bit, what in entries:
                rows = fits[what] if isinstance(what, str) else what
                table[rows, bit // 64] |= np.uint64(1 << bit % 64)
        self.first = np.zeros(self.words, np.uint64)
        for bit in start:
            self.first[bit // 64] |= np.uint64(1 << bit % 64)
        self.final = [(bit // 64, np.uint64(bit % 64)) for bit in final]
        self.accept = np.zeros(self.words, np.uint64)
        for word, bit in self.final:
            self.accept[word] |= np.uint64(1) << bit

    def best(self, texts: Sequence[bytes]) -> np.ndarray:
        """Index of the winning rule of each canonical URL, -1 where none fits."""
        out = np.full(len(texts), -1)
        if not self.rules or not texts:
            return out
        size = np.array([len(t) for t in texts])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        data = np.frombuffer(b"".join(texts), np.uint8)
        live = np.flatnonzero(size)
        state = np.tile(self.first, (len(live), 1))
        seen = np.zeros((len(texts), self.words), np.uint64)
        at = 0
        while len(live):
            c = data[begin[live] + at]
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.step[c]) | (state & self.keep[c])
            seen[live] |= state & self.accept
            at += 1
            on = (size[live] > at) & state.any(axis=1)
            if not on.all():
                live, state = live[on], state[on]
        for i in range(len(self.rules) - 1, -1, -1):
            word, bit = self.final[i]
            out[(seen[:, word] >> bit & np.uint64(1)).astype(bool)] = i
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, both without query and fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    small = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(small, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: Sequence[Rule] = RULES, default: str = DEFAULT,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; ``default`` where no rule fits."""
    host, path = host_and_path(column(url_col))
    machine = Automaton(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            won = machine.best([f".{h}{p}".encode() if h or p else b"" for h, p in zip(hosts, paths)])
            names = [machine.rules[i].text if i >= 0 else None for i in won]
            verdicts = [machine.rules[i].verdict if i >= 0 else default for i in won]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    src = df.select(column(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    out = src.mapInArrow(run, "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


@query(
    "op7_url_filter",
    """
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
    ), parts AS (
      SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM cut
    ), urls AS (
      SELECT page_id,
        translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
      FROM parts
    ), judged AS (
      SELECT page_id, host, path, CASE
        WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
      FROM urls
    )
    SELECT page_id, host, path, rule,
      CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
    FROM judged
    """,
)
def url_filter(t):
    return judge_urls(t.pages)
