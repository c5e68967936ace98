"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

A word's merges aren't replayed. An Aho-Corasick pass finds the longest token at each place of the word;
the encoder walks from the left, takes the longest token that is compatible with the one before, falls
back to its next shorter prefix token, and steps back where none fits, marking the place as dead, so every
place is left at most once. Two tokens are compatible if merging their joined text gives just those two:
while both are built up from their symbols, no pair across the border may be due before its parts are used
up. That verdict is kept in a table. The result is exactly that of the merges, in linear time.

Words and their tokens are cached per Python worker, in a table of bounded size. The vocabulary file is
read where the plan is made and sent to the tasks once; its size is fixed.

Defined cases: null and empty texts have no tokens and decode to the empty text; the strings of special
tokens in a text become these tokens; equal texts get equal ids; only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm.base import column, steps
from tidemark.llm.registry import query

#: Symbols that end a word are moved up by this much, so that each symbol is one character.
END = 0x1000
SUFFIX = "</w>"
CACHE = 300_000
NEVER = 1 << 60


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return out


#: Letters and numerals all lie below; what lies above is private or reserved.
TOP = 0x34000


@lru_cache(maxsize=1)
def character_tables() -> dict:
    """Runs of letters, numerals and white space, and single characters younger than Python's own tables,
    as the tokenizers library knows them. They are found once, where the plan is made."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, TOP))))

    def runs(pattern: str) -> list[tuple[int, int]]:
        parts = pre_tokenizers.Split(Regex(pattern + "+"), "removed", invert=True).pre_tokenize_str(every)
        return [(ord(x[0]), ord(x[-1])) for x, _ in parts]

    small = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    fresh = [c for c in every if unicodedata.category(c) == "Cn"]
    letters = runs(r"\p{L}")
    known = {c for a, b in letters for c in range(a, b + 1)}
    young = "".join(c for c in fresh if ord(c) in known or small.normalize_str(c) != c)
    return {"letters": letters, "numerals": runs(r"\p{N}"), "space": runs(r"\s"), "young": young}


def char_class(runs: list[tuple[int, int]], top: int) -> str:
    return "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in runs if a <= top)


class Splitter:
    """Contractions, runs of letters, single numerals, runs of other visible characters, of a text
    that is composed and lower-cased. Texts of few scripts get small classes, which is faster."""

    LOW = 0x17F

    def __init__(self, tables: dict):
        letters, numerals, space = tables["letters"], tables["numerals"], tables["space"]
        self.narrow, self.wide = (
            re.compile(
                f"'s|'t|'re|'ve|'m|'ll|'d|[{char_class(letters, top)}]+|[{char_class(numerals, top)}]"
                f"|[^{char_class([*space, *letters, *numerals], top)}]+"
            ).findall
            for top in (self.LOW, sys.maxunicode)
        )
        self.high = re.compile(f"[^\\x00-\\u{self.LOW:04x}]").search
        self.young = re.compile(f"[{re.escape(tables['young'])}]").search if tables["young"] else lambda text: None
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    def __call__(self, text: str) -> list[str]:
        if self.high(text) is None:
            return self.narrow(unicodedata.normalize("NFC", text).lower())
        if self.young(text):
            return self.wide(self.library.normalize_str(text))
        text = unicodedata.normalize("NFC", text)
        # Each character by itself: the final form of sigma isn't chosen by context.
        return self.wide("".join(map(str.lower, text)) if "Σ" in text else text.lower())


class Codec:
    def __init__(self, spec: dict, tables: dict | None = None):
        self.split = Splitter(tables or character_tables())
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: s for s, i in (vocab | self.special).items()}
        # The offset table: all tokens one after the other, each with the space that parts it from the next.
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.symbols = {s: self._symbols(s) for s in vocab}
        self.id_of = {v: vocab[s] for s, v in self.symbols.items()}
        self.length = {i: len(s) for s, i in self.id_of.items()}
        self.rank, self.parts = {}, {}
        for rank, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(vocab[a + b], (rank, *pair))
        self.shorter = {i: self._prefix(s) for s, i in self.id_of.items()}
        self.search = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.search.add_word(s, (len(s), i))
        self.search.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}  # since the last change of tables, and before it
        self.older: dict[str, tuple[int, ...]] = {}
        self.letters = byte_letters()
        self.digits = [str(i) for i in range(len(pieces))]

    @staticmethod
    def _symbols(s: str) -> str:
        if s.endswith(SUFFIX) and len(s) > len(SUFFIX):
            s = s.removesuffix(SUFFIX)
            return s[:-1] + chr(ord(s[-1]) + END)
        return s

    def _prefix(self, s: str) -> int | None:
        """The longest token that is a true prefix of ``s``."""
        return next((self.id_of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.id_of), None)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along one edge of a token's merges, from the symbol up, each with the rank that uses it up."""
        out, due = [], NEVER
        while True:
            out.append((token, due))
            if token not in self.parts:
                return out[::-1]
            due = self.parts[token][0]
            token = self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self._meet(self._spine(a, 2), self._spine(b, 1))
            if len(self.fits) >= 4 * CACHE:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def _meet(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            # Of equal pairs the left one merges first.
            if rank < until_x and rank <= until_y and rank < NEVER:
                return False
            if until_x == until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def word(self, text: str) -> tuple[int, ...]:
        """Token ids of one word, given as byte letters."""
        text = text[:-1] + chr(ord(text[-1]) + END)
        n = len(text)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, (size, token) in self.search.iter(text):
            at = end - size + 1
            if size > longest[at][0]:
                longest[at] = (size, token)
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0][1]
        while at < n:
            while token is not None:
                to = at + self.length[token]
                if not dead[to] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
            else:
                out.append(token)
                at = to
                token = longest[at][1] if at < n else None
        return tuple(out)

    def _new(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.word("".join([self.letters[b] for b in word.encode()]))
        if len(word) <= 64:
            if len(self.words) >= CACHE:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        new = self._new
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable([self.words.get(w) or new(w) for w in self.split(part)]))
        return out

    def decode(self, ids: Sequence[int], run: int = 1 << 18) -> str:
        """Tokens joined by spaces, copied from the offset table in runs of bounded size."""
        parts = []
        for k in range(0, len(ids), run):
            own = np.asarray(ids[k : k + run], np.int64)
            size = self.size[own]
            shift = self.offset[own] - (np.cumsum(size) - size)
            parts.append(self.blob[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(parts)[:-1].decode()


_CODECS: dict[str, Codec] = {}


def codec(raw: str) -> Codec:
    """One codec per vocabulary and Python worker."""
    name = hashlib.sha256(raw.encode()).hexdigest()
    if name not in _CODECS:
        _CODECS[name] = Codec(*json.loads(raw))
    return _CODECS[name]


def vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(json.dumps([json.load(f), character_tables()]))


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text."""
    raw = vocabulary(df, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        for batch in batches:
            for part in steps(batch, "text"):
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _source(df, id_col, text_col).mapInArrow(work, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from token ids; null ids give the empty text."""
    raw = vocabulary(df, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        for batch in batches:
            text = [own.decode(x.values.to_numpy()) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    src = df.select(column(id_col).cast("long").alias("id"), column(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(work, "id long, text string").withColumnRenamed("id", id_col)


def token_report(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids, in one pass."""
    raw = vocabulary(df, path)

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        for batch in batches:
            for part in steps(batch, "text"):
                n, one, two = [], [], []
                for text in part.column(1).to_pylist():
                    ids = own.encode(text or "")
                    n.append(len(ids))
                    one.append(sha(" ".join([own.digits[i] for i in ids])))
                    two.append(sha(own.decode(ids)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    out = _source(df, id_col, text_col).mapInArrow(work, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def word_bpe() -> str:
    """Where the vocabulary of the registered query lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_bpe")
def bpe(t):
    return token_report(t.documents, word_bpe())
