"""All registered queries of this package."""

from tidemark.llm import bpe, html, lexical, lines, media, merkle, mixing, simhash, substrings, suffixes, topk, toxicity, urlfilter  # noqa: F401
from tidemark.llm.registry import QUERIES  # noqa: F401
