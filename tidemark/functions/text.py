"""Cleaning of external text, URL normal form, time parsing and redaction."""

from __future__ import annotations

import html
import json
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suspicious phrases, tags, control characters.
INJECTION = (
    r"(?i)(ignore\s+(all|previous)|system\s+prompt|developer\s+message"
    r"|越过.{0,8}指令|忽略.{0,8}指令)"
)
TAG = r"<[^>]+>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACES = r"(?U)[\s\x1c-\x1f]+"
AUDIT_SECRETS = (
    "authorization", "cookie", "password", "secret", "token", "api_key", "account_number",
)


@F.pandas_udf(T.StringType())
def _references(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_reference(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


@F.pandas_udf(T.StringType())
def _closed_references(text: pd.Series) -> pd.Series:
    return text.map(lambda s: _CLOSED.sub(_closed_reference, s), na_action="ignore")


def unescape(c: Column, closed: bool = False) -> Column:
    """Decode all character references of HTML; ``closed`` leaves those without a semicolon as they stand.

    The table of names is the standard library's; only texts with an ampersand reach it.
    """
    decode = _closed_references if closed else _references
    return F.coalesce(decode(F.when(c.contains("&"), c)), c)


def plain_text(c: Column, max_length: int | None = None, closed: bool = False) -> Column:
    """Unescape, drop tags and control characters, collapse whitespace, cut to a length."""
    text = F.regexp_replace(unescape(c, closed), TAG, " ")
    text = F.regexp_replace(text, CONTROL, "")
    text = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.substring(text, 1, max_length) if max_length else text


def injection_suspected(plain: Column) -> Column:
    return plain.rlike(INJECTION)


def _encode(c: Column) -> Column:
    plain = F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A"))
    return F.replace(plain, F.lit("%7E"), F.lit("~"))


def normalize_url(c: Column) -> Column:
    """Normal form of an http(s) URL, NULL for anything else.

    Scheme and authority are lowered, an empty path becomes ``/``, tracking parameters
    (``utm_*``) and blank values are dropped, the rest re-encoded, the fragment removed.
    """
    s = F.trim(c)
    part = lambda i: F.regexp_extract(
        s, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", i
    )
    scheme, authority, path, raw = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
    pairs = F.transform(
        F.split(raw, "&"),
        lambda kv: F.struct(
            F.regexp_extract(kv, "^([^=]*)=", 1).alias("k"),
            F.regexp_extract(kv, "^[^=]*=(.*)$", 1).alias("v"),
        ),
    )
    # A text with a bad escape stays as it is, but for its plus signs.
    decode = lambda x: F.coalesce(
        F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" "))
    )
    kept = F.filter(
        pairs, lambda p: (p["v"] != "") & ~F.lower(decode(p["k"])).startswith("utm_")
    )
    query = F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(decode(p["k"])), F.lit("="),
                                             _encode(decode(p["v"])))), "&"
    )
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", "")
    joined = F.concat(
        scheme, F.lit("://"), authority, F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(scheme.isin("http", "https") & (host != ""), joined)


def cluster_key(title: Column) -> Column:
    return F.substring(F.sha2(F.lower(title), 256), 1, 24)


def parse_feed_time(c: Column) -> Column:
    """Two compact formats, otherwise NULL."""
    first = F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.coalesce(first, F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))


def redact_map(details: Column) -> Column:
    """Mask the values of secret keys of a string map, whatever the case of the key."""
    secret = [F.lit(s) for s in AUDIT_SECRETS]
    return F.transform_values(
        details, lambda k, v: F.when(F.lower(k).isin(*secret), F.lit("[REDACTED]")).otherwise(v)
    )


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:\s*)?', re.S)
_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s,\]}"{\[]+')
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')


def _value_end(text: str, at: int) -> int:
    """Where the JSON value that starts at ``at`` ends; the text's end if it is never closed."""
    if text[at : at + 1] not in ("{", "["):
        m = _SCALAR.match(text, at)
        return m.end() if m else at
    depth = 0
    for m in _BRACKETS.finditer(text, at):
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(text)


def _names_secret(key: str) -> bool:
    """Whether a member's name as it stands in the text, escapes included, is a secret one."""
    if "\\" in key:
        try:
            key = json.loads(f'"{key}"', strict=False)
        except ValueError:
            return True  # no name can be told: masked
    return key.lower() in AUDIT_SECRETS


def redact_text(text: str) -> str:
    """Walk the strings of a JSON text in order; one before a colon is a member's name."""
    out, done, at = [], 0, 0
    while m := _STRING.search(text, at):
        at = m.end()
        if m[2] and _names_secret(m[1]):
            out += [text[done:at], '"[REDACTED]"']
            done = at = _value_end(text, at)
    return "".join([*out, text[done:]])


@F.pandas_udf(T.StringType())
def _redacted(text: pd.Series) -> pd.Series:
    return text.map(redact_text, na_action="ignore")


def redact_json(text: Column) -> Column:
    """Mask the whole value of secret members at any depth of a JSON text, objects and lists too."""
    return _redacted(text)
