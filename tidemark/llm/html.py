"""Main text of web pages by block rules in two passes.

Markup is cut into blocks at block-level tags. Elements that hold no article by their nature (menus, page
headers and footers, sidebars, scripts, styles) or by their role are left out whole. So are forms, and elements whose
class or id is a boilerplate name (adverts, notices, comments ...) or begins or ends with one, unless what they hold
speaks louder than what stands beside them: an article louder than a long dense block, that louder than others; an
article among comments counts as no more than its text. Such words inside a longer name, or beside a name that
stands for content, are only evidence against a block.

The first pass decides all blocks by link density, length and density of stop words. If the blocks in ``article`` or
``main`` hold as much good text as the others, structure counts as well: they are good unless they are mostly links,
and the others are left out. Short blocks, and those of middling density, stay open; in the second pass they take
the label of the nearest decided neighbours: middling ones are bad only between bad ones, short ones follow both
sides if these agree, else the nearer one, headings the one after them if both are as near. On a page without any
good block, short ones without links stay.

Defined cases: null and empty pages, and pages without a good block, give the empty text; unclosed tags,
comments and pages cut off anywhere are read as far as they go; equal pages give equal texts. Each page is
read whole, in time proportional to its length. Only id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.base import column, steps
from tidemark.llm.registry import query

SHORT, LONG = 70, 140  # characters
STOP_LOW, STOP_HIGH = 0.15, 0.25  # parts of a block's words
LINKED = 0.5  # part of a block's characters inside links
MOSTLY = 0.8  # the same, for blocks of an article
DEEP = 16  # named elements within each other that are told apart

# Common function words, by language.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or our she "
    "so that the their there they this to was we were which who will with you "
    "aber als am an auch auf aus bei bin das dass dem den der des die du ein eine einem einen einer er es für hat "
    "ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wenn wie wir zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus "
    "pour qu que qui sa se ses son sont sur tu un une vous y "
    "al como con del el ella en era es esta este ha hay las lo los más me mi muy no o para pero por porque se si sin "
    "sobre su sus también te un una uno ya".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style title template noscript iframe object svg math canvas audio video textarea select".split())
LEFT_OUT = frozenset("head nav header footer aside button menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD = frozenset("title meta link script style base noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of a class or id that say what an element is for.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies "
    "respond disqus discussion widget toolbar pager pagination copyright legal disclaimer".split()
)
#: Those that stand for what readers write, and names of what holds the text itself.
TALK = frozenset("comment comments reply replies respond disqus discussion".split())
CONTENT = frozenset("article body content copy entry main page post story text wrap wrapper container inner".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)?", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^\W\d_]+")


class Block:
    """linked: characters inside links; chain: (number, reader's) of the named elements around it, outermost first."""

    __slots__ = ("text", "linked", "anchors", "inside", "item", "heading", "hint", "chain")

    def __init__(self, text: str, linked: int, anchors: int, inside: bool, item: bool, heading: bool, hint: bool = False, chain: tuple = ()):
        self.text, self.linked, self.anchors, self.inside, self.item = text, linked, anchors, inside, item
        self.heading, self.hint, self.chain = heading, hint, chain


def standing_of(name: str, attributes: str, in_article: bool) -> str:
    """out: left out by nature; named or talk: by a boilerplate name; hint: a name holds such a word; or nothing."""
    if name in ("html", "body", "main"):
        return ""
    if name in LEFT_OUT and not (name == "header" and in_article):
        return "out"
    names: list[list[str]] = []
    for key, *values in ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        if key.lower() in ("class", "id"):
            names += [[w.lower() for w in PARTS.findall(x)] for x in value.split()]
        elif key.lower() == "role" and value.lower() in ROLES:
            return "out"
    if name == "article" and not in_article:
        return ""
    marks = MARKS - {"header"} if in_article and name != "article" else MARKS
    whole = any(words and marks.issuperset(words) for words in names)
    holds = any(words and CONTENT.issuperset(words) for words in names)
    ends = [words for words in names if words and (words[0] in marks or words[-1] in marks)]
    if whole or ends and not holds:
        return "talk" if any(not TALK.isdisjoint(words) for words in ends) else "named"
    if name == "form":
        return "named"
    return "hint" if any(not marks.isdisjoint(words) for words in names) else ""


def blocks_of(html: str) -> list[Block]:
    """The blocks that aren't left out, in page order."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []  # name, left out, article
    state: list[tuple[bool, tuple]] = [(False, ())]  # hint and named elements, by depth
    named = 0
    hidden = articles = links = 0
    pieces: list[str] = []
    linked = anchors = 0
    item = heading = False

    def flush():
        nonlocal linked, anchors, item, heading
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append(Block(text, linked, anchors, articles > 0, item, heading, *state[-1]))
            pieces.clear()
        linked, anchors, item, heading = 0, 0, False, False

    standing: Counter = Counter()  # open elements by name, so that a stray end tag costs nothing

    def close(at: int):
        nonlocal hidden, articles, links
        for name, out_, article in open_[at:]:
            standing[name] -= 1
            hidden -= out_
            articles -= article
            links -= name == "a"
        del open_[at:]
        del state[at + 1 :]

    def text(s: str):
        nonlocal linked, item, heading
        if s and not hidden:
            s = unescape(s)
            pieces.append(s)
            item = item or any(n == "li" for n, _, _ in open_[-4:])
            heading = heading or any(n in HEADINGS for n, _, _ in open_[-3:])
            if links:
                linked += len(s.strip())

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        if m[4] is None:  # a stray quote inside the tag
            stop = html.find(">", at)
            at = end if stop < 0 else stop + 1
        name = name.lower()
        if name in RAW:
            if not m[1] and not (name in ("svg", "math") and m[3].endswith("/")):  # only these can close themselves
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            if name == "br":
                pieces.append(" ")
            continue
        if m[1]:
            if not standing[name]:
                continue
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close(k)
                    break
                if name in INLINE and open_[k][0] not in INLINE and open_[k][0] != "p":
                    break
            continue
        if standing["head"] and name not in HEAD and name != "head":  # ends an unclosed head
            close(next(k for k, x in enumerate(open_) if x[0] == "head"))
        if name not in INLINE:  # a block ends an open paragraph
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == "p":
                    close(k)
                    break
                if open_[k][0] not in INLINE:
                    break
        how = standing_of(name, m[3], articles > 0)
        gone = how == "out"
        article = name in ("article", "main") and not gone and not hidden
        open_.append((name, gone, article))
        hint, chain = state[-1]
        if how in ("named", "talk") and len(chain) < DEEP:
            chain, named = (*chain, (named, how == "talk")), named + 1
        # An article is its own evidence, whatever it is wrapped in.
        state.append(((hint or how == "hint") and not (article and how == ""), chain))
        standing[name] += 1
        hidden += gone
        articles += article
        links += name == "a"
        anchors += name == "a" and not hidden
    flush()
    return out


def density_of(text: str) -> float:
    words = WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def loudness(b: Block) -> int:
    """2: text of an article; 1: long, dense and not linked; 0: neither."""
    talk = any(readers for _, readers in b.chain)
    if b.inside and not b.hint and not talk and first_pass(b, True) == "good":
        return 2
    return int(len(b.text) >= LONG and b.linked <= LINKED * len(b.text) and density_of(b.text) >= STOP_HIGH)


def without_named(blocks: list[Block]) -> list[Block]:
    """Elements of a boilerplate name go, but for those that hold louder text than stands beside them."""

    def kept(group: list[int], depth: int) -> list[int]:
        here = [i for i in group if len(blocks[i].chain) == depth]
        held: dict[int, list[int]] = {}
        for i in group:
            if len(blocks[i].chain) > depth:
                held.setdefault(blocks[i].chain[depth][0], []).append(i)
        best = max((loud[i] for i in here), default=0)
        for own in held.values():
            if max(loud[i] for i in own) > best:
                here += kept(own, depth + 1)
        return here

    loud = [loudness(b) for b in blocks]
    return [blocks[i] for i in sorted(kept(list(range(len(blocks))), 0))]


def first_pass(b: Block, structured: bool) -> str:
    """good, bad, near (rather good) or short."""
    n = len(b.text)
    share = b.linked / n
    if structured and b.inside and not b.hint:  # only rows of links stay behind
        return "bad" if share > MOSTLY and (b.item or b.anchors > 1) else "good"
    if share > LINKED:
        return "bad"
    if n < SHORT:
        return "bad" if b.linked else "short"
    density = density_of(b.text)
    if density >= STOP_HIGH:
        return "good" if n >= LONG else "near"
    return "near" if density >= STOP_LOW else "bad"


def second_pass(labels: list[str], headings: list[bool]) -> list[bool]:
    """Open blocks take the label of their nearest decided neighbours; the page's edges count as bad."""
    n = len(labels)
    if not {"good", "near"}.intersection(labels):
        return [x == "short" for x in labels]  # nothing better speaks against them

    def nearest(order) -> list[tuple[str, int]]:
        seen, out = ("bad", -1), [("bad", n)] * n
        for k in order:
            out[k] = (seen[0], abs(k - seen[1]) if seen[1] >= 0 else n)
            if labels[k] in ("good", "bad"):
                seen = (labels[k], k)
        return out

    # First the nearly good ones, which go only between two bad ones; then the short ones, next to what is decided.
    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    labels = [
        ("bad" if before[k][0] == after[k][0] == "bad" and n not in (before[k][1], after[k][1]) else "good") if x == "near" else x
        for k, x in enumerate(labels)
    ]
    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for k, x in enumerate(labels):
        if x == "short":
            (a, da), (b, db) = before[k], after[k]
            x = a if a == b else (a if da < db else b if db < da or headings[k] else "bad")
        out.append(x == "good")
    return out


def main_text(html: str | None) -> str:
    blocks = without_named(blocks_of(html or ""))
    # Structure counts where the blocks of articles hold the larger part of the good text.
    inside = sum(len(b.text) for b in blocks if b.inside and first_pass(b, True) == "good")
    outside = sum(len(b.text) for b in blocks if not b.inside and first_pass(b, False) == "good")
    structured = inside > 0 and inside >= outside
    if structured:
        blocks = [b for b in blocks if b.inside]
    labelled = [(b, first_pass(b, structured)) for b in blocks]
    # What a name speaks against, and the rules too, is no neighbour.
    labelled = [(b, x) for b, x in labelled if not (b.hint and x == "bad")]
    good = second_pass([x for _, x in labelled], [b.heading for b, _ in labelled])
    return " ".join([b.text for (b, _), g in zip(labelled, good) if g])


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "html"):
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    src = df.select(column(id_col).cast("long").alias("id"), column(url_col).alias("url"), column(html_col).cast("string").alias("html"))
    out = src.mapInArrow(work, "id long, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


@query("op8_html_text")
def html_text(t):
    return extract_text(t.pages)
