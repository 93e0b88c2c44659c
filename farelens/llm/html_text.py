"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First pass: stop-word density, length and link density
make each block good, bad, near-good or short. Second pass: short blocks take the label of the nearest
decided neighbours (good only between good ones), near-good ones need one good neighbour. Where
<article> and <main> hold most of the good text, short and near-good blocks inside them are kept, and
blocks outside inherit nothing from inside; otherwise these tags say nothing.

Blocks inside elements that never hold the article (menus, footers, forms, scripts and the like) are
bad from the start. Class and id names are weaker evidence: what they mark is bad unless it turns out
to hold most of the page's good text.

Stop words are known for four languages. Where the unlinked longer blocks of a page hold hardly any of them,
the page is in another language (or is code, or a table), and length and link density decide alone. Where no
block is good, near-good ones count as good, and where there are none either, unlinked short ones.

Reading a page takes time in proportion to its length, however broken or deeply nested it is.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 256
LONG = 120  # code points
SHORT = 60
MANY_STOP_WORDS = 0.20
SOME_STOP_WORDS = 0.08
MANY_LINKS = 0.33

# Tags by their role.
RAW = ("script", "style", "template", "noscript", "textarea", "iframe", "svg", "annotation", "annotation-xml", "select", "object", "canvas")
NEVER_ARTICLE = frozenset("nav header footer aside form button dialog menu head fieldset".split())
ARTICLE = frozenset(("article", "main"))
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Opening one of these closes an open paragraph.
ENDS_PARAGRAPH = BLOCK - {"br", "body", "html"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words in class and id names that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar comment comments reply replies respond disqus discussion form login signup "
    "subscribe newsletter share sharing social related recommended widget pagination pager copyright legal disclaimer "
    "skip search hidden".split()
)
# What readers say can be longer than the article and reads like it: these names count as whole ones.
READERS = frozenset("comment comments reply replies respond disqus discussion".split())
# These before a word say how the page is laid out, not what the element is.
LAYOUT = frozenset("has no not with without".split())
NOT_ARTICLE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)

# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one "
    "you were all her she there would their we him been has when who will no more if out so up said what its about than "
    "into them can only other time new some could these two may first then do any like my now over such our even most "
    "le la les de des du un une et est en que qui dans pour par sur au aux avec ce cette ces il elle ils elles ne pas plus "
    "se sa son ses leur leurs mais ou où nous vous je tu on sont été être avoir fait comme tout bien sans entre "
    "der die das und den dem des ein eine einen einem einer zu in ist mit von für auf nicht sich auch als an es im am aus "
    "bei nach wie wird sind war werden hat haben oder aber wenn nur noch über vor durch zum zur um bis kann mehr so "
    "el los las y del al lo una unos unas por con para como más pero sus le ya o este sí porque esta entre cuando muy sin "
    "sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e".split()
)

_TAG_START = re.compile(r"</?[a-zA-Z]")
_TAG_STOP = re.compile(r"[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_HINTS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAMES = re.compile(r"[^\s]+")
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")  # East Asian scripts
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _size(text: str) -> int:
    """The length of a text in code points, where one of a script with few characters a word counts three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


HARD, WHOLE, PART = 3, 2, 1  # marks of an element


def _name_mark(name: str) -> int:
    """What one class name or id says: a whole name of the list, or one that begins or ends with such a word."""
    parts = _PARTS.findall(name)
    if not parts:
        return 0
    if len(parts) == 1:
        return WHOLE if parts[0] in NOT_ARTICLE else 0
    last = parts[-1] if parts[-2] not in LAYOUT else ""
    if parts[0] in READERS or last in READERS:
        return WHOLE
    return PART if parts[0] in NOT_ARTICLE or last in NOT_ARTICLE else 0


def _mark(name: str, tag: str) -> int:
    """How strongly an element's name or attributes say that it isn't part of the article."""
    if name in NEVER_ARTICLE:
        return HARD
    if name in ("body", "html") or "=" not in tag and "hidden" not in tag:
        return 0
    mark = 0
    for key, value in _HINTS.findall(tag):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in NOT_ARTICLE_ROLES:
            return HARD
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return HARD
        if key == "style" and "display:none" in value.replace(" ", ""):
            return HARD
        if key in ("class", "id"):
            mark = max([mark, *map(_name_mark, _NAMES.findall(value))])
    return mark


class _Marked:
    """An element that its names mark, with what it holds."""

    __slots__ = ("mark", "parent", "has_article", "good", "article_good", "bad")

    def __init__(self, mark: int, parent: _Marked | None):
        self.mark, self.parent = mark, parent
        self.has_article, self.good, self.article_good, self.bad = False, 0, 0, False


class _Block:
    __slots__ = ("text", "size", "linked", "article", "hard", "marked", "heading", "counted")

    def __init__(self, text: str, linked: int, article: bool, hard: bool, marked: _Marked | None, heading: bool):
        self.text, self.size, self.linked, self.article = text, _size(text), linked, article
        self.hard, self.marked, self.heading = hard, marked, heading
        self.counted: tuple[int, int] | None = None

    def stop_words(self) -> tuple[int, int]:
        """How many stop words and words the block has."""
        if self.counted is None:
            found = _WORDS.findall(self.text.lower())
            self.counted = sum(map(STOP_WORDS.__contains__, found)), len(found)
        return self.counted


def _tokens(page: str):
    """``(start, end)`` of tags, comments and the like, in order; send a place to go on from there.

    A tag ends at the first ``>`` outside quotes. A ``<`` whose quotes never end, or without a ``>`` after it, is text;
    after the former quotes count no more in this page, so that no part is read again and again.
    """
    at, last, quotes = page.find("<"), page.rfind(">"), True
    while at >= 0:
        end = -1
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            close = "-->" if page[at + 2] == "-" else "]]>"
            found = page.find(close, at + 4)
            end = len(page) if found < 0 else found + 3
        elif at > last:
            return
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1
        elif _TAG_START.match(page, at):
            end = _tag_end(page, at) if quotes else page.find(">", at) + 1
            quotes = quotes and end > 0
        if end <= 0:
            at = page.find("<", at + 1)
            continue
        further = yield at, end
        at = page.find("<", end if further is None else further)


def _tag_end(page: str, at: int) -> int:
    """Where the tag at ``at`` ends; -1 if a quote in it does not end."""
    stop = _TAG_STOP.search(page, at)
    while stop and stop.group() != ">":
        closing = page.find(stop.group(), stop.end())
        stop = _TAG_STOP.search(page, closing + 1) if closing >= 0 else None
    return stop.end() if stop else -1


def blocks(page: str) -> tuple[list[_Block], list[_Marked]]:
    """The page's blocks in order, with white space collapsed and references decoded, and its marked elements,
    outer ones before those inside."""
    found: list[_Block] = []
    holders: list[_Marked] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, their marks, and whether each is an unmarked article
    open_names: Counter[str] = Counter()
    state = {"links": 0, "linked": 0, "article": 0, "hard": 0, "heading": 0, "marked": None}

    def close() -> None:
        if parts:
            text = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                flags = state["article"] > 0, state["hard"] > 0, state["marked"], state["heading"] > 0
                found.append(_Block(text, state["linked"], *flags))
            parts.clear()
        state["linked"] = 0

    def count(name: str, mark: int, article: bool, by: int) -> None:
        state["article"] += by * article
        state["hard"] += by * (mark == HARD)
        state["heading"] += by * (name in HEADINGS)
        state["links"] += by * (name == "a")
        open_names[name] += by

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if state["links"]:
                state["linked"] += _size(text.strip())

    def end(name: str) -> None:
        while open_names[name]:
            inner = stack.pop()
            count(*inner, -1)
            if inner[1] in (PART, WHOLE):
                state["marked"] = state["marked"].parent
            if inner[0] == name:
                return

    at = 0
    tokens = _tokens(page)
    token = next(tokens, None)
    while token:
        say(page[at : token[0]])
        tag, at = page[token[0] : token[1]], token[1]
        further = None
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                say(tag[9:].removesuffix("]]>"))
        else:
            name = _NAME.match(tag).group(1).lower()
            closing = tag[1] == "/"
            if name in _RAW_END and not closing:
                if not tag.endswith("/>"):
                    over = _RAW_END[name].search(page, at)
                    further = at = over.end() if over else len(page)
                parts.append(" ")
            else:
                if name in BLOCK:
                    close()
                if closing:
                    end(name)
                elif name not in VOID and not tag.endswith("/>"):
                    if name in ENDS_PARAGRAPH and any(n == "p" for n, *_ in stack[-4:]):
                        end("p")
                    mark = _mark(name, tag)
                    article = name in ARTICLE and not mark
                    if article and state["marked"]:
                        state["marked"].has_article = True
                    stack.append((name, mark, article))
                    if mark in (PART, WHOLE):
                        state["marked"] = _Marked(mark, state["marked"])
                        holders.append(state["marked"])
                    count(name, mark, article, 1)
        try:
            token = tokens.send(further)
        except StopIteration:
            token = None
    say(page[at:])
    close()
    for holder in reversed(holders):
        if holder.parent and holder.has_article:
            holder.parent.has_article = True
    return found, holders


def _language_known(found: list[_Block]) -> bool:
    """Whether the unlinked longer blocks hold stop words as texts in a known language do. Blocks that names mark,
    such as notices, are only asked where there are no others."""
    plain = [b for b in found if not b.hard and b.size >= SHORT and b.linked <= MANY_LINKS * b.size]
    counts = [b.stop_words() for b in plain if not b.marked] or [b.stop_words() for b in plain]
    stop, words = sum(c[0] for c in counts), sum(c[1] for c in counts)
    return stop >= SOME_STOP_WORDS * words and stop > 0


def _first_pass(block: _Block, article: bool, known: bool) -> str:
    """The label of a block by itself; ``article`` if it lies in an article that counts, ``known`` if stop words do."""
    size = block.size
    links = block.linked / size
    if links > MANY_LINKS:
        return "bad"
    if "©" in block.text and size < LONG:
        return "bad" if not article else "short"
    if size < SHORT:
        return "short" if not block.linked or article else "bad"
    stop, words = block.stop_words() if known else (1, 1)
    if stop >= MANY_STOP_WORDS * max(1, words):
        return "good" if size >= LONG else "near-good"
    if stop >= SOME_STOP_WORDS * max(1, words):
        return "near-good"
    return "short" if article else "bad"


def _overruled(holder: _Marked, good: int, article_good: int) -> bool:
    """Whether a marked element holds so much of the page's good text that its name cannot be meant."""
    if not good:
        return holder.has_article
    if holder.mark == WHOLE and not holder.has_article:
        return False
    return 2 * holder.good > good and holder.article_good == article_good


def _weigh(found: list[_Block], holders: list[_Marked], known: bool) -> tuple[list[bool], bool]:
    """For each block whether its surroundings are unwanted, and whether the page's articles count."""
    first = [_first_pass(b, False, known) for b in found]
    kind = "good" if any(k == "good" and not b.hard for k, b in zip(first, found)) else "near-good"
    sizes = [b.size if k == kind and not b.hard else 0 for k, b in zip(first, found)]
    unwanted = [b.hard for b in found]
    # Whole names without an article first: long comments must not count when the others are weighed.
    for mark, has_article in ((WHOLE, (False,)), (WHOLE, (True,)), (PART, (False, True))):
        open_ = [size if not bad else 0 for size, bad in zip(sizes, unwanted)]
        good, article_good = sum(open_), sum(n for n, b in zip(open_, found) if b.article)
        for h in holders:
            h.good = h.article_good = 0
        for n, b in zip(open_, found):
            if b.marked:
                b.marked.good += n
                b.marked.article_good += n * b.article
        for h in reversed(holders):  # what an element holds, its parent holds too
            if h.parent:
                h.parent.good += h.good
                h.parent.article_good += h.article_good
        for h in holders:
            judged = h.mark == mark and h.has_article in has_article
            h.bad = judged and not _overruled(h, good, article_good) or h.parent is not None and h.parent.bad
        unwanted = [u or b.marked is not None and b.marked.bad for u, b in zip(unwanted, found)]
    inside = [n for n, b, bad in zip(sizes, found, unwanted) if not bad and b.article]
    outside = [n for n, b, bad in zip(sizes, found, unwanted) if not bad and not b.article]
    return unwanted, bool(inside) and sum(inside) >= sum(outside)


def labelled(found: list[_Block], holders: list[_Marked]) -> list[bool]:
    """For each block whether it is part of the main text."""
    known = _language_known(found)
    unwanted, counts = _weigh(found, holders, known)
    inside = [counts and b.article for b in found]
    labels = ["bad" if bad else _first_pass(b, a, known) for b, bad, a in zip(found, unwanted, inside)]
    for best in ("good", "near-good", "short"):
        if best in labels or any(inside):
            labels = ["good" if label == best else label for label in labels] if not any(inside) else labels
            break
    # Where the articles count, what lies outside has them for a bad neighbour.
    seen = ["bad" if a else label for label, a in zip(labels, inside)]
    before, after = [None] * len(found), [None] * len(found)
    last = None
    for i, label in enumerate(seen):
        before[i] = last
        last = label if label in ("good", "bad") else last
    last = None
    for i in range(len(found) - 1, -1, -1):
        after[i] = last
        last = seen[i] if seen[i] in ("good", "bad") else last
    kept = []
    for i, (block, label) in enumerate(zip(found, labels)):
        around = {before[i], after[i]}
        if label in ("good", "bad"):
            kept.append(label == "good")
        elif inside[i]:
            kept.append(True)
        elif label == "near-good":
            kept.append("good" in around)
        else:
            kept.append(around == {"good"} or block.heading and after[i] == "good")
    return kept


def main_text(page: str | None) -> str:
    found, holders = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, labelled(found, holders)) if keep)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with text and n_chars; earlier columns of these names are replaced.

    NULL and empty pages give an empty text. Broken markup is read as far as it goes: unclosed
    elements end with what holds them, an unclosed script or comment with the page.
    """
    made = ("text", "n_chars")
    others = [c for c in pages.columns if c not in (html_col, *made)]
    own = pages.select(*others, F.col(html_col).alias("_page_html"))
    schema = T.StructType([own.schema[c] for c in others] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                texts = [main_text(p) for p in piece.column(piece.num_columns - 1).to_pylist()]
                arrays = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *arrays], [*others, *made])

    return own.mapInArrow(run, schema)
