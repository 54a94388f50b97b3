"""Main text of HTML pages as a maximum-scoring subsequence.

A page is a run of words and tags. Words score positive and tags negative, with
weights from labelled pages: for each name of an element (section tags, classes,
ids, roles) the log of its share of content words over its share of others, for
each tag how often it stands outside content. The names around a word add up to
the evidence for it, nearer ones before outer ones, so a name is no veto. A
linear scan finds the contiguous region of the largest sum; inside it, places
whose words score negative (a nested form, an advert, reader comments) give no
text.

Labels: pages that mark their content by an article or main element teach what
surrounds it; at most `label_rows` pages are used, drawn by hash. Names that
labels hardly show say what their words imply, by two fixed lists.

Defined results: null or empty html gives an empty text; a null id or url is
kept; unclosed tags end with their parent; a stray quote in a tag is part of the
tag; unknown character references stay as they are; pages of any length are read
whole; of regions with equal sums the first counts; rows that repeat an id are
extracted one by one; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log, log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drawn, in_batches, slices

#: Comments, declarations, tags; text stands between.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>=]|=)*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_CAMEL, _WORD = re.compile(r"([a-z])([A-Z])"), re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "svg", "iframe", "select", "title", "math", "canvas", "object")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Tags whose start closes an open one of the same set.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What a name says of the words in its place, before labels are seen.
OUTSIDE = frozenset("nav navbar navigation menu menus header masthead footer aside sidebar sidebars form ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments discussion reply replies respond breadcrumb breadcrumbs pagination pager widget widgets toolbar button buttons copyright legal disclaimer skip toc tags".split())
INSIDE = frozenset("article main content body post entry story text".split())
#: Elements that say something of the words in them; others (p, ul, li, div, ...) occur in articles and outside.
SECTIONS = frozenset("article main nav header footer aside form menu dialog".split())
#: Evidence of a name before labels are seen, the bound of learned evidence, and from where on it is strong.
PRIOR, BOUND, STRONG = 2.0, 3.0, 2.0
#: Score of a word of a block that is mostly links, where labels say nothing of such blocks.
LINKED = -0.5


class Part:
    """Text of one block, with what decides its score."""

    __slots__ = ("article", "inside", "link", "places", "tags", "text", "words")

    def __init__(self, text: str, places: tuple[tuple[str, ...], ...], tags: tuple[str, ...], article: int, inside: bool, link: int) -> None:
        self.text, self.places, self.tags, self.article, self.inside, self.link = text, places, tags, article, inside, link
        self.words = len(text.split())


def _place(tag: str, attrs: str) -> tuple[str, ...]:
    """Names of an element: its tag, if that says something, and its classes, id and role."""
    found = [f"<{tag}>"] if tag in SECTIONS else []
    if attrs and "=" in attrs:
        for m in _NAMES.finditer(attrs):
            found += (m[1] or m[2] or m[3] or "").split()
    return tuple(dict.fromkeys(found))


def _hidden(attrs: str) -> bool:
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def parts(html: str | None) -> list[Part]:
    """Blocks of a page in order; tags are those that opened or closed before the block, places the names of the open elements, outermost first."""
    if not html:
        return []
    out: list[Part] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, names of the place, hidden
    buffer: list[str] = []
    tags: list[str] = []
    linked = 0
    at = 0
    articles = 0
    depth = {"article": 0, "main": 0, "a": 0, "hidden": 0}

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            if text:
                inside = bool(depth["article"] or depth["main"])
                out.append(Part(text, tuple(p for _, p, _ in stack if p), tuple(tags), articles if depth["article"] else 0, inside, linked))
                tags.clear()
            buffer.clear()
            linked = 0

    def pop() -> None:
        tag, _, hidden = stack.pop()
        depth["hidden"] -= hidden
        if tag in depth:
            depth[tag] -= 1

    while m := _TOKEN.search(html, at):
        if m.start() > at and not depth["hidden"]:
            text = html[at : m.start()]
            buffer.append(text)
            if depth["a"]:
                linked += len(text.split())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
            tags.append(tag)
        if m[1]:
            if tag in ("p", "br") and not any(t == tag for t, _, _ in stack):
                continue
            if any(t == tag for t, _, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _END:
            end = _END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if stack and (stack[-1][0] in _CLOSES.get(tag, ())):
            pop()
        elif tag in _ENDS_P and any(t == "p" for t, _, _ in stack[-6:]):
            while stack[-1][0] in INLINE:
                pop()
            if stack[-1][0] == "p":
                pop()
        hidden = bool(m[3] and _hidden(m[3]))
        articles += tag == "article" and not depth["article"]
        stack.append((tag, _place(tag, m[3]), hidden))
        depth["hidden"] += hidden
        if tag in depth:
            depth[tag] += 1
    if at < len(html) and not depth["hidden"]:
        buffer.append(html[at:])
    flush()
    return out


def _prior(name: str) -> float:
    """What a name says by its words: a word of a name of several counts in part."""
    words = _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())
    return sum(-PRIOR if w in OUTSIDE else 1.0 if w in INSIDE else 0.0 for w in words) / max(1, len(words)) * (2.0 if name in ("<article>", "<main>") else 1.0)


def evidence(part: Part, weights: dict[str, float]) -> float:
    """What the open elements say of a block's words, the nearer the stronger.

    Names add up, learned weights before the word lists. Strong evidence replaces
    what outer elements say to the contrary: an article in a place named after a
    sidebar is content, an advert in an article is not. An article in another
    one, or inside an element that is no content by its tag, is a teaser and says
    nothing new.
    """
    total, seen, closed = 0.0, False, False
    for names in part.places:
        said = 0.0
        for name in names:
            if name == "<article>":
                if seen:
                    continue
                seen = True
            said += weights[k] if (k := f"place {name}") in weights else _prior(name)
        said = max(-BOUND, min(BOUND, said))
        if closed and said > 0:
            continue
        closed = closed or (said <= -STRONG and any(n[0] == "<" for n in names))
        total = said if abs(said) >= STRONG and said * total < 0 else total + said
    return total


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in slices(batches):
        for html in batch.column("html").to_pylist():
            found = parts(html)
            if not any(p.inside for p in found):
                continue
            for p in found:
                if p.inside and evidence(p, {}) < 0:
                    continue  # boilerplate inside the article teaches neither
                counts["words", p.inside] += p.words
                if p.link * 2 > p.words:
                    counts["linked", p.inside] += p.words
                for name in {n for names in p.places for n in names}:
                    counts[f"place {name}", p.inside] += p.words
                for tag in p.tags:
                    counts[f"tag {tag}", p.inside] += 1
    if counts:
        yield pa.record_batch([pa.array([k for k, _ in counts]), pa.array([i for _, i in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["item", "inside", "n"])


def learn(pages: DataFrame, label_rows: int = 5000, most_items: int = 5000) -> dict[str, float]:
    """Weights of places and tags from up to label_rows pages that mark their content.

    The weight of a place, and of blocks that are mostly links, is the log of its
    share of content words over its share of other words, within BOUND; places of under 20 words keep what their names say.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    counted = drawn(marked.select("html"), F.col("html"), label_rows).transform(in_batches, _observe, "item string, inside boolean, n long").groupBy("item").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    rows = counted.orderBy(F.desc(F.col("a") + F.col("b")), "item").limit(most_items).collect()
    total = next((r for r in rows if r.item == "words"), None)
    if total is None:
        return {}
    out = {r.item: log((r.a + 1) / (total.a + 1)) - log((r.b + 1) / (total.b + 1)) if r.item == "linked" or r.item.startswith("place ") else log((r.a + 1) / (r.b + 1)) for r in rows if r.item != "words" and r.a + r.b >= 20}
    return {k: max(-BOUND, min(BOUND, v)) for k, v in out.items()}


def score(part: Part, weights: dict[str, float], marked: bool) -> float:
    """Score of a word of this part: positive, unless the places around it speak against it or it is mostly links.

    marked: the page has an article or main element, so words beyond it count
    for less. Boilerplate inside the article interrupts it at little cost and
    does not end it. A block whose words are mostly links, whatever its length,
    counts as such blocks do on the pages that mark their content; where that is
    for little, its cost grows with the log of its words, so that a long menu
    parts the text around it hardly more than a short one.
    """
    said = evidence(part, weights) - (1.0 if marked and not part.inside else 0.0)
    if said <= -0.9:
        return -1.0 / (1 + part.words) if part.inside else max(-PRIOR, said)
    if part.link * 2 <= part.words or part.inside:
        return 1.0
    linked = min(1.0, weights.get("linked", LINKED))
    return linked if linked > 0 else linked * log2(1 + part.words) / part.words


def tag_score(tag: str, weights: dict[str, float]) -> float:
    return -0.01 - 0.02 * max(0.0, min(2.0, -weights.get(f"tag {tag}", 0.0)))


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous stretch of largest sum, in one scan; (0, 0) if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def extract(html: str | None, weights: dict[str, float]) -> str:
    """Main text: blocks of the best region that score, joined by a space."""
    found = parts(html)
    marked = any(p.inside for p in found)
    words = [score(p, weights, marked) for p in found]
    sums: list[float] = []
    for p, w in zip(found, words, strict=True):
        sums += [sum(tag_score(t, weights) for t in p.tags), w * p.words]
    a, b = best_region(sums)
    kept = [p.text for i, (p, w) in enumerate(zip(found, words, strict=True)) if a <= 2 * i + 1 < b and w > 0]
    return " ".join(kept)


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, label_rows: int = 5000, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = learn(pages, label_rows) if weights is None else weights
    return pages.transform(in_batches, _extract(weights), "page_id long, url string, text string, n_chars long")
