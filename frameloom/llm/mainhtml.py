"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block of text. A line weighs what it holds outside links, a heading all of it; lines of menus, forms, adverts and
other furniture weigh nothing and part what is around them. Weights are summed over sliding windows of lines: a surge opens a region,
a dive to nothing closes it, and the text between them is kept.
"""

from __future__ import annotations

import bisect
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import SLICE_BYTES, slices

#: Lines of a window.
WINDOW = 3
#: Share of the page's heaviest window that a region's heaviest one must have, on pages without an element for the article.
LEAST_PEAK = 0.2

# Fixed names of HTML elements.
RAW = frozenset("script style textarea noscript template iframe svg math object canvas audio video select title noembed noframes xmp".split())
FURNITURE = frozenset("nav footer aside form dialog menu button head".split())
HOLDERS = frozenset("html body div section header main article ul ol dl table tbody thead tr figure fieldset details center".split()) | FURNITURE
BLOCKS = HOLDERS | frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre address td th caption figcaption hr summary hgroup legend option label".split())
SECTIONS = frozenset("div section header footer main article nav aside".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
#: Words of class, id and role that mark furniture, whole or before or behind a hyphen or underscore.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer "
    "complementary contentinfo search cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus reply replies "
    "discussion share sharing social related recommended recommendations recirc pagination pager toolbar widget skip masthead topbar".split()
)
#: Marks that stand for a page's own parts, so that they count in a class only as a whole (an article-header is no header).
PAGE_PARTS = frozenset(("header", "site-header", "page-header", "site-footer", "page-footer"))
#: Words beside a mark that say it is not this element, but one near it (has-sidebar, no-comments).
NEIGHBOURS = frozenset("has have no not with without below above toggles".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
_SPACE, _JOINT = re.compile(r"\s+"), re.compile("[-_]+")
_STYLE_NONE = re.compile(r"display\s*:\s*none", re.I)


def _marked(attributes: str) -> bool:
    """Whether an element's attributes say that it is furniture or hidden."""
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() == "hidden" or (name.lower() == "aria-hidden" and value == "true"):
            return True
        for word in value.split():
            parts = _JOINT.split(word)
            if NEIGHBOURS.isdisjoint(parts) and (word in PAGE_PARTS or parts[0] in MARKS or parts[-1] in MARKS):
                return True
    return bool(_STYLE_NONE.search(attributes))


def _tags(page: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of tags, comments (no name) and whole raw elements."""
    out, at, folded = [], 0, None
    while (m := _TAG.search(page, at)) is not None:
        slash, name, attributes, end = m[1] or "", (m[2] or "").lower(), m[3] or "", m.end()
        if name in RAW and not slash and not attributes.rstrip().endswith("/"):
            if folded is None:
                folded = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            close = folded.find(f"</{name}", end)
            stop = page.find(">", close) if close >= 0 else -1
            end = len(page) if stop < 0 else stop + 1
        out.append((m.start(), end, slash, name, attributes))
        at = end
    return out


def _ends(tags: list) -> dict[int, int]:
    """For start tags that are closed, the place of their end tag among the tags, by names alone; a new p closes an open one."""
    open_at: dict[str, list[int]] = {}
    ends = {}
    for k, (_, _, slash, name, _) in enumerate(tags):
        own = open_at.setdefault(name, [])
        if own and (slash or name == "p"):
            ends[own.pop()] = k
        if not slash:
            own.append(k)
    return ends


def _lines(page: str) -> tuple[list[str], list[int], list[bool], list[int]]:
    """Text, weight, whether it is in an article, and the section around it, for each line of a page; an empty line stands at the edge of a holder, WINDOW
    of them at the edge of furniture, so that the blocks dive there."""
    tags = _tags(page)
    ends = _ends(tags)
    sections = [k for k, t in enumerate(tags) if t[3] in SECTIONS and not t[2]]
    blocks = [k for k, t in enumerate(tags) if t[3] in BLOCKS]

    def reach(k: int, name: str) -> int:
        """The tag at which furniture that starts at tag k ends; if nobody closes it, the next section or, of a lesser element, block."""
        after = sections if name in HOLDERS else blocks
        place = bisect.bisect_right(after, k)
        return ends.get(k, after[place] if place < len(after) else len(tags))

    texts, weights, inside, owners, words, around = [], [], [], [], [], [(-1, len(tags) + 1)]
    furniture = article = head = -1  # the tags up to which they last
    linked, link, heading, at = 0, False, False, 0

    def end(k: int, empty: int) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(words)).strip()
        if text and (k > head or heading):
            texts.append(text)
            weights.append(len(text) if heading else max(0, len(text) - linked))
            inside.append(k <= article)
            owners.append(around[-1][0])
        while texts and any(texts[-empty:] if empty else ()):
            texts.append("")
            weights.append(0)
            inside.append(k <= article)
            owners.append(around[-1][0])
        words.clear()
        linked = 0

    for k, (start, stop, slash, name, attributes) in enumerate([*tags, (len(page), len(page), "/", "html", "")]):
        if start > at and k > furniture:
            words.append(entities.unescape(page[at:start]))
            linked += len(words[-1].strip()) if link else 0
        at = stop
        if name == "br":
            words.append(" ")
        elif name == "a":
            link = not slash
        own = not slash and k >= furniture and (name in FURNITURE or (name == "header" and k > article) or (name not in ("html", "body", *ARTICLES) and bool(attributes) and _marked(attributes)))
        own = own or (name == "article" and not slash and k >= furniture and _marked(attributes))
        if name in BLOCKS or own:
            end(k, WINDOW if own or k == furniture else int(name in HOLDERS))
            link = link and name not in HOLDERS
            heading = name in HEADINGS and not slash
        while around[-1][1] <= k:
            around.pop()
        if name in SECTIONS and not slash and k in ends:
            around.append((k, ends[k]))
        if own:
            furniture = reach(k, name)
        elif not slash and k > furniture:
            if name in ARTICLES:
                article = max(article, ends.get(k, len(tags)))
            elif name == "header":
                head = reach(k, name)
    return texts, weights, inside, owners


def regions(weights: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(first, end) of the lines between a surge and the dive behind it.

    blocks[i] sums WINDOW lines from i on. A surge is where a block rises from nothing, by the first line in it that weighs; a dive
    is where one falls to nothing again. Of these regions those count whose heaviest block has the share `least` of the heaviest of all.
    """
    total = np.concatenate([[0], np.cumsum(weights)])
    at = np.arange(len(weights))
    blocks = total[np.minimum(at + WINDOW, len(weights))] - total[at]
    if not len(blocks) or not blocks.max():
        return []
    edge = np.diff((blocks > 0).astype(np.int8), prepend=0, append=0)
    surges, dives = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(a + np.flatnonzero(weights[a:b])[0]), int(b)) for a, b in zip(surges, dives) if blocks[a:b].max() >= least * blocks.max()]


def main_text(page: str | None) -> str:
    """The main text of one page: blocks joined by empty lines; null, empty and textless pages give an empty string."""
    if not page:
        return ""
    texts, weights, inside, owners = _lines(page)
    weight, held = np.array(weights, np.int64), np.array(inside, bool)
    text = np.array([bool(t) for t in texts], bool)
    marked = bool((text & held).any())
    if marked:  # the page says where its article is: all lines in it weigh, a line of links too
        weight = np.where(text & held, np.maximum(weight, 1), 0)
    kept = np.zeros(len(texts), bool)
    for first, end in regions(weight, 0.0 if marked else LEAST_PEAK):
        kept[first:end] = True
    if not marked:  # what furniture has parted from the text beside it, in the same section
        own = set(np.array(owners)[kept & (weight > 0)])
        for first, end in regions(weight, 0.0):
            kept[first:end] |= any(owners[k] in own and weight[k] for k in range(first, end))
    return "\n\n".join(texts[k] for k in np.flatnonzero(kept & text & (held | (not marked))))


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without text outside furniture, give an empty text. Null ids and urls pass through, repeated
    rows stay, other columns aren't read. A br is white space of its block. Furniture that is never closed ends where an article
    starts. A narrow map over record batches; a task holds SLICE_BYTES of pages, or one longer page.
    """

    def run(batches):
        for part in slices(batches, 2, SLICE_BYTES):
            texts = [main_text(p) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
