"""Main text of web pages by tree scoring.

A page is read once into a tree of its elements. Blocks with text pass points to their ancestors:
one each, one per comma, and up to three for length; the parent gets them whole, the next a half,
the one above a third. A container's points are discounted by the share of its text inside links.
The best container is kept, and with it those of its siblings that score or read like it.
Scripts, controls and the like never count. Navigation, headers, footers, asides, forms of controls,
hidden elements and those whose class, id or role names such a part are set aside, unless they hold the
article: by a name of their own or an element inside, or because next to nothing is left without them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm import common

# Element names by their part in a page.
RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
NEVER = frozenset("""
    head script style textarea title noscript iframe template svg math button select option menu dialog object embed
    canvas audio video map datalist""".split())
FORMS = frozenset("form fieldset".split())
ASIDE = frozenset("nav header footer aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""
    html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
    blockquote pre figure figcaption address details summary center hgroup""".split()) | NEVER | FORMS | ASIDE
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body article section main div table td th ul ol dl blockquote aside form".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
OUTSIDE = re.compile(r"""ad|ads|adv|advert\w*|adsense|adbox|banner|breadcrumbs?|captcha|comments?|commentlist|
    consent|cookies?|disqus|disclaimer|footer|footnav|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|
    notification|outbrain|overlay|pagination|pager|paywall|popup|promo\w*|related|replies|respond|search|share|sharing|
    shoutbox|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|taboola|toolbar|widget|complementary|contentinfo""", re.X)
INSIDE = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|entry|hentry|main|post|story|text)(?:$|[^a-z])", re.I)
#: Words that say where or how many, not what.
BESIDE = frozenset("""
    area bar block bottom box buttons global group icons inner item items left link links list main mobile page posts
    primary right row secondary section site slot sticky top unit""".split())
#: Text characters outside links that a form has for each control when it is more than its controls.
PER_CONTROL = 50
#: What is left of a page reads like a text of its own from so many characters outside links, and from
#: this share of the part set aside.
READS, READS_SHARE = 250, 0.05


@lru_cache(maxsize=1 << 16)
def judged(token: str) -> tuple[bool, bool]:
    """Whether a whole class token names a part outside the text, and whether it names the text.

    All of its words must be known: ``cookie-notice`` is outside, ``with-sidebar`` and ``nav-closed``
    are not. After words for the text the last one decides: ``post-comments``.
    """
    parts = [x for x in re.split(r"[^a-z]+", token.lower()) if x]
    outer = [bool(OUTSIDE.fullmatch(x)) for x in parts]
    inner = [not o and bool(INSIDE.fullmatch(x)) for o, x in zip(outer, parts)]
    known = all(o or i or x in BESIDE for o, i, x in zip(outer, inner, parts))
    loose = any(i and x not in BESIDE for i, x in zip(inner, parts))
    return known and any(outer) and (outer[-1] or not loose), known and any(inner) and not any(outer)


class Page:
    """Elements in page order (a parent before its children) and the text that counts."""

    def __init__(self, html: str):
        self.parent, self.name, self.bonus = [-1], ["#page"], [0.0]
        self.aside = [""]  # why an element is set aside: "tag", "name", "hidden", "form" or not at all
        self.marked = [False]  # whether it names the text
        self.controls: list[int] = []  # the element each control lies in
        self.text: list[tuple[int, str, bool]] = []  # element, text, whether inside a link
        self.open, self.skipped, self.links = [0], 0, 0
        self.depths: dict[str, list[int]] = {}  # where in `open` the elements of a name are
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            found = TAG.search(html, at)
            if not found:
                self._say(html[at:])
                return
            if found.start() > at:
                self._say(html[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            name = name.lower()
            if found[1] or found[4]:
                self._close(name)
                continue
            rest = found[3] if found[2] else found[6]
            if name in ("input", "select", "textarea", "button") and not (name == "input" and re.search(r"\btype\s*=\s*[\"']?hidden\b", rest, re.I)):
                self.controls.append(self.open[-1])
            if name in VOID:
                if name in ("br", "hr"):
                    self._say("\n")
                continue
            if name in RAW:
                end = re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if not rest.endswith("/"):
                self._enter(name, rest)
            elif name in BLOCK:
                self._say("\n")

    def _enter(self, name: str, rest: str) -> None:
        if name in BLOCK:
            self._end_open("p", SCOPE)
        if name in CLOSED_BY:
            for other in CLOSED_BY[name]:
                self._end_open(other, {"ul", "ol", "dl", "table"})
        self.parent.append(self.open[-1])
        self.name.append(name)
        self.depths.setdefault(name, []).append(len(self.open))
        self.open.append(len(self.name) - 1)
        values = [(k.lower(), v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)] if rest.strip() else []
        labels = [v for k, v in values if k in ("class", "id", "role", "aria-label")]
        tokens = [t for k, v in values if k in ("class", "id", "role") for t in v.split()] + [v for k, v in values if k == "aria-label"]
        verdicts = [judged(t) for t in tokens]
        hidden = any(k == "hidden" and v.lower() != "false" or k == "aria-hidden" and v.lower() == "true"
                     or k == "style" and UNSEEN.search(v) for k, v in values)
        firm = name in ("article", "main", "body", "html")
        named = any(inside for _, inside in verdicts)
        self.marked.append(name in ("article", "main") or named)
        self.bonus.append(25.0 if name in ("article", "main") else 10.0 if any(INSIDE.search(v) for v in labels) else 0.0)
        self.aside.append("hidden" if hidden else "tag" if name in ASIDE else "form" if name in FORMS
                          else "name" if not firm and not named and any(outside for outside, _ in verdicts) else "")
        if self.skipped or name in NEVER:
            self.skipped += 1
        if name == "a":
            self.links += 1

    def _last(self, name: str) -> int:
        """Depth of the innermost open ``name``, 0 without one."""
        depths = self.depths.get(name)
        return depths[-1] if depths else 0

    def _end_open(self, name: str, until: frozenset | set) -> None:
        """Close the nearest open ``name`` that no element of ``until`` separates from here."""
        depth = self._last(name)
        if depth and depth >= max(map(self._last, until)):
            self._pop(depth)

    def _close(self, name: str) -> None:
        if name == "p":
            self._end_open("p", SCOPE)
        elif name in BLOCK:
            self._end_open(name, {name})
        else:  # an inline end tag does not close the block around it
            self._end_open(name, SCOPE)

    def _pop(self, depth: int) -> None:
        while len(self.open) > depth:
            name = self.name[self.open.pop()]
            self.depths[name].pop()
            if name == "a":
                self.links -= 1
            if self.skipped:
                self.skipped -= 1

    def _say(self, text: str) -> None:
        if not self.skipped:
            self.text.append((self.open[-1], text, self.links > 0))

    def _set_aside(self) -> list[bool]:
        """Whether each element lies in a part that is set aside."""
        size, parent, aside = len(self.name), self.parent, list(self.aside)
        held = [0] * size  # characters outside links
        for n, text, link in self.text:
            held[n] += 0 if link or not text.strip() else len(text.strip())
        own, controls = list(held), [0] * size
        for n in self.controls:
            controls[n] += 1
        mains, articles = [x == "main" for x in self.name], [x == "article" for x in self.name]
        barred, free_article = [False] * size, False
        for n in range(1, size):
            barred[n] = barred[parent[n]] or bool(aside[n]) and aside[n] != "form"
        for n in range(size - 1, 0, -1):
            held[parent[n]] += held[n]
            mains[parent[n]] |= mains[n]
            articles[parent[n]] |= articles[n]
            free_article |= self.name[n] in ("article", "main") and not barred[n] and held[n] > 0
        # From the inside out: what a form or a name outside the text holds besides the parts set aside in it.
        for n in range(size - 1, 0, -1):
            if aside[n] == "form" and own[n] and (own[n] >= PER_CONTROL * controls[n] or mains[n] or articles[n]):
                aside[n] = ""
            if aside[n] == "name" and (mains[n] or articles[n] and not free_article):
                aside[n] = ""
            if not aside[n]:
                own[parent[n]] += own[n]
                controls[parent[n]] += controls[n]
        off = [False] * size
        for n in range(1, size):
            off[n] = off[parent[n]] or bool(aside[n])
        # From the outside in: a part with most of the text, without which hardly any is left, is for scoring.
        left = own[0]
        read = max((own[n] for n in range(size) if self.marked[n] and not off[n]), default=0)
        off = [False] * size
        for n in range(1, size):
            if aside[n] and not off[parent[n]] and 2 * held[n] > held[0]:
                least = READS_SHARE * held[n]
                if left < max(READS, least) and read < max(1, least) and (aside[n] != "tag" or held[n] >= READS):
                    aside[n] = ""
                    left += own[n]
            off[n] = off[parent[n]] or bool(aside[n])
        return off

    def main_text(self) -> str:
        size = len(self.name)
        off = self._set_aside()
        block = list(range(size))  # the block an element's text belongs to
        for n in range(1, size):
            if self.name[n] not in BLOCK:
                block[n] = block[self.parent[n]]
        pieces = [(block[n], unescape(t), link) for n, t, link in self.text if not off[n]]
        length, linked, commas = [0] * size, [0] * size, [0] * size
        for n, text, link in pieces:
            count = len(text) if text.strip() else 0
            length[n] += count
            linked[n] += count * link
            commas[n] += text.count(",") + text.count("，") + text.count("、")
        points = list(self.bonus)
        for n in range(size):
            if length[n]:
                share = 1 + commas[n] + min(length[n] / 100, 3)
                share *= 1 - linked[n] / length[n]
                if self.name[n] in ("article", "main", "body", "#page"):
                    points[n] += share
                up = self.parent[n]
                for step in (1, 2, 3):
                    if up < 0:
                        break
                    points[up] += share / step
                    up = self.parent[up]
        for n in range(size - 1, 0, -1):
            length[self.parent[n]] += length[n]
            linked[self.parent[n]] += linked[n]
        score = [p * (1 - linked[n] / length[n]) if length[n] and block[n] == n else 0.0 for n, p in enumerate(points)]
        best = max(range(size), key=lambda n: (score[n], -n))
        if score[best] <= 0:
            best = 0  # nothing but links or loose words: all that was not set aside
        kept = [False] * size
        kept[best] = True
        for n in range(1, size):
            if self.parent[n] == self.parent[best] and n != best and length[n]:
                density = linked[n] / length[n]
                reads = self.name[n] in ("p", "h1", "h2", "pre", "blockquote") and density < 0.25
                kept[n] = reads or score[n] >= max(10.0, 0.2 * score[best])
        for n in range(1, size):
            kept[n] = kept[n] or kept[self.parent[n]]
        out, last = [], -1
        for n, text, _ in pieces:
            if kept[n]:
                out.append(text if n == last else " " + text)
            last = n
        return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty page, or one with nothing but what is set aside, has the empty text. Unclosed and
    cut-off markup is closed at the end. Repeated pages are reported once each; null ids and addresses
    pass. Other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema if f.name != "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch, "html"):
                texts = [main_text(h) for h in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(work, f"{kinds}, text string, n_chars long")
