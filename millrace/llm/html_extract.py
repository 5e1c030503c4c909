"""Main text of web pages by site template removal.

Element subtrees are hashed (tag, text and children) and counted per host over all pages; a subtree that recurs on
many different pages of a host is part of the site's template and goes, as do the elements that never are article
text. The article itself, what holds it, and its own paragraphs are never taken for a template, so copies of one
article and stock sentences in it survive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.rows import fresh, per_text, row_key
from millrace.session import cut_lineage

#: Different pages of a host on which a subtree must stand, and the share of a page's text that it may hold at most.
MIN_PAGES, MAX_SHARE = 5, 0.5
#: Template hashes that are sent to every task; beyond that, pages are joined with their own.
BROADCAST_HASHES = 1_000_000

# Parts of the markup language.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style title textarea noscript template iframe xmp noembed noframes".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}}
_CLOSED_BY_LIKE |= {"td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "table", "select"}

# What is no article text, by tag, role, and whole token of a class or id.
_NEVER = set(
    "head script style title noscript template iframe nav header footer aside form button select textarea input"
    " object svg canvas audio video map dialog menu".split()
)
_NEVER_ROLE = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_NEVER_WORD = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu"
    " menubar breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus cookie cookies consent gdpr"
    " notice notices banner newsletter subscribe subscription signup share sharing social related recommended popup modal"
    " overlay toolbar widget pagination pager skip".split()
)
_NEVER_WORD |= {f"{a}-{b}" for a in ("site", "page", "main", "global") for b in ("header", "footer", "nav", "navigation", "menu", "sidebar")}
_NEVER_WORD |= set(
    "nav-bar side-bar nav-menu cookie-banner cookie-notice cookie-consent related-posts related-articles related-links"
    " share-buttons social-share social-links comment-list comments-section ad-slot ad-container ad-banner".split()
)
_ROOTS = {"html", "body", "article", "main"}
_STOPS = {*_CLOSED_BY_LIKE, *_SCOPE, *_ROOTS, "div"}
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "center", "fieldset"}

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_PLAIN = re.compile(r"[^>\"']*")
_ZEROS, _BEYOND = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_COMMENT = re.compile(r"comments?(-\d+)?")


class _TagEnds:
    """Where a tag that starts at some place ends: behind the next ``>`` outside quotes, or else behind the next one at all.

    Stretches from which the first kind of end was sought in vain are remembered, so all searches of a page together
    take time in proportion to its length.
    """

    def __init__(self, html: str) -> None:
        self.html, self.last = html, html.rfind(">")
        self.vain: bytearray | None = None

    def after(self, at: int) -> int:
        html, vain, seen = self.html, self.vain, []
        while not (vain and at < len(html) and vain[at]):
            stop = _PLAIN.match(html, at).end()
            seen.append((at, stop))
            if stop >= len(html):
                break
            if html[stop] == ">":
                return stop + 1
            at = html.find(html[stop], stop + 1) + 1
            if not at:
                break
        vain = self.vain = vain or bytearray(len(html) + 1)
        for start, stop in seen:
            vain[start : stop + 1] = b"\1" * (stop + 1 - start)
        return html.index(">", seen[0][0] if seen else at) + 1


def _marks(html: str, at: int, ends: _TagEnds) -> tuple[int, int, str | None, str | None, str]:
    """The next mark from ``at`` on: its start and end, whether it closes, its tag (None: no element), its attributes."""
    found = _MARK.search(html, at)
    if found and found.start() > ends.last:  # no tag ends any more, only a comment may run on to the end of the page
        start = html.find("<!--", found.start())
        return (start, len(html), None, None, "") if start >= 0 else (-1, -1, None, None, "")
    if not found:
        return -1, -1, None, None, ""
    if found[1]:
        end = html.find("-->", found.end())
        return found.start(), len(html) if end < 0 else end + 3, None, None, ""
    if found[3] is None:
        return found.start(), html.index(">", found.end() - 1) + 1, None, None, ""
    end = ends.after(found.end())
    return found.start(), end, found[2], found[3].lower(), html[found.end() : end - 1]


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no article text whatever it holds, and whether it is none by its name, role or as a form."""
    if tag in _NEVER and tag != "form":
        return True, False
    by_name = tag == "form"
    if tag in ("html", "body") or not attributes.strip():
        return False, by_name
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            return True, False
        if name == "role" and value in _NEVER_ROLE:
            by_name = True
        if name in ("class", "id"):
            tokens = value.replace("_", "-").split()
            if tag not in ("article", "main") and not _NEVER_WORD.isdisjoint(tokens):
                by_name = True
            if tag == "article" and any(map(_COMMENT.fullmatch, tokens)):
                return True, False
    return False, by_name


class Page:
    """Elements in order of their start, and the text pieces between them.

    ``tags``, ``parents``, ``bad`` (no article text), ``article`` (inside an article element) and ``hashes`` have one
    value for each element; ``pieces`` are (element, text, starts a block).
    """

    def __init__(self, html: str, host: str) -> None:
        self.tags, self.parents, self.bad, self.article = ["#"], [0], [False], [False]
        self.hashes, self.sizes, self.holds = [0], [0], [False]
        self._by_name = [False]
        self.pieces: list[tuple[int, str, bool]] = []
        self._seed = xxhash.xxh32_intdigest(host)
        self._open, self._inner = [0], [[]]
        self._near_block, self._near_stop = [0], [0]  # per open element: place of the nearest such one, itself included
        self._count = Counter()  # open elements by tag
        self._fresh = True
        at, ends = 0, _TagEnds(html)
        while True:
            start, end, closing, tag, attributes = _marks(html, at, ends)
            if start < 0:
                break
            self._text(html[at:start])
            at = end
            if tag is None:
                continue
            if closing:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(html, at)
                self._close()
                at = close.start()
        self._text(html[at:])
        while len(self._open) > 1:
            self._close()
        self._judge()

    def _judge(self) -> None:
        """Names, roles and forms remove no element that holds an article, or most paragraph text of a page without one."""
        paragraphs, counts = [0] * len(self.tags), [0] * len(self.tags)
        if not self.holds[0] and True in self._by_name:
            for node in range(len(self.tags) - 1, 0, -1):
                if self.tags[node] == "p":
                    paragraphs[node], counts[node] = self.sizes[node], 1
                paragraphs[self.parents[node]] += paragraphs[node]
                counts[self.parents[node]] += counts[node]
        for node in range(1, len(self.tags)):
            most = counts[node] > 1 and 2 * paragraphs[node] > paragraphs[0]
            root = self.tags[node] in ("article", "main")
            named = self._by_name[node] and (root or not (self.holds[node] or most))
            self.bad[node] = self.bad[node] or named or self.bad[self.parents[node]]

    def _text(self, text: str) -> None:
        if text:
            if "&#" in text:  # numbers of any length, beyond what int() reads
                text = _BEYOND.sub("\ufffd", _ZEROS.sub("&#", text))
            text = unescape(text) if "&" in text else text
            node = self._open[-1]
            self.pieces.append((node, text, self._fresh))
            self._fresh = False
            plain = " ".join(text.split())
            if plain:
                self._inner[-1].append(plain)
                self.sizes[node] += len(plain)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append((self._open[-1], " ", self._fresh))
            return
        if tag in _CLOSES_P and self.tags[self._open[self._near_block[-1]]] == "p":
            self._close_to(self._near_block[-1])
        if tag in _CLOSED_BY_LIKE:
            place = self._near_stop[-1]
            while place > 0:
                name = self.tags[self._open[place]]
                if name in _CLOSED_BY_LIKE[tag]:
                    self._close_to(place)
                    break
                if name in _SCOPE or name in _ROOTS or name == "div":
                    break
                place = self._near_stop[place - 1]
        if tag in _BLOCK:
            self._fresh = True
        if tag in _VOID:
            return
        parent = self._open[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        never, by_name = _unwanted(tag, attributes)
        self.bad.append(never)
        self._by_name.append(by_name)
        self.article.append(self.article[parent] or tag in ("article", "main"))
        self.hashes.append(0)
        self.sizes.append(0)
        self.holds.append(False)
        place = len(self._open)
        self._open.append(len(self.tags) - 1)
        self._inner.append([])
        self._near_block.append(place if tag in _BLOCK else self._near_block[-1])
        self._near_stop.append(place if tag in _STOPS else self._near_stop[-1])
        self._count[tag] += 1

    def _end(self, tag: str) -> None:
        if not self._count[tag]:
            return
        for place in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[place]] == tag:
                self._close_to(place)
                return

    def _close_to(self, place: int) -> None:
        while len(self._open) > place:
            self._close()

    def _close(self) -> None:
        node, inner = self._open.pop(), self._inner.pop()
        self._near_block.pop(), self._near_stop.pop()
        tag, parent = self.tags[node], self.parents[node]
        self._count[tag] -= 1
        if tag in _BLOCK:
            self._fresh = True
        value = xxhash.xxh3_64_intdigest("\x1f".join([tag, *inner]), self._seed)
        self.hashes[node] = value
        self.sizes[parent] += self.sizes[node]
        self.holds[parent] |= self.holds[node] or tag in ("article", "main")
        self._inner[-1].append(f"\x1e{value}")

    def templates(self) -> Iterator[tuple[int, int]]:
        """(element, hash) of the subtrees that may be a template."""
        whole = self.sizes[0]
        for node in range(1, len(self.tags)):
            tag = self.tags[node]
            if tag in _ROOTS or self.holds[node] or not self.sizes[node] or tag not in _BLOCK:
                continue
            if self.article[node] and tag not in _CONTAINERS:
                continue
            if self.sizes[node] <= MAX_SHARE * whole:
                yield node, self.hashes[node]

    def text(self, gone: set[int]) -> str:
        """The blocks that are left, without the elements ``gone`` and all that they hold."""
        dropped = list(self.bad)
        for node in range(1, len(dropped)):
            dropped[node] = dropped[node] or node in gone or dropped[self.parents[node]]
        root = None
        for kind in ("article", "main"):
            if any(t == kind and not dropped[i] for i, t in enumerate(self.tags)):
                root = kind
                break
        inside = [root is None] * len(self.tags)
        for node in range(1, len(inside)):
            inside[node] = inside[self.parents[node]] or self.tags[node] == root
        blocks: list[str] = []
        block: list[str] = []
        for node, text, starts in self.pieces:
            if starts and block:
                blocks.append("".join(block))
                block = []
            if inside[node] and not dropped[node]:
                block.append(text)
        blocks.append("".join(block))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest[2] or rest[0], maxsplit=1)[0].rpartition("@")[2].lower()


def _hashes(html: bytes, url: str | None) -> tuple:
    page = Page(html.decode("utf-8", "replace"), host_of(url))
    return (sorted({_signed(h) for _, h in page.templates()}), _signed(xxhash.xxh3_64_intdigest(html)))


def extract(
    pages: DataFrame,
    keep: tuple[str, ...] = ("page_id", "url"),
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_pages: int = MIN_PAGES,
    broadcast_hashes: int = BROADCAST_HASHES,
) -> DataFrame:
    """``keep``, text and n_chars of every page.

    NULL and empty pages, and pages without article text, give an empty text. Pages without a URL count as one host.
    Exact copies of a page count once for the templates; repeated rows and NULL ids are rows like any other. A page
    that would lose all its text to templates keeps it. The template hashes are broadcast if there are at most
    ``broadcast_hashes``; else each page is joined with its own.
    """
    fields = T.StructType().add("hashes", T.ArrayType(T.LongType())).add("page", "long")
    found = per_text(pages, lambda: _hashes, fields, (), html, given=(url,))
    each = found.select(F.explode("hashes").alias("h"), "page").distinct()
    common = each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("h")
    common = cut_lineage(common)
    if common.count() <= broadcast_hashes:
        known = np.sort(np.array([r.h for r in common.toLocalIterator()], np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(known)
        return per_text(pages, _reader(shared), _TEXT, keep, html, given=(url,))
    a, b, mine = fresh(pages, "__a"), fresh(pages, "__b"), fresh(pages, "__hashes")
    key = row_key(F.col(f"`{page_id}`"), F.col(f"`{url}`"), F.col(f"`{html}`"))
    keyed = pages.withColumns({a: key[0], b: key[1]})
    own = per_text(keyed, lambda: _hashes, fields, (a, b), html, given=(url,)).select(a, b, F.explode("hashes").alias("h"))
    own = own.join(common, "h", "left_semi").groupBy(a, b).agg(F.collect_set("h").alias(mine))  # of one page
    return per_text(keyed.join(own, [a, b], "left"), _reader(None), _TEXT, keep, html, given=(url, mine))


_TEXT = T.StructType().add("text", "string").add("n_chars", "long")


def _reader(shared):
    def make():
        everywhere = set(shared.value.tolist()) if shared is not None else set()

        def read(html: bytes, url: str | None, own: list[int] | None = None) -> tuple:
            page = Page(html.decode("utf-8", "replace"), host_of(url))
            known = everywhere if own is None else set(own)
            gone = {node for node, h in page.templates() if _signed(h) in known}
            text = page.text(gone) or page.text(set())
            return text, len(text)

        return read

    return make
