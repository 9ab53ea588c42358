"""Page parsing: one Arrow-batched function for the texts, one for the links of a page.

The parser is only a stack of open elements over the standard library's tokenizer; everything that
happens to the texts and links afterwards is column expressions. Which elements matter is part of the
rules (``Rules``).
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactline.functions.seams import address_text
from contactline.rules import DEFAULT_RULES, HIDDEN_ARIA, HIDDEN_ATTRIBUTE, Rules

_TEXTS = [
    T.StructField("mailtos", T.ArrayType(T.StringType())),
    T.StructField("priority_text", T.StringType()),
    T.StructField("visible_text", T.StringType()),
]
TEXTS_TYPE = T.StructType(_TEXTS)
LINKS_TYPE = T.ArrayType(T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("in_zone", T.BooleanType()),
    T.StructField("href", T.StringType()),
    T.StructField("text", T.StringType()),
]))
PAGE_TYPE = T.StructType([*_TEXTS, T.StructField("links", LINKS_TYPE)])

# Elements without an end tag (HTML standard).
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr basefont bgsound "
    "command frame image isindex nextid spacer".split()
)
# Elements whose text is not part of a page's text even where they are shown.
_TEXT_APART = frozenset(("script", "style", "template", "rt", "rp"))


@dataclass(frozen=True)
class _Parts:
    """Which elements are hidden, come first, or hold links for visitors."""

    hidden: frozenset[str]
    hidden_styles: tuple[str, ...]
    priority: frozenset[str]
    classes: frozenset[str]
    ids: frozenset[str]
    zones: frozenset[str]

    @property
    def marked(self) -> frozenset[str]:
        """Elements that matter by their name; others only by their attributes."""
        return _TEXT_APART | self.hidden | self.priority | self.zones | {"a"}

    def is_hidden(self, tag: str, attrs: dict) -> bool:
        if tag in self.hidden or HIDDEN_ATTRIBUTE in attrs or attrs.get(HIDDEN_ARIA) == "true":
            return True
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return any(s in style for s in self.hidden_styles)

    def is_priority(self, tag: str, attrs: dict) -> bool:
        return (
            tag in self.priority
            or (attrs.get("id") or "") in self.ids
            or not self.classes.isdisjoint((attrs.get("class") or "").split())
        )


def _parts_of(rules: Rules) -> _Parts:
    return _Parts(
        frozenset(rules.hidden_tags), tuple(rules.hidden_styles), frozenset(rules.priority_tags),
        frozenset(rules.priority_classes), frozenset(rules.priority_ids),
        frozenset(rules.link_zone_tags))


class _OpenElements(HTMLParser):
    """Keeps the stack of open elements and hands out whole text nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, object]] = []
        self.open_count: dict[str, int] = {}
        self.pending: list[str] = []

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    # hooks
    def opened(self, tag: str, attrs: dict) -> object: ...
    def closed(self, tag: str, note: object) -> None: ...
    def text_node(self, text: str) -> None: ...

    def flush(self) -> None:
        if self.pending:
            text, self.pending = "".join(self.pending), []
            self.text_node(text)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_starttag(self, tag, attrs):
        self.flush()
        note = self.opened(tag, dict(attrs))
        if tag in _VOID:
            self.closed(tag, note)
        else:
            self.stack.append((tag, note))
            self.open_count[tag] = self.open_count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        # An end tag closes the nearest element of its name with all inside; a stray one nothing.
        while self.open_count.get(tag):
            name, note = self.stack.pop()
            self.open_count[name] -= 1
            self.closed(name, note)
            if name == tag:
                break

    def _split_here(self, _):
        self.flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _split_here

    def run(self, html: str):
        self.feed(html)
        self.close()
        self.flush()
        while self.stack:
            name, note = self.stack.pop()
            self.closed(name, note)
        return self


class _Page(_OpenElements):
    """One pass over a page: mailto links, visible text nodes, priority elements, anchors.

    A priority element is kept as a range of the visible text nodes.
    """

    def __init__(self, parts: _Parts):
        super().__init__()
        self.parts, self.marked = parts, parts.marked
        self.mailtos: list[str] = []
        self.nodes: list[str] = []
        self.ranges: list[list[int]] = []
        self.links: list[dict] = []
        self.anchor: tuple[dict, list[str]] | None = None
        self.hidden = self.apart = self.zones = 0

    def opened(self, tag, attrs):
        if not attrs and tag not in self.marked:
            return None
        href = attrs.get("href") if tag == "a" else None
        hidden = self.parts.is_hidden(tag, attrs)
        apart, zone = tag in _TEXT_APART, tag in self.parts.zones
        span = None
        if not hidden and not self.hidden and self.parts.is_priority(tag, attrs):
            span = [len(self.nodes), -1]
            self.ranges.append(span)
        self.hidden += hidden
        self.apart += apart
        self.zones += zone
        if tag == "a":
            self._end_anchor()  # links do not nest: a new one ends the one before
        if href is not None:
            self._start_anchor(href)
        return hidden, apart, zone, span

    def closed(self, tag, note):
        if note is None:
            return
        hidden, apart, zone, span = note
        self.hidden -= hidden
        self.apart -= apart
        self.zones -= zone
        if span is not None:
            span[1] = len(self.nodes)
        if tag == "a":
            self._end_anchor()

    def _start_anchor(self, href):
        if href.strip().lower().startswith("mailto:"):
            self.mailtos.append(href)
        link = {"pos": len(self.links), "in_zone": self.zones > 0, "href": href.strip(), "text": ""}
        self.links.append(link)
        self.anchor = (link, [])

    def _end_anchor(self):
        if self.anchor is not None:
            link, parts = self.anchor
            link["text"] = "".join(parts)
            self.anchor = None

    def text_node(self, text):
        if self.apart:
            return
        if not self.hidden:
            self.nodes.append(text)
        if self.anchor is not None:
            self.anchor[1].append(text.strip())

    @property
    def visible_text(self) -> str:
        return " ".join(self.nodes)

    @property
    def priority_text(self) -> str:
        """Texts of the priority elements, each whole, nested ones again."""
        return " ".join(" ".join(self.nodes[a:b]) for a, b in self.ranges)

    @property
    def priority_once(self) -> str:
        """What the priority texts can hold addresses in, in linear size, however deep they are."""
        return address_text(self.nodes, self.ranges)


def read_page(html: str | None, parts: _Parts = _parts_of(DEFAULT_RULES)) -> _Page:
    return _Page(parts).run(html or "")


# A text can hold an address only with an "@" or with something like "[at]".
_MAYBE_ADDRESS = re.compile(r"@|\[\s*at\s*\]|\(\s*at\s*\)", re.IGNORECASE)


def _if_address(text: str) -> str:
    return text if _MAYBE_ADDRESS.search(text) else ""


def _parser(kind):
    """A page function that is evaluated once per page. Left as deterministic, the optimizer would
    also evaluate it in the filters it infers from exploding the result."""
    return lambda fn: F.pandas_udf(fn, kind).asNondeterministic()


@cache
def texts_parser(rules: Rules = DEFAULT_RULES):
    """mailto links, text of the priority elements and all visible text of each page."""
    parts = _parts_of(rules)

    @_parser(TEXTS_TYPE)
    def parse_texts(html: pd.Series) -> pd.DataFrame:
        pages = (read_page(h, parts) for h in html)
        return pd.DataFrame(
            [(p.mailtos, p.priority_text, p.visible_text) for p in pages],
            columns=["mailtos", "priority_text", "visible_text"],
        )

    return parse_texts


@cache
def links_parser(rules: Rules = DEFAULT_RULES):
    """Anchors of each page, as written."""
    parts = _parts_of(rules)

    @_parser(LINKS_TYPE)
    def parse_links(html: pd.Series) -> pd.Series:
        return pd.Series([read_page(h, parts).links for h in html], dtype=object)

    return parse_links


@cache
def page_parser(rules: Rules = DEFAULT_RULES):
    """Everything at once. Texts that cannot hold an address come back empty: most pages have
    none, and their text need not travel back to the JVM."""
    parts = _parts_of(rules)

    @_parser(PAGE_TYPE)
    def parse_page(html: pd.Series) -> pd.DataFrame:
        pages = (read_page(h, parts) for h in html)
        return pd.DataFrame(
            [(p.mailtos, _if_address(p.priority_once), _if_address(p.visible_text), p.links)
             for p in pages],
            columns=["mailtos", "priority_text", "visible_text", "links"],
        )

    return parse_page


# Ship these functions to the workers by value: no need to install the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
