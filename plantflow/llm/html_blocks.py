"""Leaf blocks of HTML pages: runs of text between block-level tags, with the elements that stand open around them.

One pass over the page keeps the open block elements, closes those whose end tags HTML lets authors leave out, and
drops comments, scripts and styles. Work is linear in the page. Malformed pages end where their last tag does.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: Element names of the HTML standard by how they nest.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; that of all but title is no text of the page either.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: A start tag closes the nearest open element of these names, unless one of the last names stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
_P_SCOPE = {"table", "td", "th", "caption", "button", "object", "template"}
_TAG = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
#: Elements open at once; a page with more of them keeps its text, but they count for nothing.
DEEPEST = 512


@dataclass(slots=True)
class Block:
    """A block's text, without the white space around it and with single spaces inside, and what stands around it."""

    text: str
    tag: str
    open_features: tuple
    linked: int


class _Open:
    """The open block elements and the features they bring, with their counts."""

    def __init__(self, features_of: Callable[[str, str], tuple]):
        self.features_of = features_of
        self.stack: list[tuple[str, tuple]] = []
        self.names: dict[str, int] = {}
        self.counts: dict[object, int] = {}
        self.lost = 0

    def push(self, tag: str, attributes: str) -> None:
        if len(self.stack) >= DEEPEST:
            self.lost += 1
            return
        found = self.features_of(tag, attributes)
        self.stack.append((tag, found))
        self.names[tag] = self.names.get(tag, 0) + 1
        for f in found:
            self.counts[f] = self.counts.get(f, 0) + 1

    def pop_through(self, tags: set | frozenset, until: set | frozenset = frozenset()) -> None:
        """Close the nearest element of these names and all inside it, unless one of `until` comes first."""
        if not any(self.names.get(t) for t in tags):
            return
        depth = len(self.stack) - 1
        while depth >= 0 and self.stack[depth][0] not in tags:
            if self.stack[depth][0] in until:
                return
            depth -= 1
        while len(self.stack) > max(depth, 0):
            tag, found = self.stack.pop()
            self.names[tag] -= 1
            for f in found:
                self.counts[f] -= 1
                if not self.counts[f]:
                    del self.counts[f]


def blocks(page: str, features_of: Callable[[str, str], tuple] = lambda tag, attributes: ()) -> Iterator[Block]:
    """The blocks of a page with text, in page order; features_of gives the features of a start tag."""
    open_ = _Open(features_of)
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def block() -> Block | None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        made = Block(text, open_.stack[-1][0] if open_.stack else "", tuple(open_.counts), linked) if text else None
        linked = 0
        return made

    def add(data: str) -> None:
        nonlocal linked
        data = html.unescape(data) if "&" in data else data
        parts.append(data)
        if in_link:
            linked += len(data)

    while True:
        found = _TAG.search(page, at)
        if at < (end := found.start() if found else len(page)):
            add(page[at:end])
        if found is None:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag == "a":
            in_link = not found[1]
        elif tag == "br":
            parts.append(" ")
        elif tag in RAW and not found[1]:
            end = _RAW_END[tag].search(page, at)
            inner, at = (page[at : end.start()], end.end()) if end else (page[at:], len(page))
            if tag == "title":
                if made := block():
                    yield made
                open_.push(tag, "")
                add(inner)
                if made := block():
                    yield made
                open_.pop_through({tag})
        elif tag in BLOCKS:
            if made := block():
                yield made
            in_link = False
            if found[1]:
                if open_.lost and not open_.names.get(tag):
                    open_.lost -= 1
                else:
                    open_.pop_through({tag}, _P_SCOPE if tag == "p" else frozenset())
                continue
            if tag in CLOSES_P:
                open_.pop_through({"p"}, _P_SCOPE)
            if tag in IMPLIED:
                open_.pop_through(*IMPLIED[tag])
            if tag not in VOID:
                open_.push(tag, found[3] if found[3] is not None else found[4] or "")
    if made := block():
        yield made
