"""Block trees of web pages, and their alignment by simple tree matching."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import numpy as np

# HTML element names by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "nav aside form script style noscript iframe template svg button select option textarea input label "
    "title head menu dialog object canvas audio video fieldset footer".split()
)
NEVER_CLASS = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox sponsor sponsored promo promotion banner sidebar side "
    "menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification "
    "popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments "
    "reply replies respond disqus login search widget toolbar skip pagination pager copyright disclaimer alert".split()
)
NEVER_ROLE = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()
)
MAIN_CLASS = frozenset("article post entry story".split())
HEAD_ONLY = frozenset("title meta link script style base noscript template".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}

#: Elements nested deeper than this are taken as part of the one above, unless they never hold content.
DEPTH = 150
#: Pairs of neighbours whose match is worked out at once.
CELLS = 1 << 22

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"[>\"']")
#: One attribute after another: a value is taken with its name, so nothing inside it is a name.
_ATTRIBUTE = re.compile(r"([^\s/=>][^\s/=>]*+)(?:\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Node:
    """An element that is a block, or that never holds content.  ``items`` are nodes and texts."""

    tag: str
    mark: str = ""
    never: bool = False
    main: bool = False
    items: list = field(default_factory=list)

    @property
    def name(self) -> str:
        return f"{self.tag}.{self.mark}" if self.mark else self.tag

    def children(self) -> list[Node]:
        return [i for i in self.items if isinstance(i, Node)]

    def texts(self) -> list[tuple[str, int]]:
        """(text, characters of it in links) of the blocks directly in this node."""
        return [i for i in self.items if not isinstance(i, Node)]


def _describe(tag: str, attributes: str, inside_main: bool) -> tuple[str, bool, bool]:
    """Mark, whether the element never holds content, and whether it is the main text."""
    never, main, mark = tag in NEVER or (tag == "header" and not inside_main), tag in ("article", "main"), ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                words = [w.lower() for w in _WORD.findall(value)]
                mark = mark or (words[0] if words else "")
                never |= not NEVER_CLASS.isdisjoint(words) or ("header" in words and not inside_main)
                main |= not MAIN_CLASS.isdisjoint(words) and tag in ("div", "section")
            elif name == "role":
                never |= value.lower() in NEVER_ROLE
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                never = True
    return mark, never and tag not in ("html", "body"), main


class _Builder:
    def __init__(self):
        self.root = Node("#page")
        self.stack = [self.root]
        self.pieces: list[str] = []
        self.links = 0
        self.in_link = 0
        self.open_tags: Counter[str] = Counter()
        self.mains = 0

    def text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.in_link:
                self.links += len(text)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.stack[-1].items.append((text, self.links))
            self.pieces, self.links = [], 0

    def close(self, names: str, stop: tuple[str, ...] = ()) -> None:
        """Close the innermost open element of the given names, unless one of ``stop`` is inside."""
        wanted = names.split()
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in wanted:
                self.flush()
                for node in self.stack[depth:]:
                    self.open_tags[node.tag] -= 1
                    self.mains -= node.main
                del self.stack[depth:]
                return
            if tag in stop:
                return

    def open(self, tag: str, attributes: str) -> None:
        if self.stack[-1].tag == "head" and tag not in HEAD_ONLY:
            self.close("head")
        if tag == "br" or tag == "hr":
            self.flush()
            return
        if tag == "a":
            self.in_link += 1
            return
        if tag in VOID:
            return
        mark, never, main = _describe(tag, attributes, self.mains > 0)
        if tag in BLOCKS or never:
            self.flush()
            if tag in BLOCKS and self.open_tags["p"]:
                self.close("p", ("article", "td", "th", "li", "div", "section"))
            if tag in CLOSES and any(self.open_tags[t] for t in CLOSES[tag][0].split()):
                self.close(*CLOSES[tag])
            if len(self.stack) >= DEPTH and not never:
                return
            self.open_tags[tag] += 1
            self.mains += main
            node = Node(tag, mark, never, main)
            self.stack[-1].items.append(node)
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        elif self.open_tags[tag] > 0:
            self.close(tag)
        elif tag in BLOCKS:
            self.flush()


class _Tags:
    """Tags of one page.  A quoted value may have any length.

    Quotes from which a tag was not closed are remembered, so each quote is followed once as an
    opening one, however many tags are tried.
    """

    def __init__(self, html: str):
        self.html = html
        self.unclosed: set[int] = set()

    def at(self, begin: int) -> tuple[str, str, str, int] | None:
        """Slash, name, attributes and end of the tag that begins here; None if it is not closed."""
        name = _NAME.match(self.html, begin)
        if name is None:
            return None
        at, opened = name.end(), []
        while found := _QUOTE_OR_END.search(self.html, at):
            here = found.start()
            if found[0] == ">":
                return name[1], name[2], self.html[name.end() : here], here + 1
            end = -1 if here in self.unclosed else self.html.find(found[0], here + 1)
            opened.append(here)
            if end < 0:
                break
            at = end + 1
        self.unclosed.update(opened)
        return None


def parse(html: str) -> Node:
    """The block tree of a page.  Never fails: what is not closed ends with its parent or the page.

    A comment, script or other raw element that is not closed runs to the end of the page.
    """
    build = _Builder()
    tags = _Tags(html)
    lower = None
    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            build.text(html[at:])
            break
        build.text(html[at:begin])
        at = begin
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        after = html[at + 1 : at + 2]
        if after in ("!", "?"):
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        if not (after.isalpha() or after == "/"):
            build.text("<")
            at += 1
            continue
        tag = tags.at(at)
        if tag is None:
            end = html.find(">", at)
            if end < 0:
                break
            at = end + 1
            continue
        closing, name, attributes, at = tag
        name = name.lower()
        if closing:
            build.end(name)
            continue
        build.open(name, attributes)
        if name in RAW:
            lower = lower if lower is not None else html.lower()
            end = lower.find(f"</{name}", at) if len(lower) == size else -1
            if end < 0:
                found = re.compile(f"</{name}", re.I).search(html, at)
                end = found.start() if found else size
            at = end
    build.flush()
    return build.root


@dataclass(slots=True)
class Slot:
    """A place in a wrapper: an element name, and a run of equal neighbours taken as one."""

    name: str
    children: list[Slot] = field(default_factory=list)
    number: int = -1
    shape: int = 0
    size: int = 0

    def as_list(self) -> list:
        return [self.name, [c.as_list() for c in self.children]]

    @staticmethod
    def from_list(value: list) -> Slot:
        return settled(Slot(value[0], [Slot.from_list(v) for v in value[1]]))


@dataclass(slots=True)
class Group:
    """Neighbouring elements of one name: members, and the groups of their children together."""

    name: str
    members: list[Node]
    children: list[Group] = field(default_factory=list)
    number: int = -1
    shape: int = 0
    size: int = 0


def settled(tree):
    """The group or slot with a hash of its names and the number of them, from those of its children."""
    tree.shape = hash((tree.name, *[c.shape for c in tree.children]))
    tree.size = 1 + sum(c.size for c in tree.children)
    return tree


def numbered(level: list, first: int) -> int:
    """Number groups or slots in their order, parents before children; the next free number."""
    for tree in level:
        tree.number = first
        first = numbered(tree.children, first + 1)
    return first


def grouped(nodes: list[Node], depth: int = 0) -> list[Group]:
    """Runs of elements of one name as groups, so that repeated items take one place.

    What is inside elements that never hold content has no place.
    """
    groups: list[Group] = []
    for node in nodes:
        if groups and groups[-1].name == node.name:
            groups[-1].members.append(node)
        else:
            groups.append(Group(node.name, [node]))
    for group in groups:
        open_members = [n for n in group.members if not n.never]
        if depth < 40 and open_members:
            largest = max(open_members, key=lambda n: len(n.items))
            group.children = grouped(largest.children(), depth + 1)
        settled(group)
    return groups


def tree_match(groups: list, slots: list, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two forests: size of the best order-preserving match, and its top pairs.

    Only elements of one name match, and a child matches only if its parent does.  Equal trees at
    either end are matched first: nothing else can match them better.  ``known`` are sizes by shapes.
    """
    known = {} if known is None else known

    def weight(g, s) -> int:
        if g.name != s.name:
            return 0
        if g.shape == s.shape:
            return g.size
        if not g.children or not s.children:
            return 1
        key = (g.shape, s.shape)
        if key not in known:
            known[key] = 1 + tree_match(g.children, s.children, known)[0]
        return known[key]

    head, tail, least = 0, 0, min(len(groups), len(slots))
    while tail < least and groups[-1 - tail].shape == slots[-1 - tail].shape:
        tail += 1
    while head < least - tail and groups[head].shape == slots[head].shape:
        head += 1
    pairs = [(k, k) for k in range(head)]
    ends = [(len(groups) - k, len(slots) - k) for k in range(tail, 0, -1)]
    total = sum(g.size for g in groups[:head]) + sum(groups[i].size for i, _ in ends)
    left, right = groups[head : len(groups) - tail], slots[head : len(slots) - tail]
    if left and right:
        kinds = {s.shape: s for s in right}
        of_kind = {shape: k for k, shape in enumerate(kinds)}
        columns = np.array([of_kind[s.shape] for s in right])
        rows = {g.shape: g for g in left}
        rows = {shape: np.array([weight(g, s) for s in kinds.values()])[columns] for shape, g in rows.items()}
        size, found = _best_match([rows[g.shape] for g in left], 0, len(right))
        total += size
        pairs += [(head + i, head + j) for i, j in found]
    return total, pairs + ends


def _scores(weights: list[np.ndarray]):
    """Sizes of the best matches of the first rows with the first columns, row after row."""
    best = np.zeros(len(weights[0]) + 1, np.int64)
    yield best
    for row in weights:
        following = np.zeros_like(best)
        np.maximum(best[1:], best[:-1] + row, out=following[1:])
        best = np.maximum.accumulate(following)
        yield best


def _best_match(weights: list[np.ndarray], first: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """Size and (row, column) pairs of the best match of all rows with some columns.

    Beyond ``CELLS`` the rows are halved where the best match crosses, so memory stays bounded.
    """
    if not weights or first == end:
        return 0, []
    weights = [row[first:end] for row in weights]
    if len(weights) > 1 and len(weights) * (end - first) > CELLS:
        middle = len(weights) // 2
        for upper in _scores(weights[:middle]):
            pass
        for lower in _scores([row[::-1] for row in weights[: middle - 1 : -1]]):
            pass
        cut = int(np.argmax(upper + lower[::-1]))
        above, pairs = _best_match(weights[:middle], 0, cut)
        below, others = _best_match(weights[middle:], cut, end - first)
        pairs = pairs + [(middle + i, j) for i, j in others]
        return above + below, [(i, first + j) for i, j in pairs]
    best = list(_scores(weights))
    pairs, i, j = [], len(weights), end - first
    while i and j:
        value = weights[i - 1][j - 1]
        if value and best[i][j] == best[i - 1][j - 1] + value:
            pairs.append((i - 1, first + j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return int(best[-1][-1]), pairs[::-1]
