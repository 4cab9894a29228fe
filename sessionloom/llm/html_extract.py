"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of containers and text slots. Neighbours that repeat
are folded into repeated groups. The streams of one host are then aligned with
the wrapper so far: where they agree, the wrapper stands; a part that one side
lacks becomes optional; a part that one side repeats becomes repeated. Text
that most pages of the host share is the template's; the rest is what
slots hold, and the wrapper knows of each slot how much of its text varies and
how much is links.

To read a page it is aligned with its host's wrapper. Each of its texts then
weighs as much as the wrapper says that its slot's text varies and isn't links;
tags and class names make a container likelier or less likely. The article is
the innermost container that holds nearly all weight, with its heading. Inside
it, template text goes, and so do parts that several signs agree on (element,
name, links, size, place, repetition): no name is enough by itself.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, give_back, saved
from .url_filter import host_of

__all__ = ["Node", "Plan", "align", "extract", "fold", "infer_plans", "read_page", "text_of_page"]

#: Keys of text slots: of plain text and of headings.
TEXT, HEADING = "#", "#h"
#: Elements of HTML by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form fieldset dialog menu details address center figure table ul ol dl".split())
UNREAD = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select button".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main".split())
NOT_ARTICLE = frozenset("nav footer aside form dialog menu".split())
#: Words in a class, id or role that speak for menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
MARKS = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar copyright legal cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus discussion related recommended recommendations widget toolbar search form skip contentinfo complementary".split())
#: Of these, the words that say the same as a part of a longer name.
PLAIN_MARKS = frozenset("comment comments reply replies respond disqus ad ads advert advertisement adsense promo sponsored share sharing social newsletter cookie cookies consent gdpr breadcrumb breadcrumbs pagination".split())
ARTICLE_MARKS = frozenset("main articlebody".split())

#: Share of a host's pages that makes a text the template's, and the fewest different pages that can show it.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.5, 3
#: The fewest pages that show that a slot of a named article holds the template's text only.
FIXED_PAGES = 8
#: Share of the weight that the article's container holds.
HOLDS = 0.8
#: Points at which a part of the article goes.
ENOUGH = 2.0
#: A wrapper keeps what at least one in so many of its host's pages has; pages with rarer parts judge these by themselves.
SUPPORT = 1024
#: Wrappers aligned one after the other in one step of the tree of merges.
FAN = 32

_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
_END_OF = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in UNREAD}
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")


class Node:
    """A container or text slot of a page or a wrapper."""

    __slots__ = ("key", "flags", "kids", "n", "parts", "chars", "links", "at", "weight", "literal")

    def __init__(self, key: str, flags: str = "", kids: list[Node] | None = None, n: int = 1):
        self.key, self.flags, self.kids, self.n = key, flags, [] if kids is None else kids, n
        #: Of a page's nodes: unread pieces of text, their characters and those in links, and the place in the wrapper.
        self.parts: list[str] | None = None
        self.chars = self.links = 0
        self.at = -1
        self.weight, self.literal = 0.0, False

    @property
    def is_text(self) -> bool:
        return self.key[:1] == "#"

    def shape(self) -> frozenset[str]:
        return frozenset(k.key for k in self.kids)


@lru_cache(maxsize=4096)
def _key(tag: str, attrs: str) -> str:
    """A container's key: its tag with role, id and classes, runs of digits as one sign."""
    found = [(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)] if attrs else []
    names = sorted({_DIGITS.sub("0", n.lower()) for value in found for n in value.split()})
    return ".".join([tag, *names])


@lru_cache(maxsize=65536)
def _marks(key: str) -> tuple[str, float]:
    """A key's tag, and how strongly its names speak against an article: 1.5 for a plain word, .5 for a part of a name."""
    tag, *names = key.split(".")
    if tag in ("html", "body") or tag[:1] == "#":
        return tag, 0.0
    mark = 0.0
    for name in names:
        words = set(_WORDS.findall(name))
        if name in MARKS or words & PLAIN_MARKS or (len(words) == 1 and words & MARKS):
            mark = 1.5
        elif words & MARKS:
            mark = max(mark, 0.5)
    return tag, mark


@lru_cache(maxsize=65536)
def _is_plain(key: str) -> bool:
    """Whether a name says outright that a part is reader comments, an advert or a notice."""
    return any(PLAIN_MARKS & set(_WORDS.findall(name)) for name in key.split(".")[1:])


@lru_cache(maxsize=65536)
def _is_article(key: str) -> bool:
    tag, *names = key.split(".")
    return (tag in ARTICLE or any(n in ARTICLE_MARKS for n in names)) and _marks(key)[1] < 1.5


def _prior(key: str, inside: bool) -> float:
    """How likely a container is to hold an article, by its element and names."""
    tag, mark = _marks(key)
    if tag in NOT_ARTICLE or (tag == "header" and not inside):
        return 0.01
    if mark >= 1.5:
        return 0.02
    return 10.0 if _is_article(key) else 0.7 if mark else 1.0


def _allow(depth: int) -> None:
    """Room for functions that call themselves once for each level of containers."""
    if 4 * depth + 2000 > sys.getrecursionlimit():
        sys.setrecursionlimit(4 * depth + 2000)


# -- pages --------------------------------------------------------------------------


def _tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page: ``text`` with the text, ``open`` and ``close`` with tag and attributes.

    Linear in the page: without a ``>`` ahead all is text, and after eight tags
    whose quotes aren't closed, tags end at their first ``>``.
    """
    at, last, strict = 0, source.rfind(">"), 8
    while at < len(source):
        lt = source.find("<", at)
        while lt >= 0 and not (source[lt + 1 : lt + 2].isalpha() or source[lt + 1 : lt + 2] in ("/", "!", "?")):
            lt = source.find("<", lt + 1)
        if lt < 0:
            break
        if source.startswith("<!--", lt):
            if lt > at:
                yield "text", source[at:lt], ""
            end = source.find("-->", lt + 4)
            at = len(source) if end < 0 else end + 3
            continue
        if lt > last:
            break
        if lt > at:
            yield "text", source[at:lt], ""
        m = _TAG.match(source, lt) if strict else None
        if m is None:
            m = _LOOSE_TAG.match(source, lt)
            strict -= m is not None and strict > 0
        if m is None:
            at = source.find(">", lt) + 1
            continue
        at, tag = m.end(), m["tag"].lower()
        yield "close" if m["close"] else "open", tag, m["attrs"]
        if tag in UNREAD and not m["close"] and not m["attrs"].endswith("/"):
            end = _END_OF[tag].search(source, at)
            at = len(source) if end is None else end.end()
    if at < len(source):
        yield "text", source[at:], ""


class _Reader:
    """Builds a page's tree."""

    def __init__(self, source: str):
        self.root = Node("")
        self.stack = [self.root]
        self.names = [""]
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.chars = self.deepest = 0
        self.link = False
        self.block = TEXT
        self._read(source)

    def _end_block(self) -> None:
        if self.chars:
            node = Node(self.block)
            node.parts, node.links, node.chars = self.parts, self.linked, self.chars
            self.stack[-1].kids.append(node)
        if self.parts:
            self.parts, self.linked, self.chars = [], 0, 0

    def _text(self, piece: str) -> None:
        self.parts.append(piece)
        n = len(piece.strip())
        self.chars += n
        if self.link:
            self.linked += n

    def _read(self, source: str) -> None:
        in_head = False
        for kind, name, attrs in _tokens(source):
            if kind == "text":
                if not in_head:
                    self._text(name)
                continue
            close = kind == "close"
            if name == "head":
                in_head = not close
            elif name == "body" and not close:
                in_head = False
            if in_head or name in UNREAD:
                continue
            if name in INLINE:
                if name == "a":
                    self.link = not close
            elif name == "br" or name == "wbr":
                self.parts.append("\n" if name == "br" else "")
            elif name in VOID:
                if name == "hr":
                    self._end_block()
            else:
                self._end_block()
                self.link = False
                self.block = HEADING if name in HEADINGS and not close else TEXT
                if close:
                    self._pop(name)
                    continue
                # what a new block of text closes by its start: only marked blocks of text are on the stack
                last = self.names[-1]
                if last not in CONTAINERS and (name == last or last in PARAGRAPHS):
                    self._pop(last)
                key = _key(name, attrs)
                if name in CONTAINERS or _marks(key)[1]:
                    node = Node(key)
                    self.stack[-1].kids.append(node)
                    self.stack.append(node)
                    self.names.append(name)
                    self.open[name] = self.open.get(name, 0) + 1
                    self.deepest = max(self.deepest, len(self.stack))
        self._end_block()

    def _pop(self, tag: str) -> None:
        if self.open.get(tag):
            while True:
                self.stack.pop()
                name = self.names.pop()
                self.open[name] -= 1
                if name == tag:
                    return


def read_page(source: str) -> list[Node]:
    """The nodes of a page; texts are unread pieces."""
    page = _Reader(source)
    _allow(page.deepest)
    return page.root.kids


def _join(parts: list[str]) -> str:
    """A block's text: references decoded, white space folded."""
    text = "".join(parts)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _write(nodes: list[Node]) -> str:
    """Nodes as text: a line for each, with its level, flags, count and key."""
    lines, left = [], [(0, n) for n in reversed(nodes)]
    while left:
        depth, node = left.pop()
        lines.append(f"{depth}\t{node.flags}\t{node.n}\t{node.key}")
        left.extend((depth + 1, k) for k in reversed(node.kids))
    return "\n".join(lines)


def _parse(text: str) -> list[Node]:
    """Nodes from what ``_write`` gives."""
    root = Node("")
    path, deepest = [root], 0
    for line in text.split("\n") if text else []:
        depth, flags, n, key = line.split("\t")
        node = Node(key, flags, n=int(n))
        del path[int(depth) + 1 :]
        path[-1].kids.append(node)
        path.append(node)
        deepest = max(deepest, len(path))
    _allow(deepest)
    return root.kids


# -- wrappers -----------------------------------------------------------------------


def _alike(a: Node, b: Node) -> bool:
    """Whether two neighbours of one key are of one kind: half of their children's keys agree."""
    if a.is_text:
        return True
    x, y = a.shape(), b.shape()
    return 2 * len(x & y) >= len(x | y)


def _flags(*flags: str) -> str:
    return "".join(f for f in "?+" if any(f in x for x in flags))


def fold(nodes: list[Node]) -> list[Node]:
    """Neighbours of one kind, and neighbouring groups of any length whose kinds recur, as repeated groups.

    The stack of nodes seen so far has hashes of its prefixes, so two groups are
    compared in one step; the group that may recur is known from the last place
    of its last key.
    """
    out: list[Node] = []
    prefix, power, before = [0], [1], []
    last: dict[str, int] = {}
    mod, base = (1 << 61) - 1, 1_000_003

    def hashed(a: int, b: int) -> int:
        return (prefix[b] - prefix[a] * power[b - a]) % mod

    for node in nodes:
        if out and node.is_text and out[-1].key == node.key:
            out[-1] = Node(node.key, _flags("+", "?" if "?" in node.flags and "?" in out[-1].flags else ""), n=max(node.n, out[-1].n))
            continue
        folded = Node(node.key, node.flags, [] if node.is_text else fold(node.kids), node.n)
        folded.chars, folded.links = node.chars, node.links
        out.append(folded)
        prefix.append((prefix[-1] * base + hash_of(node.key)) % mod)
        if len(power) < len(prefix):
            power.append(power[-1] * base % mod)
        before.append(last.get(node.key, -1))
        last[node.key] = len(out) - 1
        while True:
            n = len(out)
            g = n - 1 - before[-1]
            if before[-1] < 0 or 2 * g > n or hashed(n - g, n) != hashed(n - 2 * g, n - g) or not all(_alike(x, y) for x, y in zip(out[n - 2 * g : n - g], out[n - g :], strict=True)):
                break
            for k in range(n - 1, n - g - 1, -1):
                last[out[k].key] = before[k]
            for k in range(n - 2 * g, n - g):
                x, y = out[k], out[k + g]
                out[k] = Node(x.key, _flags("+", "?" if "?" in x.flags and "?" in y.flags else ""), align(x.kids, y.kids, same_page=True), max(x.n, y.n))
            del out[n - g :], prefix[n - g + 1 :], before[n - g :]
    return out


@lru_cache(maxsize=65536)
def hash_of(key: str) -> int:
    return xxhash.xxh64_intdigest(key) >> 4


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places, ascending on both sides, of equal values: those that are unique on both sides first, then first fits between."""
    once = lambda xs: {x: k for k, x in reversed(list(enumerate(xs)))}
    in_a, in_b = once(a), once(b)
    count_a, count_b = {}, {}
    for counts, xs in ((count_a, a), (count_b, b)):
        for x in xs:
            counts[x] = counts.get(x, 0) + 1
    unique = [(in_a[x], in_b[x]) for x in in_a if count_a[x] == 1 and count_b.get(x) == 1]
    unique.sort()
    # the longest ascending run of the unique ones
    tails: list[int] = []
    back: list[int] = []
    ends: list[int] = []
    for k, (_, j) in enumerate(unique):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    anchors, k = [], ends[-1] if ends else -1
    while k >= 0:
        anchors.append(unique[k])
        k = back[k]
    anchors.reverse()
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    found, i, j = [], 0, 0
    for to_i, to_j in [*anchors, (len(a), len(b))]:
        while i < to_i and j < to_j:
            at = places.get(a[i], ())
            k = bisect_left(at, j)
            if k < len(at) and at[k] < to_j:
                found.append((i, at[k]))
                j = at[k] + 1
            i += 1
        if to_i < len(a):
            found.append((to_i, to_j))
        i, j = to_i + 1, to_j + 1
    return found


def align(wrapper: list[Node], page: list[Node], same_page: bool = False) -> list[Node]:
    """The wrapper that covers both: nodes of equal key and children are matched first, then nodes of equal key between; what one side lacks is optional.

    Near-linear in the number of nodes. With ``same_page`` both sides are
    repetitions on one page, whose counts of pages don't add up.
    """
    if not wrapper or not page:
        return fold([_optional(n) for n in (*wrapper, *page)])
    kinds_a, kinds_b = ([(n.key, n.shape()) for n in side] for side in (wrapper, page))
    sure = [(k, k) for k in range(len(kinds_a))] if kinds_a == kinds_b else _matches(kinds_a, kinds_b)
    pairs: dict[int, int] = {}
    i = j = 0
    for to_i, to_j in [*sure, (len(wrapper), len(page))]:
        if i < to_i and j < to_j:
            for x, y in _matches([n.key for n in wrapper[i:to_i]], [n.key for n in page[j:to_j]]):
                pairs[i + x] = j + y
        if to_i < len(wrapper):
            pairs[to_i] = to_j
        i, j = to_i + 1, to_j + 1
    out: list[Node] = []
    j = 0
    for i, a in enumerate(wrapper):
        if i in pairs:
            out.extend(_optional(b) for b in page[j : pairs[i]])
            b = page[pairs[i]]
            out.append(Node(a.key, _flags(a.flags, b.flags), [] if a.is_text else align(a.kids, b.kids, same_page), max(a.n, b.n) if same_page else a.n + b.n))
            j = pairs[i] + 1
        else:
            out.append(_optional(a))
    out.extend(_optional(b) for b in page[j:])
    return fold(out)


def _optional(node: Node) -> Node:
    return Node(node.key, _flags("?", node.flags), node.kids, node.n)


def _supported(nodes: list[Node], least: float) -> list[Node]:
    """The nodes that enough pages have."""
    return [Node(n.key, n.flags, _supported(n.kids, least), n.n) for n in nodes if n.n >= least]


class Plan:
    """A host's wrapper with what is known of its nodes: characters in all, in links, and of the template; and the template's texts."""

    def __init__(self, nodes: list[Node], sums: np.ndarray | None = None, template: frozenset[int] = frozenset()):
        self.root = Node("", kids=nodes)
        self.nodes: list[Node] = []
        left = list(reversed(nodes))
        while left:
            node = left.pop()
            node.at = len(self.nodes)
            self.nodes.append(node)
            left.extend(reversed(node.kids))
        self.sums = np.zeros((len(self.nodes), 3)) if sums is None else sums
        self.template = template
        self.known: dict[int, dict[str, list[tuple[frozenset, list[int]]]]] = {}

    def _index(self, parent: Node) -> dict[str, list[tuple[frozenset, list[int]]]]:
        """Of a node's children: for each key the shapes there are, and the places of each."""
        found = self.known.get(parent.at)
        if found is None:
            shapes: dict[str, dict[frozenset, list[int]]] = {}
            for k, kid in enumerate(parent.kids):
                shapes.setdefault(kid.key, {}).setdefault(kid.shape(), []).append(k)
            found = self.known[parent.at] = {key: list(x.items()) for key, x in shapes.items()}
        return found

    def place(self, page: list[Node], parent: Node | None = None) -> None:
        """Align a page's nodes with the wrapper: each gets the number of the wrapper's node that it repeats, or -1."""
        parent = self.root if parent is None else parent
        index, now = self._index(parent), 0
        for node in page:
            choices = index.get(node.key)
            if choices is None:
                self._unplaced(node)
                continue
            if len(choices) > 1:
                shape = node.shape()
                _, places = max(choices, key=lambda c: (len(c[0] & shape) / max(1, len(c[0] | shape)), c[1][-1] >= now))
            else:
                places = choices[0][1]
            k = bisect_left(places, now)
            now = places[k] if k < len(places) else places[0]
            node.at = parent.kids[now].at
            if not node.is_text:
                self.place(node.kids, parent.kids[now])

    def _unplaced(self, node: Node) -> None:
        node.at = -1
        for kid in node.kids:
            self._unplaced(kid)

    def worth(self, node: Node) -> float:
        """What a character of a text weighs: less if its slot holds links or the template's text, as the wrapper has seen it."""
        chars, links, template = self.sums[node.at] if node.at >= 0 and self.sums[node.at, 0] else (node.chars, node.links, 0)
        return max(0.02, 1 - links / max(1, chars)) * (0.05 if node.literal else max(0.1, 1 - template / max(1, chars)))

    def is_fixed(self, node: Node) -> bool:
        """Whether a slot has held hardly anything but the template's text, on a number of pages."""
        return node.at >= 0 and self.nodes[node.at].n >= FIXED_PAGES and self.sums[node.at, 2] >= 0.95 * self.sums[node.at, 0]

    def repeats(self, node: Node) -> bool:
        """Whether most of what stands in a container is the template's text."""
        return node.at >= 0 and self.sums[node.at, 0] > 0 and 2 * self.sums[node.at, 2] >= self.sums[node.at, 0]

    def share(self, node: Node, whole: Node) -> tuple[float, float]:
        """A container's share of the characters of ``whole``, and the share of links among its own."""
        of = lambda n: self.sums[n.at] if n.at >= 0 else (n.chars, n.links, 0)
        if node.at < 0 or whole.at < 0:
            return node.chars / max(1, whole.chars), node.links / max(1, node.chars)
        mine, all_ = of(node), of(whole)
        return mine[0] / max(1, all_[0]), mine[1] / max(1, mine[0])


def hash_text(parts: list[str]) -> int:
    return xxhash.xxh64_intdigest(_join(parts).encode("utf-8", "replace")) - (1 << 63)


def _weigh(nodes: list[Node], plan: Plan, prior: float, inside: bool) -> tuple[float, int, int]:
    """Weight, characters and characters in links of nodes, and of each by itself."""
    sums = [0.0, 0, 0]
    for node in nodes:
        if node.is_text:
            node.literal = bool(plan.template) and hash_text(node.parts) in plan.template
            node.weight = node.chars * plan.worth(node) * prior
        else:
            node.weight, node.chars, node.links = _weigh(node.kids, plan, prior * _prior(node.key, inside), inside or _is_article(node.key))
        sums[0] += node.weight
        sums[1] += node.chars
        sums[2] += node.links
    return sums[0], sums[1], sums[2]


def _headed(nodes: list[Node], but: Node, inside: bool) -> bool:
    """Whether there is a heading beside ``but`` that may be the article's."""
    for node in nodes:
        if node is but:
            continue
        if node.key == HEADING:
            if not node.literal and 2 * node.links < node.chars:
                return True
        elif not node.is_text and _marks(node.key)[1] == 0 and _prior(node.key, inside) >= 1 and _headed(node.kids, but, inside):
            return True
    return False


def _article(root: Node) -> Node:
    """The innermost container that holds nearly all weight, with its heading."""
    inside = False
    while not _is_article(root.key) or root.key.partition(".")[0] != "article":
        inside = inside or _is_article(root.key)
        best = max((k for k in root.kids if not k.is_text), key=lambda k: k.weight, default=None)
        if best is None or best.weight < HOLDS * root.weight or root.weight == 0 or _headed(root.kids, best, inside):
            return root
        root = best
    return root


def _goes(node: Node, trailing: bool, plan: Plan, article: Node) -> bool:
    """Whether a part with a mark, in an article, is none of it; ``trailing`` says that no plain part follows.

    Names that an article may have for its own parts take no text away, nor with
    size and place: the page or its host's other pages have to show something of
    the kind (links, records in a row, the same text on most pages).
    """
    tag, mark = _marks(node.key)
    size, links = plan.share(node, article)
    records = any("+" in k.flags and not k.is_text for k in (plan.nodes[node.at].kids if node.at >= 0 else fold(node.kids)))
    shown = links >= 0.5 or records or plan.repeats(node)
    if not shown and tag not in NOT_ARTICLE and not _is_plain(node.key):
        return False
    points = 2.0 * (tag in NOT_ARTICLE) + mark + (links >= 0.5) + 0.5 * (size < 0.2) - 0.5 * (size > 0.5)
    if mark:
        points += 0.5 * trailing + 0.5 * records
    return points >= ENOUGH


def _is_marked(node: Node) -> bool:
    return not node.is_text and (_marks(node.key)[1] > 0 or _marks(node.key)[0] in NOT_ARTICLE)


def _texts(article: Node, plan: Plan) -> Iterator[Node]:
    """The article's texts, in order."""
    left = [article]
    while left:
        node = left.pop()
        if node.is_text:
            yield node
            continue
        trailing = True
        for kid in reversed(node.kids):
            if not _is_marked(kid) or not _goes(kid, trailing, plan, article):
                left.append(kid)
            trailing = trailing and (_is_marked(kid) or not kid.chars)


def _read(nodes: list[Node], plan: Plan) -> str:
    plan.place(nodes)
    root = Node("", kids=nodes)
    root.weight, root.chars, root.links = _weigh(nodes, plan, 1.0, False)
    article = _article(root)
    found = list(_texts(article, plan))
    # a named article may quote a passage that many pages share; there a slot has to be the template's on all pages
    template = [n for n in found if n.literal and (not _is_article(article.key) or plan.is_fixed(n))]
    # where most of a page is like its host's other pages, these are copies, not a template
    if 2 * sum(n.chars for n in template) <= sum(n.chars for n in found):
        gone = set(map(id, template))
        found = [n for n in found if id(n) not in gone]
    return "\n".join(t for n in found if (t := _join(n.parts)))


def _total(nodes: list[Node], plan: Plan, hashes: Iterator[int] | None, found: np.ndarray) -> tuple[int, int, int]:
    sums = [0, 0, 0]
    for node in nodes:
        if node.is_text:
            row = (node.chars, node.links, node.chars if hashes is not None and next(hashes) in plan.template else 0)
        else:
            row = _total(node.kids, plan, hashes, found)
        if node.at >= 0:
            found[node.at] += row
        sums = [x + y for x, y in zip(sums, row, strict=True)]
    return tuple(sums)


def _sums(plan: Plan, page: list[Node], hashes: list[int] | None = None) -> np.ndarray:
    """Characters in all, in links and of the template at each node of the wrapper, of one page that has been placed."""
    found = np.zeros((len(plan.nodes), 3))
    _total(page, plan, None if hashes is None else iter(hashes), found)
    return found


def _own_plan(nodes: list[Node]) -> Plan:
    """A page as its own wrapper."""
    plan = Plan(fold(nodes))
    plan.place(nodes)
    plan.sums = _sums(plan, nodes)
    return plan


def text_of_page(source: str, plan: Plan | None = None) -> str:
    """The article's blocks, joined by line ends, as the host's wrapper reads the page.

    A page without a wrapper, or in which its wrapper finds nothing, is its own wrapper.
    """
    nodes = read_page(source)
    text = _read(nodes, plan) if plan is not None else ""
    return text or _read(nodes, _own_plan(nodes))


# -- Spark --------------------------------------------------------------------------

_BLOCK = pa.struct([("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("first", pa.bool_())])
_SKELETON = "host string, page binary, tree string, pattern string, blocks array<struct<hash: long, chars: long, links: long, first: boolean>>"


def _page_texts(nodes: list[Node]) -> Iterator[Node]:
    left = list(reversed(nodes))
    while left:
        node = left.pop()
        if node.is_text:
            yield node
        left.extend(reversed(node.kids))


def _skeletons(pages: DataFrame) -> DataFrame:
    """(host, page, tree, pattern, blocks): each page's nodes as they are and folded, and of each text a hash, its size, and whether it is the page's first such text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                keys, trees, patterns, blocks = [], [], [], []
                for source in some.column("html"):
                    nodes = read_page(source.as_py() or "")
                    seen: set[int] = set()
                    found = []
                    for node in _page_texts(nodes):
                        h = hash_text(node.parts)
                        found.append({"hash": h, "chars": node.chars, "links": node.links, "first": h not in seen})
                        seen.add(h)
                    trees.append(_write(nodes))
                    patterns.append(_write(fold(nodes)))
                    keys.append(xxhash.xxh3_128_digest(trees[-1] + ",".join(str(b["hash"]) for b in found)))
                    blocks.append(found)
                yield pa.RecordBatch.from_arrays([some.column("host"), pa.array(keys, pa.binary()), pa.array(trees, pa.string()), pa.array(patterns, pa.string()), pa.array(blocks, pa.list_(_BLOCK))], names=["host", "page", "tree", "pattern", "blocks"])
            batch = some = None
            give_back()

    return pages.mapInArrow(run, _SKELETON)


def _aligned(parts: DataFrame) -> DataFrame:
    """(host, part, wrapper): the wrappers of each (host, part) aligned one after the other, those of most pages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        nodes: list[Node] = []
        pages = 0
        done: list[tuple] = []

        def emit() -> pa.RecordBatch:
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["host", "part", "n", "wrapper"])

        def close() -> None:
            if key is not None:
                done.append((*key, pages, _write(_supported(nodes, pages / SUPPORT))))

        for batch in batches:
            for host, part, n, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "n", "wrapper")), strict=True):
                if (host, part) == key:
                    nodes, pages = align(nodes, _parse(wrapper)), pages + n
                    continue
                close()
                key, nodes, pages = (host, part), _parse(wrapper), n
                if len(done) > 1000:
                    yield emit()
        close()
        yield emit()

    dealt = parts.repartition("host", "part").sortWithinPartitions("host", "part", F.desc("n"), "wrapper")
    return dealt.select("host", "part", "n", "wrapper").mapInArrow(run, "host string, part long, n long, wrapper string")


def _counted(patterns: DataFrame) -> DataFrame:
    """Patterns (host, wrapper, n) whose nodes carry the number of pages."""

    @F.arrow_udf(T.StringType())
    def times(wrappers: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for text, n in zip(wrappers.to_pylist(), counts.to_pylist(), strict=True):
            rows = (line.split("\t") for line in text.split("\n")) if text else ()
            out.append("\n".join(f"{depth}\t{flags}\t{n}\t{key}" for depth, flags, _, key in rows))
        return pa.array(out, pa.string())

    return patterns.select("host", times(F.col("wrapper"), F.col("n")).alias("wrapper"), "n")


def infer_plans(pages: DataFrame) -> DataFrame:
    """(host, wrapper, sums, template) of the hosts of ``pages`` (host, html): what ``Plan`` takes, one row for each host.

    Copies of a page count once. A host's equal patterns are counted before
    they are aligned, FAN at a time, in as many levels of merges as the host
    with the most patterns needs. Wrappers keep what one page in SUPPORT has, so
    their size depends on the pages' size, not on their number.
    """
    skeletons = saved(_skeletons(pages).dropDuplicates(["host", "page"]), "skeletons")
    patterns = saved(skeletons.groupBy("host", F.col("pattern").alias("wrapper")).agg(F.count("*").alias("n")), "patterns")
    hosts = patterns.groupBy("host").agg(F.count("*").alias("patterns"), F.sum("n").alias("pages"))
    part = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("patterns") / FAN))
    parts = _counted(patterns).join(saved(hosts, "hosts"), "host").select("host", part.alias("part"), "n", "wrapper")
    while True:
        parts = saved(_aligned(parts), "wrappers")
        if not (parts.agg(F.max("part")).first()[0] or 0):
            break
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))

    texts = skeletons.select("host", F.inline("blocks")).where("first").groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = skeletons.where(F.size("blocks") > 0).groupBy("host").agg(F.count("*").alias("pages"))
    common = texts.where(F.col("n") >= TEMPLATE_PAGES).join(saved(counts, "page-counts"), "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    template = common.groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("template"))
    wrappers = saved(parts.join(saved(template, "templates"), "host", "left").select("host", "wrapper", F.coalesce("template", F.array().cast("array<long>")).alias("template")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for host, (_, sums) in held.items():
                at = np.flatnonzero(sums.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(at), pa.string()), pa.array(at), *(pa.array(sums[at, k].astype(np.int64)) for k in range(3))], names=["host", "at", "chars", "links", "template"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                host, tree, blocks, wrapper, template = (batch.column(c)[k] for c in ("host", "tree", "blocks", "wrapper", "template"))
                host = host.as_py()
                if host not in held:
                    if sum(len(p.nodes) for p, _ in held.values()) > 500_000:
                        yield from emit()
                    plan = Plan(_parse(wrapper.as_py()), template=frozenset(template.as_py()))
                    held[host] = [plan, np.zeros((len(plan.nodes), 3))]
                plan, sums = held[host]
                nodes, blocks = _parse(tree.as_py()), blocks.as_py()
                for node, block in zip(_page_texts(nodes), blocks, strict=True):
                    node.chars, node.links = block["chars"], block["links"]
                plan.place(nodes)
                sums += _sums(plan, nodes, [b["hash"] for b in blocks])
            batch = None
            give_back()
        yield from emit()

    seen = skeletons.select("host", "tree", "blocks").join(wrappers, "host").select("host", "tree", "blocks", "wrapper", "template").mapInArrow(run, "host string, at long, chars long, links long, template long")
    sums = seen.groupBy("host", "at").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("template").alias("template"))
    listed = sums.groupBy("host").agg(F.collect_list(F.struct("at", "chars", "links", "template")).alias("sums"))
    return wrappers.join(saved(listed, "sums"), "host", "left")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", output: str = "text") -> DataFrame:
    """``pages`` without their html, and with the main text in ``output``.

    Null, empty and text-free pages give an empty text. Pages without a host in
    their URL share a wrapper. Whole pages are read, whatever their length,
    depth or faults: unclosed elements and comments end with the page. Repeated
    rows give repeated results and count once in the wrapper; an empty table
    stays empty. A column named ``output`` is replaced, other columns are kept.
    """
    keep = [c for c in pages.columns if c not in (html_col, output)]
    hosted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    plans = saved(infer_plans(hosted), "plans")
    # joined as the planner sees fit: broadcast below its threshold, else dealt by host, hot hosts split
    source, host, wrapper, sums, template = (free(pages, c) for c in ("_html", "_host", "_wrapper", "_sums", "_template"))
    known = plans.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper), F.col("sums").alias(sums), F.col("template").alias(template))
    rows = pages.select(*keep, F.col(html_col).alias(source), host_of(F.col(url_col)).alias(host)).join(known, host, "left").select(*keep, source, host, wrapper, sums, template)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[str, Plan] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                texts = []
                for at, page in enumerate(some.column(source)):
                    name = some.column(host)[at].as_py()
                    plan = plans.get(name)
                    if plan is None and some.column(wrapper)[at].is_valid:
                        plan = Plan(_parse(some.column(wrapper)[at].as_py()), template=frozenset(some.column(template)[at].as_py() or ()))
                        for s in some.column(sums)[at].as_py() or ():
                            plan.sums[s["at"]] = s["chars"], s["links"], s["template"]
                        if sum(len(p.nodes) for p in plans.values()) > 500_000:
                            plans.clear()
                        plans[name] = plan
                    texts.append(text_of_page(page.as_py() or "", plan))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, output])
            batch = some = page = None
            give_back()

    return rows.mapInArrow(run, schema)
