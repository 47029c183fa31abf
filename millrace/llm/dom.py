"""Web pages as trees of blocks: a forgiving reader of HTML and the features of its nodes.

The tree follows the usual rules for what browsers read into careless markup: elements without
end tags, implied ends of paragraphs, items and cells, stray end tags, raw text of scripts. Every
step costs time in proportion to the page, whatever its nesting.

Nodes are elements that can hold a block, and inline elements that carry a class, an id or a role;
other inline elements only pass their text on. Node 0 of each page stands for the whole page.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np

#: Columns for hashed tokens of classes, ids and roles.
TOKEN_COLUMNS = 128

# Kinds of elements, by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title noscript template iframe noembed noframes svg math object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var img br wbr input".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_PARAGRAPH_SCOPE = ("button", "td", "th", "table", "caption", "object", "template")
# A start tag ends an open element of these names above the nearest of the others.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
}

#: Kinds of tags as features; the last stands for all others.
TAGS = {
    name: k
    for k, names in enumerate(
        [
            ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset"), ("article",), ("main",), ("section",),
            ("div",), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl", "menu"), ("li", "dt", "dd"),
            ("table", "tbody", "thead", "tr"), ("td", "th"), ("body", "html"), ("figure", "figcaption"),
            ("blockquote", "pre"), ("button", "select", "option", "textarea"), ("dialog",),
        ]
    )
    for name in names
}
OTHER = max(TAGS.values()) + 1
_AROUND = [TAGS[name] for name in ("nav", "header", "footer", "aside", "form", "article", "main")]
_LOWER_TAGS = {"heading": (TAGS["h1"], TAGS["h2"]), "item": (TAGS["li"],), "paragraph": (TAGS["p"],), "control": (TAGS["button"],)}

_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<[!?/][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|data-keep)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = re.compile(r"[.!?;:,]")
_SPACE = re.compile(r"\s+")


def token_column(token: str) -> int:
    return zlib.crc32(token.lower().encode()) % TOKEN_COLUMNS


class Page:
    """One page: nodes in page order, and its text as pieces that belong to nodes."""

    def __init__(self, markup: str | None) -> None:
        self.tag = [OTHER]
        self.parent = [-1]
        self.end = [0]
        self.depth = [0]
        self.tokens: list[list[int]] = [[]]
        self.keep: list[str | None] = [None]
        self.chars, self.link_chars, self.stops = [0], [0], [0]
        self.links, self.controls = [0], [0]
        #: (node, text); node -1 stands for the edge of a block.
        self.pieces: list[tuple[int, str]] = []
        self._read(markup or "")
        self.end[0] = len(self.tag)

    def _read(self, markup: str) -> None:
        # Open elements as (name, node, seen, in a link), and where each name is open.
        stack = [("", 0, True, False)]
        where: dict[str, list[int]] = defaultdict(list)

        def shut(size: int) -> None:
            while len(stack) > size:
                name, node, _, _ = stack.pop()
                where[name].pop()
                if node != stack[-1][1]:
                    self.end[node] = len(self.tag)
                if name not in INLINE:
                    self.pieces.append((-1, " "))

        def last(names: tuple[str, ...]) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=0)

        def text(begin: int, end: int) -> None:
            if begin >= end:
                return
            _, node, seen, linked = stack[-1]
            if not seen:
                return
            found = markup[begin:end]
            if "&" in found:
                found = unescape(found)
            self.pieces.append((node, found))
            size = len(_SPACE.sub(" ", found).strip())
            self.chars[node] += size
            if linked:
                self.link_chars[node] += size
            self.stops[node] += len(_STOPS.findall(found))

        at = 0
        while True:
            found = _MARKUP.search(markup, at)
            if found is None:
                break
            text(at, found.start())
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                if name == "p" and not where["p"]:
                    self.pieces.append((-1, " "))
                if name == "br":
                    self.pieces.append((-1, " "))
                elif where.get(name):
                    place = where[name][-1]
                    # The end of an inline element does not end a block around it.
                    if name not in INLINE or all(stack[k][0] in INLINE for k in range(place, len(stack))):
                        shut(place)
                continue
            if name in ENDS_PARAGRAPH and where["p"] and where["p"][-1] > last(_PARAGRAPH_SCOPE):
                shut(where["p"][-1])
            if name in _IMPLIED:
                own, around = _IMPLIED[name]
                lowest = last(around)
                places = [where[n][-1] for n in own if where[n] and where[n][-1] > lowest]
                if places:
                    shut(min(places))
            _, node, seen, linked = stack[-1]
            if name in ("br", "hr"):
                self.pieces.append((-1, " "))
            if name in ("input", "button", "select", "textarea"):
                self.controls[node] += 1
            if name in VOID:
                continue
            if name == "a":
                self.links[node] += 1
            seen = seen and name not in UNSEEN
            tokens, keep = self._attributes(found[3]) if found[3] else ([], None)
            if seen and (name not in INLINE or tokens):
                self.tag.append(TAGS.get(name, OTHER))
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
                self.tokens.append(tokens)
                self.keep.append(keep)
                for counts in (self.end, self.chars, self.link_chars, self.stops, self.links, self.controls):
                    counts.append(0)
                node = len(self.tag) - 1
            if name not in INLINE:
                self.pieces.append((-1, " "))
            where[name].append(len(stack))
            stack.append((name, node, seen, linked or name == "a"))
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(markup, at)
                stop = close.start() if close else len(markup)
                text(at, stop)
                at = stop
        text(at, len(markup))
        shut(1)

    @staticmethod
    def _attributes(given: str) -> tuple[list[int], str | None]:
        tokens, keep = [], None
        for name, *values in _ATTRIBUTE.findall(given):
            value = "".join(values)
            if name.lower() == "data-keep":
                keep = value
            else:
                tokens += [token_column(t) for t in _TOKEN.findall(value)]
        return tokens, keep

    def text_of(self, kept: list[bool]) -> str:
        """The text of the kept nodes; white space is one space, blocks are joined by one."""
        parts = [" " if node < 0 else (text if kept[node] else " ") for node, text in self.pieces]
        return " ".join("".join(parts).split())


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row for every node of the pages: numbers, and 0 or 1 for each hashed token."""
    sizes = np.array([len(p.tag) for p in pages])
    begin = np.cumsum(sizes) - sizes
    shift = np.repeat(begin, sizes)

    def gathered(name: str) -> np.ndarray:
        return np.concatenate([np.array(getattr(p, name), dtype=np.int64) for p in pages])

    tag, parent, end, depth = (gathered(n) for n in ("tag", "parent", "end", "depth"))
    root = parent < 0
    own = np.arange(len(tag))
    parent = np.where(root, own, parent + shift)
    end = end + shift

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[own]

    direct = gathered("chars")
    chars, linked, stops = below(direct), below(gathered("link_chars")), below(gathered("stops"))
    links, controls, nodes = below(gathered("links")), below(gathered("controls")), end - own
    kinds = {name: below(np.isin(tag, of).astype(np.int64)) for name, of in _LOWER_TAGS.items()}
    in_paragraphs = below(np.where(tag == TAGS["p"], direct, 0))
    whole = np.maximum(chars[shift], 1)
    before = np.concatenate([[0], np.cumsum(direct)])[own] - np.concatenate([[0], np.cumsum(direct)])[shift]
    link_share = linked / np.maximum(chars, 1)

    order = np.lexsort((own, parent))
    order = order[~root[order]]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = parent[order[1:]] == parent[order[:-1]]
    first = np.maximum.accumulate(np.where(~same[:-1], np.arange(len(order)), 0)) if len(order) else order
    siblings = np.bincount(parent[~root], minlength=len(tag))
    place = np.zeros(len(tag))
    place[order] = np.arange(len(order)) - first
    beside = np.zeros((len(tag), 4))
    for k, (at, to) in enumerate(((same[:-1], -1), (same[1:], 1))):
        here = order[at]
        there = order[np.flatnonzero(at) + to]
        beside[here, 2 * k], beside[here, 2 * k + 1] = np.log1p(chars[there]), link_share[there]

    around = np.zeros((len(tag), len(_AROUND)))
    for k, kind in enumerate(_AROUND):
        # Open stretches of nodes below an element of the kind.
        step = np.zeros(len(tag) + 1, dtype=np.int64)
        of = np.flatnonzero(tag == kind)
        np.add.at(step, of + 1, 1)
        np.add.at(step, end[of], -1)
        around[:, k] = np.cumsum(step)[:-1] > 0
    columns = [
        np.log1p(chars), link_share, np.log1p(nodes), np.log1p(chars / nodes), depth, np.log1p(siblings[parent]),
        place / np.maximum(siblings[parent] - 1, 1), chars / whole, 100 * stops / np.maximum(chars, 20), np.log1p(direct),
        np.log1p(chars[parent]), chars / np.maximum(chars[parent], 1), np.log1p(in_paragraphs / np.maximum(kinds["paragraph"], 1)),
        before / whole, (before + chars) / whole, np.log1p(links), np.log1p(controls), np.log1p(siblings),
        *(np.log1p(values) for values in kinds.values()), *beside.T, *around.T, link_share[parent], tag[parent],
        *((tag == k) for k in range(OTHER + 1)),
    ]
    numbers = np.stack(columns, axis=1).astype(np.float32)
    tokens = np.zeros((len(tag), TOKEN_COLUMNS), dtype=np.uint8)
    held = [(i + b, t) for p, b in zip(pages, begin.tolist(), strict=True) for i, own_tokens in enumerate(p.tokens) for t in own_tokens]
    if held:
        rows, of = np.array(held).T
        tokens[rows, of] = 1
    return numbers, tokens
