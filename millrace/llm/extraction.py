"""The main text of web pages: boosted trees judge the nodes of a page, a hierarchy decides.

Every node of the page's tree is described by its subtree (characters, density, links, lists,
controls), its place, its siblings, its kind and the hashed tokens of its class, id and role.
Gradient-boosted trees give each node three probabilities: it *wraps* main text and other things,
it belongs to the *main* text, or it is *other*, given the class of its parent. The choice for a
page is the one of greatest total log-probability in which no node contradicts its ancestors: below
a wrapper anything can come, below main text only main text or other things in it (an advert,
comments), below other things only other things. It is found in one pass up the tree and one pass
down.

The given pages have no labels, so the trees learn from pages that ``sample_pages`` writes: a
documented, fixed number of layouts with the usual parts of pages in varied markup, whose parts are
known. Only markup and shape are learnt, never words. The model is a few hundred small trees and
goes to the executors as a Spark broadcast.

Defined cases: null, empty and blank pages, and pages without main text, give the empty text;
text outside any element, where a page has no other, counts as the body's; character references are
decoded, also careless ones; white space inside a block becomes one space; a page of any length or
depth is read whole; further columns are kept; repeated rows give equal rows.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.llm.dom import Page, features

#: Pages that the model is fitted on, a bound.
SAMPLES = 400
#: Rounds of boosting, levels of a tree, and the step of a round.
ROUNDS, LEVELS, RATE = 30, 4, 0.4
#: Thresholds tried for each number.
BINS = 32
#: Nodes scored at once, whatever a page holds.
NODES = 1 << 16
#: Pages are read in runs of about this many characters.
RUN_CHARS = 4 << 20

WRAPS, MAIN, OTHER = range(3)


# --- boosted trees -------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Complete trees of ``LEVELS`` levels: a column and threshold for each split, values for leaves."""

    columns: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: np.ndarray
    #: What each hashed token says for main text and for other things.
    names: np.ndarray

    def log_probabilities(self, numbers: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        parts = [self._scored(numbers[k : k + NODES], tokens[k : k + NODES]) for k in range(0, len(numbers), NODES)]
        return np.concatenate([np.zeros((0, 3)), *parts])

    def _scored(self, numbers: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        rows = np.concatenate([numbers, _told(tokens, self.names), tokens], axis=1, dtype=np.float32)
        every = np.arange(len(rows))
        scores = np.tile(self.base, (len(rows), 1))
        for tree in range(len(self.columns)):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (rows[every, self.columns[tree, at]] > self.thresholds[tree, at])
            scores[:, tree % 3] += self.leaves[tree, at - (2**LEVELS - 1)]
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _told(tokens: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The sums of ``names`` over the tokens of each row, which are few."""
    row, column = np.nonzero(tokens)
    sums = [np.bincount(row, names[column, k], minlength=len(tokens)) for k in range(names.shape[1])]
    return np.stack(sums, axis=1).astype(np.float32)


def fit(numbers: np.ndarray, tokens: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Softmax boosting with second-order steps on weighted rows; one tree for each class and round.

    Beside the tokens themselves stand the sums, over a node's tokens, of how much more often than
    usual they go with main text and with other things.
    """
    held, token = np.nonzero(tokens)
    many = tokens.shape[1]
    seen = np.bincount(token * 3 + label[held], weights=weight[held], minlength=many * 3).reshape(many, 3) + 1
    usual = np.bincount(label, weights=weight, minlength=3) + 1
    odds = np.log(seen / seen.sum(axis=1, keepdims=True)) - np.log(usual / usual.sum())
    names = odds[:, [MAIN, OTHER]].astype(np.float32)
    numbers = np.concatenate([numbers, _told(tokens, names)], axis=1)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in numbers.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, numbers.T, strict=True)], axis=1)
    count, wide = numbers.shape
    base = np.log(usual / usual.sum())
    scores = np.tile(base, (count, 1))
    wanted = np.eye(3)[label]
    columns, thresholds, leaves = [], [], []
    flat = binned + np.arange(wide) * BINS
    for _ in range(rounds):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k in range(3):
            slope, bend = weight * (p[:, k] - wanted[:, k]), weight * np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            at = np.zeros(count, dtype=np.int64)
            column, threshold = np.zeros(2**LEVELS - 1, dtype=np.int64), np.full(2**LEVELS - 1, np.inf)
            for level in range(LEVELS):
                lead, nodes = 2**level - 1, 2**level
                of = at - lead
                sums = []
                for step in (slope, bend):
                    cells = np.bincount(
                        (of[:, None] * (wide * BINS) + flat).ravel(), weights=np.repeat(step, wide), minlength=nodes * wide * BINS
                    )
                    left = np.cumsum(cells.reshape(nodes, wide, BINS), axis=2).reshape(nodes, -1)
                    with_token = np.bincount(of[held] * many + token, weights=step[held], minlength=nodes * many)
                    whole = np.bincount(of, weights=step, minlength=nodes)[:, None]
                    sums.append((np.concatenate([left, whole - with_token.reshape(nodes, many)], axis=1), whole))
                (g, g_all), (h, h_all) = sums
                gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                gain[(h < 1e-3) | (h_all - h < 1e-3)] = -np.inf
                best = gain.argmax(axis=1)
                for node in range(nodes):
                    if gain[node, best[node]] <= 1e-6:
                        continue
                    j = int(best[node])
                    if j < wide * BINS:
                        own, bin_ = divmod(j, BINS)
                        if bin_ >= len(edges[own]):
                            continue
                        column[lead + node], threshold[lead + node] = own, edges[own][bin_]
                    else:
                        column[lead + node], threshold[lead + node] = wide + j - wide * BINS, 0.5
                split = column[at]
                value = np.where(
                    split < wide, numbers[np.arange(count), np.minimum(split, wide - 1)], tokens[np.arange(count), np.maximum(split - wide, 0)]
                )
                at = 2 * at + 1 + (value > threshold[at])
            leaf = at - (2**LEVELS - 1)
            g, h = (np.bincount(leaf, weights=w, minlength=2**LEVELS) for w in (slope, bend))
            value = -RATE * g / (h + 1)
            scores[:, k] += value[leaf]
            columns.append(column)
            thresholds.append(threshold)
            leaves.append(value)
    return Trees(np.array(columns), np.array(thresholds, dtype=np.float32), np.array(leaves), base, names)


# --- the choice for a page -----------------------------------------------------------------


def choose(parent: Sequence[int], below_wrapper: np.ndarray, below_main: np.ndarray) -> list[int]:
    """The class of each node, without contradictions, of greatest total score.

    The scores of a node depend on the class of its parent; below other things all is other, for
    certain. Nodes are in page order, so a parent comes before its children. The page as a whole
    is a wrapper. Ties go to the later class.
    """
    wraps, main, other = (below_wrapper[:, k].tolist() for k in range(3))
    stays, leaves = (below_main[:, k].tolist() for k in (MAIN, OTHER))
    size = len(parent)
    as_wrapper, as_main = [0.0] * size, [0.0] * size
    for k in range(size - 1, 0, -1):
        up = parent[k]
        wraps[k] += as_wrapper[k]
        main[k] += as_main[k]
        stays[k] += as_main[k]
        as_wrapper[up] += max(wraps[k], main[k], other[k])
        as_main[up] += max(stays[k], leaves[k])
    chosen = [WRAPS] * size
    for k in range(1, size):
        above = chosen[parent[k]]
        if above == WRAPS:
            best = max(wraps[k], main[k], other[k])
            chosen[k] = OTHER if other[k] == best else (MAIN if main[k] == best else WRAPS)
        else:
            chosen[k] = MAIN if above == MAIN and stays[k] > leaves[k] else OTHER
    return chosen


def _below(numbers: np.ndarray, main: bool | np.ndarray) -> np.ndarray:
    """The numbers of nodes, and whether the parent is main text."""
    column = np.full((len(numbers), 1), main) if isinstance(main, bool) else main[:, None]
    return np.concatenate([column.astype(np.float32), numbers], axis=1)


def extract_pages(model: Trees, markups: Sequence[str | None]) -> list[str]:
    """The main text of each page."""
    pages = [Page(m) for m in markups]
    if not pages:
        return []
    numbers, tokens = features(pages)
    scores = [model.log_probabilities(_below(numbers, main), tokens) for main in (False, True)]
    found, at = [], 0
    for page in pages:
        own = slice(at, at + len(page.tag))
        chosen = choose(page.parent, scores[0][own], scores[1][own])
        found.append(page.text_of([c == MAIN for c in chosen]))
        at = own.stop
    return found


# --- pages to learn from -------------------------------------------------------------------

# What parts of pages are called in classes, ids and roles.
_NAMES = {
    "main": "article content post entry story main body text page single blog news copy prose detail primary hentry",
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs tabs links pagination pager toc skip",
    "header": "header masthead topbar logo brand banner top site title tagline hero",
    "footer": "footer bottom copyright legal colophon site foot credits imprint",
    "aside": "sidebar aside widget widgets rail related recommended popular trending secondary more tags archive box",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense dfp teaser",
    "notice": "cookie consent notice gdpr alert banner popup modal overlay message privacy warning dialog paywall",
    "form": "form search login signup newsletter subscribe contact register field subscription",
    "comments": "comments comment replies reply discussion disqus responses respond thread feedback reader",
    "share": "share social sharing buttons follow tools actions meta byline author date",
}
_PLAIN = "row col container wrapper inner block grid layout outer left right center clearfix wrap section group".split()


class _Writer:
    """Writes pages whose parts say by ``data-keep`` whether they are main text."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)

    def chance(self, share: float) -> bool:
        return self.draw.random() < share

    def words(self, least: int, most: int) -> str:
        draw = self.draw
        size = draw.randint(least, most)
        found = ["".join(draw.choices("abcdefghilmnoprstuéü", k=draw.randint(2, 9))) for _ in range(size)]
        style = draw.random()
        for k in range(size):
            if style < 0.75 and draw.random() < 0.12:
                found[k] += draw.choice(".,.,.;:!?")
            elif style > 0.9:
                found[k] += draw.choice(["###", "***", " |", "$$$", "&amp;&amp;", ""])
        return " ".join(found) + (draw.choice(["", ".", ".", ".", "!"]) if size > 4 else "")

    def name(self, part: str, share: float = 0.8) -> str:
        """Attributes with names of a part, plain names, or none."""
        draw = self.draw
        if not self.chance(share):
            return f' class="{draw.choice(_PLAIN)}"' if self.chance(0.3) else ""
        own = draw.sample(_NAMES[part].split(), 1 if self.chance(0.6) else 2)
        given = draw.choice(["-", "_", " "]).join(own)
        if self.chance(0.3):
            given += " " + draw.choice(_PLAIN)
        return f' {draw.choice(["class", "class", "id"])}="{given}"'

    def part(self, tag: str, keep: int, attributes: str, inside: str) -> str:
        return f'<{tag}{attributes} data-keep="{keep}">{inside}</{tag}>'

    def link(self, least: int = 1, most: int = 4) -> str:
        return f'<a href="/x">{self.words(least, most)}</a>'

    def links(self) -> str:
        some = [self.link() for _ in range(self.draw.randint(2, 14))]
        style = self.draw.randrange(4)
        if style == 0:
            return f"<ul>{''.join(f'<li>{x}</li>' for x in some)}</ul>"
        if style == 1:
            return f"<ul>{''.join(f'<li>{x}' for x in some)}</ul>"
        return (" | " if style == 2 else " ").join(some)

    def nav(self) -> str:
        tag = self.draw.choice(["nav", "nav", "nav", "div", "ul", "table"])
        inside = self.links()
        if tag == "ul":
            inside = "".join(f"<li>{self.link()}</li>" for _ in range(self.draw.randint(3, 9)))
        if tag == "table":
            inside = f"<tr>{''.join(f'<td>{self.link()}</td>' for _ in range(self.draw.randint(3, 9)))}</tr>"
        return self.part(tag, 0, self.name("nav", 0.4 if tag == "nav" else 0.95), inside)

    def header(self) -> str:
        inside = self.draw.choice(["<div>{}</div>", "<h1>{}</h1>", "<p>{}</p>", "<span>{}</span>", "{}"]).format(self.words(1, 6))
        if self.chance(0.5):
            inside += f"<p>{self.words(3, 14)}</p>"
        if self.chance(0.4):
            inside += self.links()
        tag = self.draw.choice(["header", "header", "div"])
        return self.part(tag, 0, self.name("header", 0.4 if tag == "header" else 1), inside)

    def footer(self) -> str:
        inside = self.draw.choice(["&copy; ", "", "&copy; 2024 "]) + self.words(2, 24)
        if self.chance(0.5):
            inside = f"<p>{inside}</p>"
        if self.chance(0.4):
            inside += self.links()
        tag = self.draw.choice(["footer", "footer", "footer", "div"])
        return self.part(tag, 0, self.name("footer", 0.4 if tag == "footer" else 1), inside)

    def aside(self) -> str:
        inside = ""
        for _ in range(self.draw.randint(1, 3)):
            body = self.draw.choice([self.links(), f"<p>{self.words(5, 60)}</p>", self.words(4, 40)])
            inside += f"<div><h3>{self.words(1, 4)}</h3>{body}</div>" if self.chance(0.6) else body
        tag = self.draw.choice(["aside", "aside", "div", "section"])
        return self.part(tag, 0, self.name("aside", 0.5 if tag == "aside" else 1), inside)

    def ad(self) -> str:
        inside = self.draw.choice([self.words(3, 40), self.link(3, 12), f"<p>{self.words(3, 40)}</p>"])
        return self.part(self.draw.choice(["div", "div", "aside", "section", "p"]), 0, self.name("ad", 1), inside)

    def notice(self) -> str:
        inside = self.words(6, 50)
        inside = f"<p>{inside}</p>" if self.chance(0.6) else inside
        if self.chance(0.7):
            inside += f"<button>{self.words(1, 2)}</button>"
        tag = self.draw.choice(["div", "div", "section", "dialog", "aside"])
        role = self.draw.choice(["", "", ' role="dialog"', ' role="alert"'])
        return self.part(tag, 0, self.name("notice", 1) + role, inside)

    def form(self) -> str:
        inside = ""
        for _ in range(self.draw.randint(1, 4)):
            inside += f"<label>{self.words(1, 4)}</label><input name=x>" if self.chance(0.8) else f"<p>{self.words(3, 20)}</p><input>"
        if self.chance(0.3):
            inside += f"<select>{''.join(f'<option>{self.words(1, 2)}' for _ in range(4))}</select>"
        inside += f"<button>{self.words(1, 2)}</button>" if self.chance(0.8) else '<input type="submit">'
        whole = self.part("form", 0, self.name("form", 0.5), inside)
        return self.part("div", 0, self.name("form", 1), f"<h3>{self.words(1, 4)}</h3>{whole}") if self.chance(0.3) else whole

    def comments(self) -> str:
        made = []
        for _ in range(self.draw.randint(1, 8)):
            text = "".join(f"<p>{self.words(3, 70)}</p>" for _ in range(self.draw.randint(1, 2)))
            if self.chance(0.3):
                text = self.words(3, 60)
            by = self.draw.choice([f"<b>{self.words(1, 2)}</b>", f'<div class="author">{self.words(1, 3)}</div>', ""])
            made.append(by + text)
        style, title = self.draw.randrange(3), f"<h3>{self.words(1, 3)}</h3>" if self.chance(0.7) else ""
        if style == 0:
            inside = title + "".join(f"<div{self.name('comments', 0.7)}>{x}</div>" for x in made)
        elif style == 1:
            inside = f"{title}<ol{self.name('comments', 0.5)}>{''.join(f'<li>{x}</li>' for x in made)}</ol>"
        else:
            inside = title + "".join(f"<article{self.name('comments', 0.9)}>{x}</article>" for x in made)
        if self.chance(0.3):
            inside += self.form()
        return self.part(self.draw.choice(["section", "div", "div", "aside"]), 0, self.name("comments", 1), inside)

    def share(self) -> str:
        return self.part(self.draw.choice(["div", "ul", "p"]), 0, self.name("share", 1), self.links())

    def block(self) -> str:
        """A block of main text."""
        kind = self.draw.random()
        long = self.draw.choice([12, 40, 90, 250])
        text = self.words(1, long)
        if self.chance(0.15):
            text += f" {self.link()} {self.words(1, 20)}"
        if self.chance(0.1):
            text = f"<{(tag := self.draw.choice(['b', 'em', 'span']))}>{text}</{tag}>"
        if kind < 0.6:
            return f"<p>{text}</p>"
        if kind < 0.68:
            return f"<p>{text}"
        if kind < 0.74:
            return f"<h2>{self.words(1, 8)}</h2><p>{text}</p>"
        if kind < 0.79:
            return f"<ul>{''.join(f'<li>{self.words(2, 30)}</li>' for _ in range(self.draw.randint(2, 6)))}</ul>"
        if kind < 0.83:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.87:
            cells = "".join(f"<tr>{''.join(f'<td>{self.words(1, 4)}</td>' for _ in range(3))}</tr>" for _ in range(3))
            return f"<table>{cells}</table>"
        if kind < 0.9:
            return f"<figure><img src=x><figcaption>{self.words(2, 15)}</figcaption></figure>"
        if kind < 0.93:
            return f"<pre>{text}</pre>"
        if kind < 0.97:
            return f"<div>{text}</div>"
        return f"{text}<br><br>{self.words(3, 40)}<br>"

    def story(self) -> str:
        """The inside of the main text, with what is set into it."""
        first = self.words(2, 14)
        style = self.draw.random()
        parts = [f"<h1>{first}</h1>"] if style < 0.7 else ([f"<header><h1>{first}</h1></header>"] if style < 0.8 else [])
        if self.chance(0.3):
            parts.append(f"<p><b>{self.words(2, 60)}<br>")
        low = 0 if parts else 1
        parts += [self.block() for _ in range(self.draw.choice([self.draw.randint(low, 3), self.draw.randint(1, 10), self.draw.randint(5, 40)]))]
        for made, share in ((self.ad, 0.2), (self.share, 0.2), (self.aside, 0.12), (self.form, 0.08), (self.notice, 0.06)):
            if self.chance(share):
                parts.insert(self.draw.randint(1, len(parts)), made())
        if self.chance(0.15):
            parts.append(self.comments())
        if self.chance(0.1):
            parts.append(self.footer())
        return "".join(parts)

    def main(self) -> str:
        tag = self.draw.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        named = self.name("main", 0.4 if tag in ("article", "main") else 0.85)
        whole = self.part("div" if tag == "td" else tag, 1, named, self.story())
        if tag == "td":
            return f"<table><tr><td>{whole}</td></tr></table>"
        if self.chance(0.25):
            before = "".join(made() for made in (self.nav, self.notice) if self.chance(0.3))
            after = "".join(made() for made in (self.comments, self.aside) if self.chance(0.4))
            outer = self.draw.choice(["main", "div", "section"])
            return f"<{outer}{self.name('main', 0.4)}>{before}{whole}{after}</{outer}>"
        return whole

    def page(self) -> str:
        draw = self.draw
        if self.chance(0.03):
            return self.part("body", 1, "", "".join(self.block() for _ in range(draw.randint(1, 5))))
        before = [made() for made, share in ((self.header, 0.45), (self.nav, 0.7), (self.notice, 0.3), (self.ad, 0.35), (self.form, 0.2)) if self.chance(share)]
        after = [made() for made, share in ((self.comments, 0.35), (self.aside, 0.45), (self.ad, 0.25), (self.form, 0.2), (self.notice, 0.15)) if self.chance(share)]
        if self.chance(0.3):
            draw.shuffle(before)
        body = [self.main()] if not self.chance(0.03) else []
        if after and self.chance(0.2):
            body.insert(0, after.pop())
        inside = "".join(body + after)
        if self.chance(0.4):
            inside = f'<div class="{draw.choice(_PLAIN)}">{inside}</div>'
        last = [self.footer()] if self.chance(0.8) else []
        whole = "".join(before) + inside + "".join(last)
        if self.chance(0.3):
            whole = f'<div class="{draw.choice(_PLAIN)}">{whole}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title><style>p{{}}</style></head><body>{whole}</body></html>"


def sample_pages(number: int, seed: int = 0) -> list[str]:
    """Pages to learn from or to test with; the same for the same seed."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(number)]


def labelled(pages: Sequence[Page]) -> np.ndarray:
    """The class of every node of pages that say it by ``data-keep``."""
    found = []
    for page in pages:
        label = [WRAPS] * len(page.tag)
        for k in range(1, len(page.tag)):
            own, above = page.keep[k], label[page.parent[k]]
            # What is set into other things is no main text again.
            label[k] = above if own is None or above == OTHER else (MAIN if own == "1" else OTHER)
        found += label
    return np.array(found)


@cache
def train(number: int = SAMPLES, seed: int = 0) -> Trees:
    """The trees. Nodes inside other things also teach what must not be taken below a wrapper."""
    pages = [Page(m) for m in sample_pages(number, seed)]
    numbers, tokens = features(pages)
    label = labelled(pages)
    sizes = [len(p.tag) for p in pages]
    shift = np.repeat(np.cumsum(sizes) - sizes, sizes)
    parent = np.concatenate([p.parent for p in pages])
    kept = parent >= 0
    above = label[np.where(kept, parent + shift, 0)]
    # The nodes where a part begins are few and decide the most.
    weight = np.where(above == OTHER, 0.1, np.where(label != above, 3.0, 1.0))
    return fit(_below(numbers, above == MAIN)[kept], tokens[kept], label[kept], weight[kept])


def share(spark: SparkSession, model: Trees) -> Broadcast:
    return spark.sparkContext.broadcast(model)


def main_text(markup: Column, model: Broadcast) -> Column:
    """The main text of each page, as ``string``."""

    @F.arrow_udf("string")
    def text(markups: pa.Array) -> pa.Array:
        found: list[str] = []
        run: list[str | None] = []
        held = 0
        for markup in markups.to_pylist():
            run.append(markup)
            held += len(markup or "")
            if held >= RUN_CHARS:
                found += extract_pages(model.value, run)
                run, held = [], 0
        return pa.array(found + extract_pages(model.value, run), pa.string())

    return text(markup)
