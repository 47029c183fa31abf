"""Main text of pages: held-out layouts, the given pages read another way, awkward markup."""

from __future__ import annotations

import re
import time
from collections import Counter
from html import unescape
from itertools import product

import numpy as np
import pytest

from millrace.llm import extraction, queries  # noqa: F401  (registers the query)
from millrace.llm.dom import Page
from millrace.queries.registry import QUERIES

SAMPLE = "/root/testdata/sf0.01"


def article(markup: str) -> str:
    """The text of the one article of a given page, by cutting markup away."""
    inside = markup[markup.index("<article>") + 9 : markup.index("</article>")]
    inside = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", inside))
    return " ".join(unescape(inside).split())


def test_given_pages(spark):
    rows = QUERIES["op11_html_extraction"](spark, SAMPLE).collect()
    given = {r["page_id"]: r for r in spark.read.parquet(f"{SAMPLE}/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        assert r["text"] == article(given[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == given[r["page_id"]]["url"]


def test_layouts_that_were_not_learnt():
    model, markups = extraction.train(), extraction.sample_pages(150, seed=77)
    shares = []
    for markup, found in zip(markups, extraction.extract_pages(model, markups), strict=True):
        page = Page(markup)
        wanted = page.text_of((extraction.labelled([page]) == extraction.MAIN).tolist()).split()
        both = sum((Counter(wanted) & Counter(found.split())).values())
        shares.append(2 * both / (len(wanted) + len(found.split())) if wanted or found else 1.0)
    assert np.mean(np.array(shares) > 0.95) > 0.85 and np.mean(shares) > 0.9


def test_parts_that_are_no_main_text():
    text = " ".join(["Some words of the story, told at length."] * 8)
    main = f"<article><h1>Title here</h1><p>{text}</p><p>Short end.</p>{{}}</article>"
    page = (
        "<body><header><p>Site name</p></header><nav><a href=/>Home</a> <a href=/a>About</a></nav>"
        '<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>{}'
        '<aside class="sidebar"><h3>Popular</h3><ul><li><a href=/>One</a></ul></aside>'
        '<form><label>Mail</label><input><button>Send</button></form>'
        '<section class="comments"><h3>Comments</h3><div class="comment"><p>I like it a lot.</p></div></section>'
        "<footer>&copy; Somebody</footer></body>"
    )
    inner = '<div class="advert">Buy this now</div><script>var x = "</p>";</script><style>p{}</style><!-- <p>no</p> -->'
    found = extraction.extract_pages(extraction.train(), [page.format(main.format(x)) for x in ("", inner)])
    assert found == [f"Title here {text} Short end."] * 2


@pytest.mark.parametrize("markup", [None, "", "  \n", "<!-- only", "<script>x</script>", "<", "</p>", "<a href='"])
def test_pages_without_text(markup):
    assert extraction.extract_pages(extraction.train(), [markup]) == [""]


def test_reader_of_markup():
    def text(markup):
        page = Page(markup)
        return page.text_of([True] * len(page.tag))

    assert text("a &amp b &lt;p&gt; &#x41;&#66; &nope; &#xD800;") == "a & b <p> AB &nope; \ufffd"
    assert text("<p>one<p>two<b>th</b>ree<br>four<ul><li>x<li>y</ul>z") == "one twothree four x y z"
    assert text("<div title='a>b' x=>in</div><DIV>Up</DIV>") == "in Up"
    assert text("<title>t</title><p hidden>h<textarea><b>raw</b></textarea>") == "h <b>raw</b>"
    assert text("<table><tr><td>a<td>b<tr><td>c</table><p>d</div></b></p>e") == "a b c d e"
    assert text("1 < 2 <3> x<br/>y <?php no ?>z") == "1 < 2 <3> x y z"
    page = Page("<div><p>a<p>b</div><section>c</section>")
    assert page.parent == [-1, 0, 1, 1, 0] and page.end == [5, 4, 3, 4, 5]


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<p>x", "<li>", "</div>", "<!--", '<a "', "<td><table>", "&amp;", "< ", "<p></b>"])
def test_time_grows_with_the_page(unit):
    began = time.time()
    for size in (20_000, 40_000):
        extraction.extract_pages(extraction.train(), [unit * size])
    assert time.time() - began < 30


def test_choice_is_the_best_without_contradiction():
    draw = np.random.default_rng(3)
    for _ in range(40):
        size = int(draw.integers(2, 7))
        parent = [-1] + [int(draw.integers(0, k)) for k in range(1, size)]
        wraps, main = draw.normal(size=(size, 3)), draw.normal(size=(size, 3))

        def total(labels):
            found = 0.0
            for k in range(1, size):
                above = labels[parent[k]]
                if above == extraction.OTHER:
                    if labels[k] != extraction.OTHER:
                        return -np.inf
                elif above == extraction.MAIN:
                    found += -np.inf if labels[k] == extraction.WRAPS else main[k, labels[k]]
                else:
                    found += wraps[k, labels[k]]
            return found

        best = max(total((0, *rest)) for rest in product(range(3), repeat=size - 1))
        assert abs(total(extraction.choose(parent, wraps, main)) - best) < 1e-9


def test_awkward_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "x"), (2, "", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    from pyspark.sql import functions as F

    model = extraction.share(spark, extraction.train())
    found = df.select("page_id", extraction.main_text(F.col("html"), model).alias("main")).collect()
    assert Counter(r["page_id"] for r in found) == Counter([1, 1, None, 2])
    assert all(isinstance(r["main"], str) for r in found)
