"""Source divergence against plain counting, and the sort of pointers against a sort of words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import divergence
from millrace.llm import texts as T
from tests.llm.conftest import words


def plain(rows, least, top):
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [w.translate(lower) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(found)
        documents[lang].update(set(found))
    out = Counter()
    for lang, sources in groups.items():
        kept = sorted((w for w, n in documents[lang].items() if n >= least), key=str.encode)
        size = {s: sum(counts[lang, s][w] for w in kept) for s in sources}

        def share(count, n, v=len(kept)):
            return 1 + 10**9 * (count + 5) // (n + 5 * v)

        p = {s: {w: share(counts[lang, s][w], size[s]) for w in kept} for s in sources}
        q = {w: share(sum(counts[lang, s][w] for s in sources), sum(size.values())) for w in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, ranked, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(ranked, key=lambda r: (-r[0], r[1].encode()))[:most]
                out.update((lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked))
    return out


def rows_for_test():
    base = [words(k, 60) for k in range(3)]
    rows = [("en", f"s{k % 7}", " ".join(base[k % 3][: 5 + k % 50])) for k in range(120)]
    rows += [("en", "s0", "Hot hot HOT ÉÄ ßé 漢字, x1y2" * 3)] * 60  # one source with many equal rows
    rows += [(None, None, None), ("", "a", "one two"), ("de", None, ""), ("de", "b", "... 12"), ("fr", "only", "mot " * 9)]
    rows += [("en", "z" * 40, "a" * 5000 + " " + "a" * 5001 + " \x00b")]
    return rows


@pytest.mark.parametrize("block,bucket", [(512, 8192), (2, 4)])
def test_against_plain_counting(spark, monkeypatch, block, bucket):
    # Blocks are numbered on the driver and in tasks, so both must know the size.
    rows = rows_for_test()
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string").repartition(5)
    monkeypatch.setattr(divergence, "BUCKET", bucket)
    found = divergence.divergence(df, least=3, top=4, block=block)
    assert Counter(tuple(r) for r in found.collect()) == plain(rows, 3, 4)


def test_pointers_are_sorted_by_words():
    draw = np.random.default_rng(4)
    text = " ".join("".join("ab"[k] for k in draw.integers(0, 2, draw.integers(1, 30))) for _ in range(3000))
    text += " é éa éab " + "a" * 100 + " " + "a" * 99 + " " + "a" * 100
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends, _ = T.spans(data, np.array([0, len(data)]), T.WHITESPACE)
    order, begins = divergence.sort_pointers(data, starts, ends)
    found = [text.encode()[starts[k] : ends[k]] for k in order]
    assert found == sorted(text.encode().split())
    assert [found[k] for k in begins] == sorted(set(found)) and all(
        order[k] < order[k + 1] for k in range(len(order) - 1) if found[k] == found[k + 1]
    )
