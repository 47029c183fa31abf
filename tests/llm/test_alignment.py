"""Two tokenizations against the tokenizers' own libraries and loops over tokens."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from millrace.llm import alignment, queries  # noqa: F401  (registers the query)
from millrace.queries.registry import QUERIES
from tests.llm.conftest import texts, words

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizers():
    with open(FILES[0], "rb") as a, open(FILES[1], "rb") as b:
        return alignment.Tokenizers(a.read(), b.read())


class Plain:
    """The contract, token by token."""

    def __init__(self) -> None:
        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=FILES[1])
        self.characters = alignment.byte_characters()

    def tokens(self, text: str | None):
        whole = (" " + (text or "")).encode()
        a = self.a.encode(whole.decode(), add_special_tokens=False)
        a = [(i, bytes(self.characters[c] for c in self.a.id_to_token(i))) for i in a.ids]
        b = [
            (i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode())
            for i in self.b.encode(text or "")
            for p in [self.b.id_to_piece(i)]
        ]
        if not text or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            return [], []
        spans = []
        for side in (a, b):
            end, own = 0, []
            for i, data in side:
                own.append((i, end, end + len(data)))
                end += len(data)
            spans.append(own)
        return spans

    def rows(self, given):
        found, linked = [], Counter()
        for doc_id, text in given:
            a, b = self.tokens(text)
            links, k = [], 0
            for i, lo, hi in a:
                while k and b[k][1] > lo:
                    k -= 1
                while k < len(b) and b[k][1] < hi:
                    if b[k][2] > lo:
                        links.append((i, b[k][0]))
                    k += 1
                k = max(k - 1, 0)
            cuts = sorted({h for _, _, h in a} & {h for _, _, h in b})
            groups, last = [], 0
            for cut in cuts:
                sides = [",".join(str(i) for i, _, h in side if last < h <= cut) for side in (a, b)] if len(a) < 3000 else ["", ""]
                groups.append("|".join(sides))
                last = cut
            linked.update(links)
            found.append((doc_id, len(a), len(b), groups, links))
        best = defaultdict(int)
        for (_, b), n in linked.items():
            best[b] = max(best[b], n)
        for doc_id, n_a, n_b, groups, links in found:
            whole = ";".join(groups)
            yield (
                doc_id, n_a, n_b, len(groups), len(links), sum(linked[x] == best[x[1]] for x in links),
                sum(linked[x] for x in links), (sha256(whole.encode()).hexdigest() if n_a < 3000 else None) if groups else "",
            )


def rows_of(df):
    return Counter(
        (r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"] if r["n_a"] < 3000 else None)
        for r in df.collect()
    )


def test_query_is_the_contract(spark, tables):
    expected = Counter(Plain().rows([(i, t) for i, t, _ in texts()]))
    assert rows_of(QUERIES["op13_tokenizer_alignment"](spark, tables)) == expected


def test_a_third_of_the_rows_is_one_long_text(spark):
    long = " ".join(words(4, 400))
    given = [(1, long)] * 5 + [(None, long)] * 2 + [(k, f"{long[: 40 * k]} x\u3000 y {k}") for k in range(2, 10)]
    given += [(20, "a\u2581b" * 300), (21, "<|endoftext|> </s> <unk>"), (22, "\x00\x7f" * 200), (23, "é" * 900)]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("slice", F.lit("x")).repartition(3)
    files = alignment.share(spark, *FILES)
    expected = Counter(Plain().rows(given))
    assert rows_of(alignment.align(df, files)) == expected
    assert rows_of(alignment.align(df, files, size=512)) == expected


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_any_cut_and_any_tree_give_the_same(tokenizers, size):
    width = len(tokenizers.bytes_b)
    samples = ["one two  three\n\n four", "Überraschung! 漢字 かな  \u3000 x", "x" * 60, " ", " ".join(words(6, 30)), "  a   b"]
    for text in samples:
        data = b" " + text.encode()
        whole = alignment.compose([alignment.START, *alignment.fragments(tokenizers, data, len(data))], width)
        parts = [alignment.START, *alignment.fragments(tokenizers, data, size)]
        left = parts[0]
        for part in parts[1:]:
            left = alignment.compose([left, part], width)
        right = parts[-1]
        for part in reversed(parts[:-1]):
            right = alignment.compose([part, right], width)
        for found in (left, right, alignment.compose(parts, width)):
            assert not len(found.suffix.a) and not len(found.prefix.a)
            assert (found.text, found.n_links, found.n_groups) == (whole.text, whole.n_links, whole.n_groups)
            assert found.pairs.tolist() == whole.pairs.tolist() and found.times.tolist() == whole.times.tolist()


def test_ranges_are_cut_where_tokens_are_certain():
    data = (" " + " ".join(words(7, 400))).encode()
    cut = alignment.ranges(data, 100)
    assert len(cut) == -(-len(data) // 100)
    assert [hi for _, hi, _, _ in cut[:-1]] == [lo for lo, *_ in cut[1:]]
    assert all(begin <= lo and end >= hi and data[begin] == 32 for lo, hi, begin, end in cut)
    assert alignment.ranges(b" " + b"x" * 1000, 100) == [(0, 1001, 0, 1001)]
