"""Two tokenizations of one text, aligned: which tokens share bytes, and where both have a cut.

The tokens of a range of bytes make a *fragment*: tokens of a group that began before the range
(open prefix), groups closed inside it, and tokens of a group that ends after it (open suffix). A
group ends at a byte where tokens of both tokenizers end. Two neighbouring fragments compose to
the fragment of both ranges; the operation is associative and has an identity, so the fragments
of a very long document are made by any tasks and composed in a tree.

Texts are cut into ranges of ``RANGE`` bytes, wherever that falls, even inside a token. A task
encodes a little more than its range, from the last certain cut before it to the first after it,
and keeps the tokens that end in the range. A space after a character that is no white space is a
certain cut: no piece of either tokenizer reaches over it, so what stands on one side does not
change the tokens on the other. Where there is none within a range's length the ranges are one.

Inside a slice of ranges everything is done at once on arrays, and equal words between certain cuts
are encoded once. Overlapping token pairs are found
without a loop: every distinct token end of either side closes exactly one overlap.

The number of links of each pair of ids over the whole corpus goes back to the documents through
slices: each slice asks once for each of its pairs, and its answers meet its documents again in
one task. So no table of pairs is broadcast and a frequent pair is one row for each slice.

Defined cases: null and empty texts, and texts whose tokens do not spell them, have no tokens and
count nowhere; repeated rows are documents of their own; a very long text without any certain cut
is one range; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from millrace.llm.bpe import PATTERN
from millrace.llm.texts import hash_spans, list_array
from millrace.sources.scratch import stage_table

#: Bytes of a range.
RANGE = 32 << 10
#: Ranges are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 20
#: Words that B encodes at once.
WORDS = 256
#: Neighbouring fragments composed by one task in a round.
FAN = 8

# Fixed value: the mark that stands for a space in pieces.
_SPACE = "▁"


# --- the two tokenizers --------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """A byte-level BPE given as JSON (A) and a BPE of pieces given as a model file (B).

    A's entries are merged in the order of their ids, which is that of its merges, so ``tiktoken``
    gives the ids that the vocabulary's own library gives; tests compare the two.
    """

    def __init__(self, vocabulary: bytes, model: bytes) -> None:
        characters = byte_characters()
        entries = json.loads(vocabulary)["model"]["vocab"]
        ranks = {bytes(characters[c] for c in entry): k for entry, k in entries.items()}
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = SentencePieceProcessor(model_proto=model)
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for entry, k in ranks.items():
            self.bytes_a[k] = entry
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(k) else p.replace(_SPACE, " ").encode()
            for k, p in enumerate(pieces)
        ]
        self.sizes_a = np.array([len(x) for x in self.bytes_a])
        self.sizes_b = np.array([len(x) for x in self.bytes_b])
        #: False if some piece reaches from a word over a space, so that spaces are no certain cuts.
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """All ids of A and of B for texts that begin with a space, their numbers, and which texts they spell.

        Texts that the ids do not spell have no ids. Words between certain cuts are encoded once.
        """
        begins = offsets[:-1]
        if self.cuts:
            certain = np.flatnonzero((data[1:] == 32) & _BEFORE_CUT[data[:-1]]) + 1
            begins = np.union1d(begins, certain)
        ends = np.append(begins[1:], offsets[-1])
        hashes, one, which = np.unique(hash_spans(data, begins, ends), return_index=True, return_inverse=True)
        if ((ends - begins) != (ends - begins)[one][which]).any():
            raise ArithmeticError("two words of different length have one hash")
        flat, counts, spelt = self._encode_words(data, begins[one], ends[one])
        of = np.searchsorted(offsets, begins, side="right") - 1
        valid = np.bincount(of[~spelt[which]], minlength=len(offsets) - 1) == 0
        which = which[valid[of]]
        of = of[valid[of]]
        ids, numbers = [], []
        for side in range(2):
            place = (np.cumsum(counts[side]) - counts[side])[which]
            own = counts[side][which]
            at = np.cumsum(own) - own
            ids.append(flat[side][np.repeat(place - at, own) + np.arange(own.sum())])
            numbers.append(np.bincount(of, weights=own, minlength=len(offsets) - 1).astype(np.int64))
        return ids, numbers, valid

    def _pieces_of(self, raw: bytes, place: np.ndarray) -> np.ndarray:
        """Ids of B of words behind one another, some hundred words at a time."""
        bounds = [*place[::WORDS].tolist(), len(raw)]
        texts = [raw[i + 1 : j].decode() for i, j in zip(bounds, bounds[1:], strict=False)]
        found = self._b.encode(texts, num_threads=1)
        return np.array(list(chain.from_iterable(found)), dtype=np.int64)

    def _encode_words(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        """All ids of A and of B of some words, their numbers, and which words they spell.

        The words are encoded behind one another, as one text; where that does not spell it, one by one.
        """
        sizes = ends - begins
        place = np.cumsum(sizes) - sizes
        raw = data[np.repeat(begins - place, sizes) + np.arange(sizes.sum())].tobytes()
        bounds = np.append(place, len(raw))
        if self.cuts:
            text = raw.decode()
            flat, counts = [], []
            for ids, entries, lengths in (
                (self._a.encode_to_numpy(text, disallowed_special=()), self.bytes_a, self.sizes_a),
                (self._pieces_of(raw, place), self.bytes_b, self.sizes_b),
            ):
                ids = ids.astype(np.int64)
                found = np.searchsorted(np.cumsum(lengths[ids]), bounds, side="right")
                if b"".join(map(entries.__getitem__, ids.tolist())) != raw:
                    break
                flat.append(ids)
                counts.append(np.diff(found))
            else:
                return flat, counts, np.ones(len(sizes), dtype=bool)
        words = [raw[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        texts = [w.decode() for w in words]
        a = [self._a.encode_ordinary(t) for t in texts]
        b = self._b.encode([t[1:] for t in texts], num_threads=1)
        spelt = [
            b"".join(map(self.bytes_b.__getitem__, y)) == w == b"".join(map(self.bytes_a.__getitem__, x))
            for w, x, y in zip(words, a, b, strict=True)
        ]
        counts = [np.array([len(x) for x in lists], dtype=np.int64) for lists in (a, b)]
        flat = [np.array([i for x in lists for i in x], dtype=np.int64) for lists in (a, b)]
        return flat, counts, np.array(spelt, dtype=bool)


# Bytes after which a space is a certain cut: visible ASCII, and all other bytes but those that end
# the code of some white space.
_BEFORE_CUT = np.zeros(256, dtype=bool)
_BEFORE_CUT[0x21:0x7F] = True
_BEFORE_CUT[0x80:] = True
_BEFORE_CUT[[c.encode()[-1] for c in map(chr, range(0x80, 0x3001)) if c.isspace()]] = False


@dataclass(frozen=True)
class Files:
    """Both vocabulary files, read by the driver, for the executors."""

    vocabulary: bytes
    model: bytes

    def load(self) -> Tokenizers:
        key = sha256(self.vocabulary + self.model).digest()
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Tokenizers(self.vocabulary, self.model)
        return _LOADED[key]


_LOADED: dict[bytes, Tokenizers] = {}


def share(spark: SparkSession, vocabulary: str, model: str) -> Broadcast:
    """Both files as a broadcast; they are of a few megabytes whatever the corpus."""
    with open(vocabulary, "rb") as a, open(model, "rb") as b:
        return spark.sparkContext.broadcast(Files(a.read(), b.read()))


# --- ranges --------------------------------------------------------------------------------


def _certain(data: bytes, at: int) -> bool:
    """True where a space follows a character that is no white space."""
    begin = at - 1
    while begin > 0 and data[begin] & 0xC0 == 0x80:
        begin -= 1
    return not data[begin:at].decode().isspace()


def _cut_before(data: bytes, at: int, least: int) -> int | None:
    found = data.rfind(b" ", max(least, 1), at + 1)
    while found > 0 and not _certain(data, found):
        found = data.rfind(b" ", max(least, 1), found)
    return found if found > 0 else (0 if least <= 0 else None)


def _cut_after(data: bytes, at: int, most: int) -> int | None:
    found = data.find(b" ", at, most)
    while found >= 0 and not _certain(data, found):
        found = data.find(b" ", found + 1, most)
    return found if found >= 0 else (len(data) if most >= len(data) else None)


def ranges(data: bytes, size: int = RANGE) -> list[tuple[int, int, int, int]]:
    """Ranges of a text as (first byte, end, first byte to encode, end of it)."""
    bounds = [(0, 0, 0)]
    for at in range(size, len(data), size):
        before, after = _cut_before(data, at, at - size + 1), _cut_after(data, at, at + size)
        if before is not None and after is not None:
            bounds.append((at, before, after))
    bounds.append((len(data), 0, len(data)))
    return [(lo, hi, begin, end) for (lo, begin, _), (hi, _, end) in zip(bounds, bounds[1:], strict=False)]


# --- the monoid ----------------------------------------------------------------------------


def _none() -> np.ndarray:
    return np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class Open:
    """Tokens of a group that is not whole: ids and end bytes of A and of B."""

    a: np.ndarray = field(default_factory=_none)
    a_end: np.ndarray = field(default_factory=_none)
    b: np.ndarray = field(default_factory=_none)
    b_end: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Open) -> Open:
        return Open(*(np.concatenate(pair) for pair in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end


@dataclass(frozen=True)
class Fragment:
    """What a range of bytes says about the groups of its text.

    ``closes``: some group ends in the range. Then ``prefix`` are the tokens up to the first such
    end, and ``suffix`` those after the last; else all tokens are in ``prefix``. The rest sums up
    the groups between: their tokens, number and links, their text, and the links of each pair.
    """

    prefix: Open = field(default_factory=Open)
    closes: bool = False
    suffix: Open = field(default_factory=Open)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    text: str = ""
    pairs: np.ndarray = field(default_factory=_none)
    times: np.ndarray = field(default_factory=_none)
    valid: bool = True


#: The beginning of a text, where a group can begin.
START = Fragment(closes=True)


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of A and B of all overlapping tokens, for sorted ends of two tilings of one stretch."""
    ends = np.union1d(a_end, b_end)
    return np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)


def _group(tokens: Open, width: int) -> Fragment:
    """The fragment that is one closed group."""
    a, b = overlaps(tokens.a_end, tokens.b_end)
    pairs, times = np.unique(tokens.a[a] * width + tokens.b[b], return_counts=True)
    text = "|".join(",".join(map(str, ids.tolist())) for ids in (tokens.a, tokens.b))
    return Fragment(Open(), True, Open(), len(tokens.a), len(tokens.b), 1, len(a), text, pairs, times)


def compose(parts: Sequence[Fragment], width: int) -> Fragment:
    """The fragment of neighbouring ranges, in order. ``width`` is the number of B's ids."""
    prefix, suffix, closes, closed = Open(), Open(), False, []
    for part in parts:
        if not part.closes:
            if closes:
                suffix = suffix + part.prefix
            else:
                prefix = prefix + part.prefix
            continue
        middle = (suffix if closes else prefix) + part.prefix
        if not closes:
            prefix = middle
        elif len(middle.a):
            closed.append(_group(middle, width))
        closed.append(part)
        closes, suffix = True, part.suffix
    pairs, which = np.unique(np.concatenate([_none(), *(c.pairs for c in closed)]), return_inverse=True)
    times = np.concatenate([_none(), *(c.times for c in closed)])
    return Fragment(
        prefix,
        closes,
        suffix,
        *(sum(getattr(c, name) for c in closed) for name in ("n_a", "n_b", "n_groups", "n_links")),
        ";".join(c.text for c in closed if c.n_groups),
        pairs,
        np.bincount(which, weights=times, minlength=len(pairs)).astype(np.int64),
        all(p.valid for p in parts),
    )


# --- a slice of ranges at once -------------------------------------------------------------


class _Slice:
    """Fragments of many ranges: ``spans`` are (first byte, end, first encoded byte) of each."""

    def __init__(self, tokenizers: Tokenizers, texts: Sequence[bytes], spans: Sequence[tuple[int, int, int]]) -> None:
        self.width = len(tokenizers.bytes_b)
        all_codes = len(tokenizers.bytes_a) * self.width
        lo, hi, begin = np.array(spans, dtype=np.int64).reshape(-1, 3).T
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found, numbers, self.valid = tokenizers.encode(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
        # The ranges lie behind one another: place in the text and this shift.
        last = np.cumsum(hi - lo)
        self.shifts = last - hi
        kept, ends = [], []
        for ids, own, sizes in zip(found, numbers, (tokenizers.sizes_a, tokenizers.sizes_b), strict=True):
            row = np.repeat(np.arange(len(texts)), own)
            end = np.cumsum(sizes[ids])
            first = np.cumsum(own) - own
            before = np.append(0, end)[first]
            end = end + (begin - before)[row]
            inside = (end > lo[row]) & (end <= hi[row])
            kept.append(ids[inside])
            ends.append((end + self.shifts[row])[inside])
        (self.a, self.b), (a_end, b_end) = kept, ends
        leads = lo == 0
        size = int(last[-1]) + 1 if len(last) else 1

        def rank(marks: np.ndarray) -> np.ndarray:
            """For each place the number of marks up to it."""
            at = np.zeros(size, dtype=np.int32)
            at[marks] = 1
            return np.cumsum(at, dtype=np.int32)

        on_a, on_b = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        on_a[a_end], on_b[b_end] = True, True
        common, union = np.flatnonzero(on_a & on_b), np.flatnonzero(on_a | on_b)
        rows_before, common_before = rank(last), rank(common)
        row = rows_before[common - 1]
        fresh = np.ones(len(common), dtype=bool)
        fresh[1:] = row[1:] != row[:-1]
        # The group that ends at a common end is whole, unless it may begin in an earlier range.
        whole = ~fresh | leads[row]
        self.closes = np.zeros(len(texts), dtype=bool)
        self.closes[row] = True

        def placed(end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row and group of each end, and 0 before the first common end, 1 in a whole group, 2 after."""
            own, group = rows_before[end - 1], common_before[end - 1]
            inside = np.append(row, -1)[group] == own
            return own, group, np.where(inside, np.append(whole, False)[group], np.where(self.closes[own], 2, 0))

        (self.a_row, a_group, self.a_kind), (self.b_row, b_group, self.b_kind) = placed(a_end), placed(b_end)
        self.a_end, self.b_end = a_end, b_end
        rows = len(texts)
        self.n_a = np.bincount(self.a_row[self.a_kind == 1], minlength=rows)
        self.n_b = np.bincount(self.b_row[self.b_kind == 1], minlength=rows)
        self.n_groups = np.bincount(row[whole], minlength=rows)
        of, _, kind = placed(union)
        union, of = union[kind == 1], of[kind == 1].astype(np.int64)
        code = self.a[rank(a_end)[union - 1]] * self.width + self.b[rank(b_end)[union - 1]]
        self.n_links = np.bincount(of, minlength=rows)
        key, self.times = np.unique(of * all_codes + code, return_counts=True)
        self.pair_row, self.pairs = key // all_codes, key % all_codes
        self.bounds = np.searchsorted(self.pair_row, np.arange(rows + 1))
        self._write(a_group, b_group)

    def _write(self, a_group: np.ndarray, b_group: np.ndarray) -> None:
        """The text of each row's whole groups: ids of A, ids of B, group by group."""
        on_a, on_b = self.a_kind == 1, self.b_kind == 1
        a, a_group, b, b_group = self.a[on_a], a_group[on_a], self.b[on_b], b_group[on_b]
        a_last, b_last = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
        a_last[:-1], b_last[:-1] = a_group[1:] != a_group[:-1], b_group[1:] != b_group[:-1]
        shown = _shown()
        most = len(shown) // 3
        words = np.empty(len(a) + len(b), dtype=object)
        words[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = shown[a + most * a_last]
        words[np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")] = shown[b + 2 * most * b_last]
        bounds = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        self.text = ["".join(words[i:j].tolist())[:-1] for i, j in zip(bounds, bounds[1:], strict=False)]

    def fragment(self, row: int) -> Fragment:
        (a0, a1), (b0, b1) = (np.searchsorted(x, [row, row + 1]) for x in (self.a_row, self.b_row))

        def tokens(kind: int) -> Open:
            own_a, own_b = np.flatnonzero(self.a_kind[a0:a1] == kind) + a0, np.flatnonzero(self.b_kind[b0:b1] == kind) + b0
            shift = self.shifts[row]
            return Open(self.a[own_a], self.a_end[own_a] - shift, self.b[own_b], self.b_end[own_b] - shift)

        own = slice(self.bounds[row], self.bounds[row + 1])
        counts = (int(x[row]) for x in (self.n_a, self.n_b, self.n_groups, self.n_links))
        return Fragment(
            tokens(0), bool(self.closes[row]), tokens(2), *counts, self.text[row], self.pairs[own], self.times[own], bool(self.valid[row])
        )


_SHOWN: list[np.ndarray] = []


def _shown(most: int = 1 << 17) -> np.ndarray:
    """Ids as text followed by a comma, a bar or a semicolon."""
    if not _SHOWN:
        _SHOWN.append(np.array([f"{k}{mark}" for mark in ",|;" for k in range(most)], dtype=object))
    return _SHOWN[0]


def fragments(tokenizers: Tokenizers, data: bytes, size: int = RANGE) -> list[Fragment]:
    """The fragments of a text, range by range."""
    cut = ranges(data, size if tokenizers.cuts else max(1, len(data)))
    done = _Slice(tokenizers, [data[begin:end] for _, _, begin, end in cut], [(lo, hi, begin) for lo, hi, begin, _ in cut])
    return [done.fragment(k) for k in range(len(cut))]


# --- Spark ---------------------------------------------------------------------------------

_COUNTS = "n_a long, n_b long, n_groups long, n_links long"
_OPEN = ("a", "a_end", "b", "b_end")
_KEY = "doc_id long, bytes long, hash long"
_PIECE = f"{_KEY}, i int, ranges int, lo long, hi long, begin long, chunk binary"
_FRAGMENT = (
    f"{_KEY}, n long, i int, ranges int, {_COUNTS}, text string, pairs array<long>, times array<long>, "
    f"valid boolean, closes boolean, "
    + ", ".join(f"{side}_{name} array<long>" for side in ("prefix", "suffix") for name in _OPEN)
)
_ROW = f"slice long, doc_id long, n long, {_COUNTS}, groups_sha256 string, pairs array<long>, at array<int>, times array<long>"


def _gathered(texts: Iterator[tuple[int, int]]) -> Iterator[list[int]]:
    """Rows, given with their bytes, in runs of about ``SLICE_BYTES``."""
    run, held = [], 0
    for row, size in texts:
        if run and held + size > SLICE_BYTES:
            yield run
            run, held = [], 0
        run.append(row)
        held += size
    if run:
        yield run


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest() if text else ""


def _whole(files: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of one range, and after each slice of them one row with the pairs of the slice."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number = files.value.load(), 0
        partition = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for run in _gathered(enumerate(sizes)):
                data = [b" " + (texts[k].as_py() or "").encode() for k in run]
                done = _Slice(tokenizers, data, [(0, len(d), 0) for d in data])
                # A text without characters has no tokens.
                some = np.array([len(d) > 1 for d in data])
                kept = some[done.pair_row]
                pairs, at = np.unique(done.pairs[kept], return_inverse=True)
                times, bounds = done.times[kept], np.searchsorted(done.pair_row[kept], np.arange(len(run) + 1))
                sums = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
                one, size = partition + number, len(run)
                number += 1
                counts = [
                    pa.array(np.append(np.where(some, x, 0), 0), pa.int64())
                    for x in (done.n_a, done.n_b, done.n_groups, done.n_links)
                ]
                digests = [_digest(t) if s else "" for t, s in zip(done.text, some, strict=True)]
                empty = np.zeros(size + 1, dtype=np.int32)
                ends = pa.array(np.append(bounds, bounds[-1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size + 1, one), pa.int64()),
                        pa.concat_arrays([ids.take(pa.array(run)), pa.nulls(1, pa.int64())]),
                        pa.array(np.append(np.ones(size, dtype=np.int64), 0)),
                        *counts,
                        pa.array([*digests, None], pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.append(empty, len(pairs)).astype(np.int32)), pa.array(pairs)),
                        pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(bounds, bounds[-1] + len(sums)).astype(np.int32)),
                            pa.array(np.concatenate([times, sums])),
                        ),
                    ],
                    names=["slice", "doc_id", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "at", "times"],
                )

    return align


def _split(files: Broadcast, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every range of every text, with the bytes to encode for it."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = files.value.load().cuts
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                data = b" " + text.encode()
                cut = ranges(data, size if cuts else len(data))
                same = [[batch.column(c)[k].as_py()] * len(cut) for c in ("doc_id", "hash")]
                lo, hi, begin, end = zip(*cut, strict=True)
                chunks = [data[i:j] for i, j in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(same[0], pa.int64()),
                        pa.array([len(data)] * len(cut), pa.int64()),
                        pa.array(same[1], pa.int64()),
                        pa.array(range(len(cut)), pa.int32()),
                        pa.array([len(cut)] * len(cut), pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (lo, hi, begin)),
                        pa.array(chunks, pa.binary()),
                    ],
                    names=["doc_id", "bytes", "hash", "i", "ranges", "lo", "hi", "begin", "chunk"],
                )

    return split


_NAMES = ["doc_id", "bytes", "hash", "n", "i", "ranges"]


def _as_rows(keys: list[tuple], found: list[Fragment]) -> pa.RecordBatch:
    arrays = [pa.array([k[j] for k in keys], kind) for j, kind in enumerate([pa.int64()] * 4 + [pa.int32()] * 2)]
    names = list(_NAMES)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        arrays.append(pa.array([getattr(f, name) for f in found], pa.int64()))
        names.append(name)
    arrays.append(pa.array([f.text for f in found], pa.string()))
    arrays += [list_array([getattr(f, name) for f in found], pa.int64()) for name in ("pairs", "times")]
    arrays += [pa.array([getattr(f, name) for f in found], pa.bool_()) for name in ("valid", "closes")]
    names += ["text", "pairs", "times", "valid", "closes"]
    for side in ("prefix", "suffix"):
        for j, name in enumerate(_OPEN):
            arrays.append(list_array([getattr(f, side).parts()[j] for f in found], pa.int64()))
            names.append(f"{side}_{name}")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _fragments(files: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = files.value.load()
        for batch in batches:
            rows = batch.to_pylist()
            for run in _gathered((k, len(r["chunk"])) for k, r in enumerate(rows)):
                own = [rows[k] for k in run]
                done = _Slice(tokenizers, [r["chunk"] for r in own], [(r["lo"], r["hi"], r["begin"]) for r in own])
                yield _as_rows([tuple(r[c] for c in _NAMES) for r in own], [done.fragment(k) for k in range(len(own))])

    return align


def _from_row(row: dict) -> Fragment:
    sides = [
        Open(*(np.array(row[f"{side}_{name}"], dtype=np.int64) for name in _OPEN)) for side in ("prefix", "suffix")
    ]
    lists = (np.array(row[name], dtype=np.int64) for name in ("pairs", "times"))
    return Fragment(
        sides[0], row["closes"], sides[1], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["text"], *lists, row["valid"]
    )


def _composed(files: Broadcast, fan: int) -> Callable[[pa.Table], pa.Table]:
    def compose_group(table: pa.Table) -> pa.Table:
        width = len(files.value.load().bytes_b)
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        whole = compose([_from_row(r) for r in rows], width)
        lead = rows[0]
        key = (*(lead[c] for c in _NAMES[:4]), lead["i"] // fan, -(-lead["ranges"] // fan))
        return pa.Table.from_batches([_as_rows([key], [whole])])

    return compose_group


def reduce_tree(found: DataFrame, files: Broadcast, fan: int = FAN) -> DataFrame:
    """One fragment for each document: ``fan`` neighbours at a time, every round in a table."""
    most = found.agg(F.max("ranges").alias("most")).first()["most"] or 1
    while most > 1:
        near = found.withColumn("__run", F.floor(F.col("i") / fan)).groupBy("doc_id", "bytes", "hash", "__run")
        found = stage_table(near.applyInArrow(_composed(files, fan), _FRAGMENT), "alignment-fragments")
        most = -(-most // fan)
    return found


def _finished(files: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fragments of whole documents as result rows: what begins at the start of a text is closed."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(files.value.load().bytes_b)
        for batch in batches:
            for row in batch.to_pylist():
                whole = compose([START, _from_row(row)], width)
                if not whole.valid:
                    whole = Fragment()
                own = {"doc_id": row["doc_id"], "n": row["n"], "groups_sha256": _digest(whole.text)}
                own |= {name: getattr(whole, name) for name in ("n_a", "n_b", "n_groups", "n_links")}
                own |= {"pairs": whole.pairs.tolist(), "times": whole.times.tolist()}
                yield pa.RecordBatch.from_pylist([own], schema=_FINISHED_ARROW)

    return finish


_FINISHED = f"doc_id long, n long, {_COUNTS}, groups_sha256 string, pairs array<long>, times array<long>"
_FINISHED_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
_RESULT = f"doc_id long, n long, {_COUNTS}, n_best long, count_sum long, groups_sha256 string"


def _answered(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each document of a slice; ``answers`` has each pair of the slice once."""
    order = np.argsort(answers.column("pair").to_numpy())
    count, best = (answers.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
    at, times = (docs.column(c).combine_chunks() for c in ("at", "times"))
    sizes = pc.list_value_length(at).to_numpy()
    places, times = (x.flatten().to_numpy() for x in (at, times))
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def summed(values: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(times * values[places])])[ends]), pa.int64())

    names = ["doc_id", "n", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table(
        [*(docs.column(c) for c in names), summed(best), summed(count), docs.column("groups_sha256")],
        names=[*names, "n_best", "count_sum", "groups_sha256"],
    )


def align(docs: DataFrame, files: Broadcast, size: int = RANGE) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= size
    short = given.filter(~long).mapInArrow(_whole(files), _ROW)
    pieces = given.filter(long).withColumn("hash", F.xxhash64("text")).mapInArrow(_split(files, size), _PIECE)
    # Equal rows are worked on once and counted.
    once = pieces.groupBy("doc_id", "bytes", "hash", "i", "ranges", "lo", "hi", "begin").agg(
        F.count(F.lit(1)).alias("n"), F.first("chunk").alias("chunk")
    )
    made = stage_table(once.mapInArrow(_fragments(files), _FRAGMENT), "alignment-fragments")
    whole = reduce_tree(made, files).mapInArrow(_finished(files), _FINISHED)
    # Every very long document is a slice of its own.
    own = F.transform(F.col("pairs"), lambda _, k: k.cast("int"))
    finished = whole.withColumns({"slice": -1 - F.monotonically_increasing_id(), "at": own})
    rows = stage_table(short.unionByName(finished), "alignment")

    # Rows of slices have n = 0; a very long document is its slice's row too.
    asked = rows.filter("n = 0 OR slice < 0").select("slice", F.greatest("n", F.lit(1)).alias("n"), F.arrays_zip("pairs", "times").alias("x"))
    asked = asked.select("slice", "n", F.explode("x").alias("x")).select(
        "slice", F.col("x.pairs").alias("pair"), (F.col("n") * F.col("x.times")).alias("times")
    )
    width = len(files.value.load().bytes_b)
    count = asked.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.pmod("pair", F.lit(width)))
    count = stage_table(count, "alignment-pairs")
    most = count.groupBy("b").agg(F.max("count").alias("most"))
    known = count.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("slice", "pair").join(known, "pair").select(F.col("slice").alias("of"), "pair", "count", "best")
    held = rows.filter("n > 0").drop("pairs")
    done = held.groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(_answered, _RESULT)
    return done.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
