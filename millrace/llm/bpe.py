"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut into pieces by the tokenizer's pattern and every piece is encoded on its own. Equal
pieces of a slice of texts are encoded once. Pieces that are tokens need no merge. The others are
grouped by length; a group is a matrix with a row of byte ids for each piece, padded at the end.
In each round every row merges its leftmost pair of least rank: the ranks of all neighbouring
pairs are kept next to the ids, only the two pairs beside a merge are looked up anew, and the row
closes up by one column. Rows without a mergeable pair leave the matrix. Pairs are looked up in an
open-addressing hash table of numpy arrays.

The matrices hold pieces of up to ``LONG`` bytes; longer pieces, one in a great many, are merged
in the same order with a heap, because a round for each merge would take time by the square of
the length. Texts are worked on in slices of bounded bytes. For the usual pattern the pieces are
found by code point classes, all at once; any other pattern goes through ``regex``.

The vocabulary goes to the executors as a Spark broadcast. Its size is that of the rank file.

Defined cases: a null text encodes like the empty text, to no ids; null ids decode to null; an id
outside the vocabulary raises ``ValueError``; equal texts get equal ids; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import unicodedata
from base64 import b64decode

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from millrace.llm.texts import hash_spans, slices

# Fixed value: the usual pattern that cuts texts into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The code points of white space.
SPACES = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

#: Longest piece, in bytes, that the matrices take.
LONG = 256
#: Cells of a matrix.
CELLS = 1 << 21
#: Ids that are decoded at a time.
IDS = 1 << 21

_NONE = np.int32(2**31 - 1)
_FREE = np.uint64(2**64 - 1)
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    found = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    found[list(SPACES)] = _SPACE
    return found


class Vocabulary:
    """Tokens by rank, and the rank that each mergeable pair of ids merges to."""

    def __init__(self, tokens: dict[bytes, int], pattern: str = PATTERN):
        if len(set(tokens.values())) != len(tokens) or min(tokens.values()) < 0:
            raise ValueError("ranks must be distinct and not negative")
        missing = [byte for byte in range(256) if bytes([byte]) not in tokens]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.pattern = pattern
        self.classes = _classes() if pattern == PATTERN else None
        by_id = [b""] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            by_id[rank] = token
        self.lengths = np.array([len(token) for token in by_id], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        whole = hash_spans(self.data, self.begins[:-1], self.begins[1:])
        self.order = np.argsort(whole, kind="stable")
        self.whole = whole[self.order]
        self.bytes = np.array([tokens[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs, merged = [], []
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        self._fill(np.array(pairs, dtype=np.uint64), np.array(merged, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(4 * len(keys) + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, _FREE), np.full(size, _NONE)
        at, self.probes = self._slots(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.values[at] == _NONE)
            won = free[np.unique(at[free], return_index=True)[1]]  # one of those that want a slot
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.ones(len(keys), dtype=bool)
            left[won] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) % size

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges to; ``_NONE`` for none and for padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        out = np.full(len(keys), _NONE)
        which, at = np.flatnonzero((left >= 0) & (right >= 0)), self._slots(keys)
        at = at[which]
        while len(which):
            held = self.keys[at]
            hit = held == keys[which]
            out[which[hit]] = self.values[at[hit]]
            on = ~hit & (held != _FREE)
            which, at = which[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Start and end byte of every piece, and the index of each text's first (and the end)."""
        if not len(data):
            nothing = np.zeros(0, dtype=np.int64)
            return nothing, nothing, np.zeros(len(offsets), dtype=np.int64)
        starts = self._cut_classes(data, offsets) if self.classes is not None else self._cut_regex(data, offsets)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)

    def _cut_classes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        count = len(points)
        fresh = np.zeros(count + 1, dtype=bool)  # where a text begins
        fresh[np.searchsorted(begins, offsets)] = True
        kind = self.classes[points]
        start = np.ones(count, dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | fresh[1:-1]
        # The last space before other characters stands alone or, if it is U+0020, goes with them.
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:-1])
        start[last] = True
        start[last[points[last] == 0x20] + 1] = False
        # An apostrophe that begins a piece and one of these endings are a piece.
        mark = np.flatnonzero((points[:-1] == ord("'")) & start[:-1] & (kind[1:] == _LETTER) & ~fresh[1:-1])
        if len(mark):
            one = points[mark + 1]
            next_at = np.minimum(mark + 2, count - 1)
            two = np.where((mark + 2 < count) & ~fresh[np.minimum(mark + 2, count)], points[next_at], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.isin(one * 0x110000 + two.astype(np.int64), [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])
            ended = np.concatenate([mark[short] + 2, mark[long] + 3])
            start[mark[short | long] + 1] = False
            ended = ended[ended < count]
            ended = ended[(kind[ended] == _LETTER) & ~fresh[ended]]
            start[ended] = True
        return begins[start]

    def _cut_regex(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        import regex

        pattern, raw = regex.compile(self.pattern), data.tobytes()
        starts = []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for piece in pattern.findall(raw[begin:end].decode()):
                starts.append(begin)
                begin += len(piece.encode())
        return np.array(starts, dtype=np.int64)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of each text's."""
        ids, numbers = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for _, _, data, offsets in slices(texts):
            starts, ends, first = self.pieces(data, offsets)
            hashes = hash_spans(data, starts, ends)
            distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
            if ((ends - starts) != (ends - starts)[one][which]).any():
                raise ArithmeticError("two pieces of different length have one hash")
            flat, counts = self.encode_spans(data, starts[one], ends[one], distinct)
            begin = np.cumsum(counts) - counts
            own = counts[which]
            place = np.cumsum(own) - own
            ids.append(flat[np.repeat(begin[which] - place, own) + np.arange(own.sum())])
            numbers.append(np.diff(np.concatenate([[0], np.cumsum(own)])[first]))
        return np.concatenate(ids), np.concatenate(numbers)

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        """All ids of some pieces in a row, and the number of each piece's."""
        sizes = ends - starts
        at = np.minimum(np.searchsorted(self.whole, hashes), len(self.whole) - 1)
        token = np.where(self.whole[at] == hashes, self.order[at], -1)
        token[(token >= 0) & (self.lengths[token] != sizes)] = -1
        rows = [np.flatnonzero(token >= 0)]
        found = [token[rows[0]].astype(np.int32)]
        counts = [np.ones(len(rows[0]), dtype=np.int64)]
        rest = np.flatnonzero(token < 0)
        for k in rest[sizes[rest] > LONG]:
            merged = self._merge_long(data[starts[k] : ends[k]])
            rows.append(np.array([k]))
            found.append(np.array(merged, dtype=np.int32))
            counts.append(np.array([len(merged)]))
        rest = rest[sizes[rest] <= LONG]
        # Buckets of one length up to 16 bytes, of four to 64, then of doubling ones.
        width = sizes[rest]
        width = np.where(width > 16, (width + 3) // 4 * 4, width)
        width = np.where(width > 64, 1 << np.ceil(np.log2(np.maximum(width, 1))).astype(np.int64), width)
        padded = np.concatenate([data, np.zeros(LONG, dtype=np.uint8)])
        for wide in np.unique(width):
            members = rest[width == wide]
            step = max(1, CELLS // int(wide))
            for first in range(0, len(members), step):
                own = members[first : first + step]
                columns = np.arange(wide)
                ids = self.bytes[padded[starts[own][:, None] + columns]]
                ids[columns >= sizes[own][:, None]] = -1
                self._merge_matrix(own, ids, rows, found, counts)
        rows, counts, flat = np.concatenate(rows), np.concatenate(counts), np.concatenate(found)
        # Back in the order of the pieces.
        order = np.argsort(rows, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        place = np.cumsum(counts) - counts
        return flat[np.repeat(begin - place, counts) + np.arange(counts.sum())], counts

    def _merge_matrix(self, rows, ids, out_rows, out_ids, out_counts) -> None:
        wide = ids.shape[1]
        ranks = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), wide - 1)
        while len(rows):
            if wide > 1:
                place = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), place]
                on = best != _NONE
            else:
                on = np.zeros(len(rows), dtype=bool)
            if not on.all():
                done = ids[~on]
                real = done >= 0
                out_rows.append(rows[~on])
                out_ids.append(done[real])
                out_counts.append(real.sum(axis=1))
                rows, ids = rows[on], ids[on]
                if not len(rows):
                    return
                ranks, place, best = ranks[on], place[on], best[on]
            every = np.arange(len(rows))
            ids[every, place] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[every, place + 1] = False
            wide -= 1
            ids = ids[keep].reshape(len(rows), wide)
            keep = np.ones(ranks.shape, dtype=bool)
            keep[every, place] = False
            ranks = ranks[keep].reshape(len(rows), wide - 1)
            before = np.flatnonzero(place > 0)
            at = place[before]
            ranks[before, at - 1] = self.lookup(ids[before, at - 1], best[before])
            after = np.flatnonzero(place < wide - 1)
            at = place[after]
            ranks[after, at] = self.lookup(best[after], ids[after, at + 1])

    def _merge_long(self, piece: np.ndarray) -> list[int]:
        ids = self.bytes[piece]
        wanted = self.lookup(ids[:-1], ids[1:]).tolist() + [int(_NONE)]
        ids, size, none = ids.tolist(), len(ids), int(_NONE)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        known: dict[tuple[int, int], int] = {}
        heap = [(rank, k) for k, rank in enumerate(wanted) if rank != none]
        heapq.heapify(heap)

        def renew(k: int) -> None:
            wanted[k] = none
            if after[k] < size:
                pair = ids[k], ids[after[k]]
                if pair not in known:
                    known[pair] = int(self.lookup(np.array([pair[0]]), np.array([pair[1]]))[0])
                wanted[k] = known[pair]
                if wanted[k] != none:
                    heapq.heappush(heap, (wanted[k], k))

        while heap:
            rank, k = heapq.heappop(heap)
            if wanted[k] != rank or ids[k] < 0:
                continue
            gone = after[k]
            ids[k], ids[gone], wanted[gone] = rank, -1, none
            after[k] = after[gone]
            if after[k] < size:
                before[after[k]] = k
            renew(k)
            if before[k] >= 0:
                renew(before[k])
        return [x for x in ids if x >= 0]

    def decode_ids(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the number of each id's."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id has no token in the vocabulary")
        sizes = self.lengths[ids]
        place = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.begins[ids] - place, sizes) + np.arange(sizes.sum())], sizes


def read_ranks(path: str, pattern: str = PATTERN) -> Vocabulary:
    """The vocabulary of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({b64decode(t): int(r) for t, r in map(bytes.split, lines)}, pattern)


def share(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    return spark.sparkContext.broadcast(vocabulary)


def encode(text: Column, vocabulary: Broadcast) -> Column:
    """The ids of each text, as ``array<int>``."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        flat, counts = vocabulary.value.encode_texts(texts)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))

    return ids(text)


def decode_lists(vocabulary: Vocabulary, lists: pa.Array) -> pa.Array:
    """The bytes of each list of ids; null for a null list."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    out, sizes, first = [np.zeros(0, dtype=np.uint8)], [np.zeros(0, dtype=np.int64)], 0
    while first < len(lists):
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + IDS, side="right")))
        flat = lists.slice(first, end - first).flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        data, of = vocabulary.decode_ids(flat.to_numpy(zero_copy_only=False))
        bytes_to = np.concatenate([[0], np.cumsum(of)])[ends[first:end] - done]
        out.append(data)
        sizes.append(np.diff(np.concatenate([[0], bytes_to])))
        first = end
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    known = None
    if lists.null_count:
        known = pa.array(lists.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]
    values = pa.py_buffer(np.concatenate(out))
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [known, pa.py_buffer(offsets), values])
    return whole.cast(pa.binary())


def decode(ids: Column, vocabulary: Broadcast) -> Column:
    """The bytes of each list of ids, as ``binary``; of a whole text, its UTF-8."""

    @F.arrow_udf(BinaryType())
    def data(lists: pa.Array) -> pa.Array:
        return decode_lists(vocabulary.value, lists)

    return data(ids)
