"""Words and shingles of Arrow text batches as numpy arrays, without a Python object per word.

Texts are cut at byte classes given by a table of 256 entries, so one pass over the bytes finds
every word. Words become 64-bit hashes of their bytes and length. Batches are worked on in slices
of bounded bytes; a single longer text forms a slice of its own. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are gathered into slices of about this many bytes.
SLICE_BYTES = 2 << 20
#: Words in a shingle.
SHINGLE_WORDS = 5

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)

#: Space, tab, line feed, vertical tab, form feed and carriage return separate words.
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[32, *range(9, 14)]] = True

#: What separates words made of letters: every ASCII byte that is not a letter.
NOT_LETTERS = np.array(
    [byte < 128 and not chr(byte).isalpha() for byte in range(256)], dtype=bool
)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, in place (the finalizer of MurmurHash3)."""
    values ^= values >> _S33
    values *= _M1
    values ^= values >> _S33
    values *= _M2
    values ^= values >> _S33
    return values


def slices(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first row, end row, bytes, byte offset of each text and the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + (size or SLICE_BYTES), side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
    """Start and end byte of every word, and the index of each text's first word (and the end)."""
    if not len(data):
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, np.zeros(len(offsets), dtype=np.int64)
    inside = ~separators[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes between each start and end, read eight at a time."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    hashes = left.astype(np.uint64) * _GOLD
    which, at = np.arange(len(starts)), starts
    while len(which):
        chunk = loads[at]
        short = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
        chunk = (chunk << short) >> short
        if len(which) == len(hashes):
            hashes = mix(hashes ^ chunk)
        else:
            hashes[which] = mix(hashes[which] ^ chunk)
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return hashes


def shingle_hashes(
    words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words, and the index of each text's first (and the end).

    A text with fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(first)
    end_of = np.repeat(first[1:], counts)
    place = np.arange(len(words))
    keep = (place + size <= end_of) | (place == np.repeat(first[:-1], counts))
    place, end_of = place[keep], end_of[keep]
    hashes = np.zeros(len(place), dtype=np.uint64)
    for j in range(size):
        at = place + j
        if j == 0 or (inside := at < end_of).all():
            hashes = (hashes ^ words[at]) * _M1
        else:
            hashes[inside] = (hashes[inside] ^ words[at[inside]]) * _M1
        hashes ^= hashes >> _S33
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return mix(hashes), np.concatenate([[0], np.cumsum(per_text)])


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    for _, _, data, offsets in slices(texts):
        starts, ends, first = spans(data, offsets, WHITESPACE)
        hashes, begin = shingle_hashes(hash_spans(data, starts, ends), first, size)
        for k in range(len(begin) - 1):
            yield np.unique(hashes[begin[k] : begin[k + 1]])


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list array of numpy rows."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))
