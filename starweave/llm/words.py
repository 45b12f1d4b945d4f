"""Vectorised words, word hashes and word windows over the UTF-8 bytes of many texts.

A word is a maximal run of bytes of one byte class. Both classes used here (anything but ASCII white space; ASCII
letters and digits and everything beyond ASCII) never cut a UTF-8 sequence, so byte runs are code point runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_SLOTS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _byte_class(kept) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for b in range(256):
        out[b] = kept(b)
    return out


#: [^\x20\x09-\x0D]+
NOT_SPACE = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_weights(place: np.ndarray, longest: int) -> np.ndarray:
    """The hash weight of each place in a word; beyond 65,536 places the block counts too, so that none repeats."""
    weights = _POWERS[place & 0xFFFF]
    if longest > 1 << 16:
        weights = weights ^ (mix((place >> 16).astype(np.uint64)) << np.uint64(1))  # nothing changes in the first block
    return weights


def hash_bytes(raw: np.ndarray, fold: bool = False) -> np.ndarray:
    """One odd random number a byte; with fold A-Z count as a-z."""
    return (_BYTE[_FOLD] if fold else _BYTE)[raw]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to
        at = to


@dataclass
class Words:
    starts: np.ndarray  # byte positions in the chunk
    ends: np.ndarray
    doc: np.ndarray  # row in the chunk of each word
    first: np.ndarray  # first word of each row, and the number of words at the end


def split_words(raw: np.ndarray, offsets: np.ndarray, kept: np.ndarray = NOT_SPACE) -> Words:
    n = len(raw)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = kept[raw]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def hash_words(raw: np.ndarray, words: Words, fold: bool = True) -> np.ndarray:
    """One 64-bit hash a word; with fold A-Z count as a-z."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    lengths = words.ends - words.starts
    at = np.repeat(words.starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
    place = at - np.repeat(words.starts, lengths)
    values = hash_bytes(raw[at], fold) * place_weights(place, int(lengths.max()))
    sums = np.add.reduceat(values, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return mix(sums + lengths.astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by the run's first word; runs may cross texts (see whole_windows)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _SLOTS[k & 63]
    return mix(out + np.uint64(size))


def whole_windows(words: Words, size: int) -> np.ndarray:
    """First words of the runs that lie in one text."""
    n = len(words.doc) - size + 1
    return np.flatnonzero(words.doc[:n] == words.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def short_windows(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) of the texts with some, but fewer than size words: their whole sequence."""
    counts = np.diff(words.first)
    rows = np.flatnonzero((counts > 0) & (counts < size))
    out = np.zeros(len(rows), np.uint64)
    for n in range(1, size):
        of = counts[rows] == n
        if of.any():
            first = words.first[:-1][rows[of]]
            total = np.zeros(len(first), np.uint64)
            for k in range(n):
                total += hashes[first + k] * _SLOTS[k & 63]
            out[of] = mix(total + np.uint64(n))
    return rows, out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the distinct shingles of each text: sorted within a text; first has each text's first place."""
    words = split_words(raw, offsets)
    h = hash_words(raw, words)
    at = whole_windows(words, size)
    rows, short = short_windows(h, words, size)
    doc = np.concatenate([words.doc[at], rows])
    gram = np.concatenate([windows(h, size)[at], short])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    fresh = np.ones(len(gram), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[fresh], gram[fresh]
    return gram, np.searchsorted(doc, np.arange(len(offsets)))
