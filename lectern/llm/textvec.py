"""Vectorised text scanning over Arrow string buffers.

Everything works on the UTF-8 bytes of a slice of documents at once: word
boundaries come from a 256-entry byte table, and the 64-bit hash of each word
is read off a prefix sum of ``table[byte] * r**position`` modulo 2**64, so no
Python object is made per word.  A word never crosses a document border.

Word hashes are 64-bit fingerprints: two different words share one with a
probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20
MAX_DOCS = 1 << 15

_R = U64(0x9E3779B97F4A7C15)
_R_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=U64)


def _lowered(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[65:91] = table[97:123]
    return out


BYTE_VALUES = _BYTE_VALUES
BYTE_VALUES_LOWER = _lowered(_BYTE_VALUES)

#: Bytes of a word that is anything between ASCII white space: ``[^\x20\x09-\x0D]+``.
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of a word of letters and digits, with every non-ASCII character:
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes of a word of letters, with every non-ASCII character: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(21, int(n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash are usable."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@dataclass
class Slice:
    """Some documents: their rows in the batch, bytes and byte offsets."""

    first: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1


@dataclass
class Words:
    """start, end: byte offsets of each word; of: the words of document i are of[i]:of[i+1]."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.counts)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole documents in slices of about ``limit`` bytes; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1), i + MAX_DOCS)
        yield Slice(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def of_texts(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[Slice]:
    return slices(pa.array(texts, type=pa.large_string()), limit)


def words(s: Slice, table: np.ndarray) -> Words:
    inside = table[s.buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    borders = s.off[:-1]
    before[borders[borders < len(inside)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = s.off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, s.off))


def spelled(s: Slice, w: Words, table: np.ndarray) -> pa.LargeStringArray:
    """The words that ``words(s, table)`` gives as strings, A-Z in lower case, without an object for each."""
    offsets = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start, out=offsets[1:])
    letters = _LOWER[s.buf[table[s.buf]]]
    return pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))


def prefix(s: Slice, lower: bool = True) -> np.ndarray:
    p = np.zeros(len(s.buf) + 1, dtype=U64)
    v = (BYTE_VALUES_LOWER if lower else BYTE_VALUES)[s.buf]
    v *= _power("r", _R, len(v))[: len(v)]
    np.cumsum(v, out=p[1:])
    return p


def hashes(s: Slice, w: Words, lower: bool = True) -> np.ndarray:
    """The hash of each word; equal words have equal hashes in every batch."""
    if not len(w.start):
        return np.zeros(0, U64)
    p = prefix(s, lower)
    return mix((p[w.end] - p[w.start]) * _power("inv", _R_INV, len(s.buf) + 1)[w.start] + U64(0x51))


def hash_of(word: str) -> np.uint64:
    """The same hash for one word given as text (already lower-cased)."""
    s = next(of_texts([word]))
    w = Words(np.array([0]), np.array([len(s.buf)]), np.array([0, 1]))
    return hashes(s, w)[0]


def shingles(h: np.ndarray, of: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each document, and their offsets by document.

    A document of 1 to k-1 words has one shingle, all its words; one without words has none.
    """
    counts = np.diff(of)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(n.sum(), U64)
    offs = np.concatenate([[0], np.cumsum(n)])
    if len(out):
        at = np.arange(len(out)) - np.repeat(offs[:-1], n) + np.repeat(of[:-1], n)
        last = np.repeat(of[1:], n) - 1
        for i in range(k):
            p = at + i
            out = mix(out * U64(0xD6E8FEB86659FD93) + np.where(p <= last, h[np.minimum(p, last)], U64(0)))
    return out, offs
