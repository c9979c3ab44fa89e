"""Benchmark decontamination by SimHash of item-sized windows.

For each length L of items, windows of L words of every document (the whole
document if it is shorter) get a 64-bit SimHash of their shingles.  A multi-index
over ``radius + 1`` blocks of the items' fingerprints finds the items within
``radius`` of a window's: of so many blocks one at least must be equal.
Candidates are then verified by the exact weighted similarity of shingles,
sum(min(count)) / sum(max(count)) >= ``threshold``.

A similarity of ``threshold`` needs a share of common shingles, which bounds the
work without losing a match: (1) an item is entered in the multi-index under each
of its rarest shingles (as many as a match can't all lack), so a window is
compared with items that it shares one with, not with all of its length; (2) a
window needs that share of its places to hold shingles of some item.  Windows
are taken in slices of at most ``SLICE`` shingles, whatever the items' length.

Shingles are ``k`` consecutive words (all words of an item or window of fewer),
words are letters and digits with A-Z lower-cased, so case, punctuation and
line breaks don't hide a passage.  The default radius is 3.5 standard
deviations beyond the expected distance at a similarity of 0.8.

The items are sent to the workers in blocks of at most ``block_words`` words (a
larger item alone); with more, the documents are read once for each block.

Null and empty texts match nothing, items without words are left out; repeated
rows match each for themselves; several items with one text all match, items of
one id count as one; of equally similar windows the first is given.  Texts of any
length are read whole.  Extra columns are kept by ``clean`` and not read
otherwise, whatever their names.  Empty tables, of documents or items, match nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv

K = 5
THRESHOLD = 0.8
RADIUS = 20
SLICE = 1 << 18


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, borders of documents ignored; runs past the end are of fewer."""
    out = np.zeros(len(h), tv.U64)
    for i in range(k):
        nxt = np.zeros(len(h), tv.U64)
        nxt[: len(h) - i] = h[i:]
        out = tv.mix(out * tv.U64(0xD6E8FEB86659FD93) + nxt)
    return out


def simhash(groups: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes: bit b is set if most shingles have it set."""
    n, m = groups.shape
    bits = np.unpackbits(groups.astype("<u8").view(np.uint8).reshape(n, m, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1, dtype=np.int32) > m, axis=1, bitorder="little").reshape(n, 8).view("<u8")[:, 0]


def blocks_of(prints: np.ndarray, radius: int) -> np.ndarray:
    """radius + 1 blocks of bits of each fingerprint, as rows."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return np.stack([(prints >> tv.U64(a)) & tv.U64((1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)], axis=1)


@dataclass
class ItemsOfLength:
    """The items of one length: fingerprints, shingle counts, and the multi-index."""

    length: int
    k: int
    threshold: float = THRESHOLD
    ids: list = field(default_factory=list)
    prints: list = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)

    @property
    def size(self) -> int:
        """Shingles of an item."""
        return self.length - self.k + 1

    def needed(self, have: np.ndarray | int):
        """The least number of shingles that a window of so many must share with an item."""
        return np.ceil(self.threshold * (have + self.size) / (1 + self.threshold) - 1e-9)

    def seal(self, radius: int) -> None:
        self.prints = np.array(self.prints, tv.U64)
        common = Counter(x for c in self.counts for x in c)
        lack = self.size - math.ceil(self.threshold * self.size - 1e-9)  # of an item's shingles, in its shortest match
        rare: list[tuple[int, int]] = []
        for i, c in enumerate(self.counts):
            left = lack + 1
            for x in sorted(c, key=lambda x: (common[x], x)):
                if left <= 0:
                    break
                rare.append((x, i))
                left -= c[x]
        shingle, item = np.array([x for x, _ in rare], tv.U64), np.array([i for _, i in rare], np.int64)
        keys = _block_keys(shingle, self.prints[item], radius)
        order = np.argsort(keys.reshape(-1), kind="stable")
        self.keys, self.items = keys.reshape(-1)[order], np.repeat(item, radius + 1)[order]
        self.seeds, self.rare = np.unique(np.array(list(common), tv.U64)), np.unique(shingle)

    def within(self, prints: np.ndarray, window: np.ndarray, shingle: np.ndarray, radius: int) -> np.ndarray:
        """(window, item), as rows, of all pairs within radius that share one of the given rare shingles of windows."""
        keys = _block_keys(shingle, prints[window], radius).reshape(-1)
        of = np.repeat(window, radius + 1)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = np.repeat(of, hi - lo) * len(self.ids) + self.items[np.repeat(lo, hi - lo) + _ramp(hi - lo)]
        w, i = np.divmod(np.unique(found), len(self.ids))
        near = np.bitwise_count(prints[w] ^ self.prints[i]) <= radius
        return np.stack([w[near], i[near]], axis=1)


def _block_keys(shingle: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """The multi-index's keys, a row for each shingle and fingerprint: a block's number and bits, and the shingle."""
    blocks = blocks_of(prints, radius) + (np.arange(radius + 1, dtype=np.uint64) << tv.U64(58))[None, :]
    return tv.mix(shingle[:, None] * tv.U64(0x9E3779B97F4A7C15) + tv.mix(blocks))


def _held(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Matcher:
    """Finds the windows of documents that match items."""

    def __init__(self, items: list[tuple[object, str | None]], k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS):
        self.k, self.threshold, self.radius = k, threshold, radius
        groups: dict[int, ItemsOfLength] = {}
        seeds: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            s = next(tv.of_texts([text]))
            h = tv.hashes(s, tv.words(s, tv.ALNUM))
            if not len(h):
                continue
            size = min(k, len(h))
            g = groups.setdefault(len(h), ItemsOfLength(len(h), size, threshold))
            sh = run_hashes(h, size)[: len(h) - size + 1]
            g.ids.append(item)
            g.prints.append(simhash(sh[None, :])[0])
            g.counts.append(Counter(sh.tolist()))
            seeds.setdefault(size, []).append(sh)
        self.groups = [groups[n] for n in sorted(groups)]
        for g in self.groups:
            g.seal(radius)
        self.seeds = {}
        for size, parts in seeds.items():
            keys = np.unique(np.concatenate(parts))
            door = np.zeros(1 << 16, bool)
            door[(keys >> tv.U64(48)).astype(np.int64)] = True
            self.seeds[size] = (keys, door)

    def matches(self, s: tv.Slice) -> list[tuple[int, object, float, int, int]]:
        """(document, item, similarity, first word, words) of the best window of each pair."""
        w = tv.words(s, tv.ALNUM)
        h = tv.hashes(s, w)
        best: dict[tuple[int, object], tuple[float, int, int]] = {}
        if not len(h):
            return []
        doc = w.doc
        for size, (keys, door) in self.seeds.items():
            sh = run_hashes(h, size)
            maybe = np.flatnonzero(door[(sh >> tv.U64(48)).astype(np.int64)])
            maybe = maybe[keys[np.minimum(np.searchsorted(keys, sh[maybe]), len(keys) - 1)] == sh[maybe]]
            maybe = maybe[maybe + size <= w.of[doc[maybe] + 1]]
            if not len(maybe):
                continue
            for g in self.groups:
                if g.k == size:
                    own = maybe[_held(g.seeds, sh[maybe])]
                    if len(own):
                        self._windows(g, sh, own, doc, w.of, best)
        return [(d, item, *found) for (d, item), found in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]

    def _windows(self, g, sh, seeds, doc, of, best) -> None:
        """seeds: the places, in order, of shingles of the group's items."""
        rare = seeds[_held(g.rare, sh[seeds])]
        if not len(rare):
            return
        d = doc[rare]
        lo = np.maximum(of[d], rare - (g.length - g.k))
        hi = np.maximum(np.minimum(rare, of[d + 1] - g.length), of[d])  # at least one window, the whole document
        lo = np.maximum(np.minimum(lo, hi), np.concatenate([[0], hi[:-1] + 1]))  # each window once
        n = np.maximum(hi - lo + 1, 0)
        starts = np.repeat(lo, n) + _ramp(n)
        have = np.minimum(of[doc[starts] + 1] - starts - g.k + 1, g.size)
        shared = np.searchsorted(seeds, starts + have) - np.searchsorted(seeds, starts)
        starts = starts[shared >= g.needed(have)]
        short = of[doc[starts] + 1] - starts < g.length
        long, step = starts[~short], max(1, SLICE // g.size)
        for i in range(0, len(long), step):
            part = long[i : i + step]
            self._verify(g, part, sh[part[:, None] + np.arange(g.size)], doc, of, best)
        for at in starts[short]:
            n = int(of[doc[at] + 1] - at) - g.k + 1
            self._verify(g, np.array([at]), sh[at : at + n][None, :], doc, of, best)

    def _verify(self, g, starts, rows, doc, of, best) -> None:
        window, place = np.nonzero(_held(g.rare, rows))
        for x, i in g.within(simhash(rows), window, rows[window, place], self.radius).tolist():
            value = similarity(Counter(rows[x].tolist()), g.counts[i])
            if value >= self.threshold:
                d = int(doc[starts[x]])
                first = int(starts[x] - of[d])
                found = (value, first, rows.shape[1] + g.k - 1)
                key = (d, g.ids[i])
                if key not in best or (-found[0], found[1]) < (-best[key][0], best[key][1]):
                    best[key] = found


def _ramp(counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def item_blocks(bench: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = 400_000):
    """Lists of (id as text, text) of about block_words words each at most (a single larger item alone)."""
    rows = bench.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    size = rows.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    n = max(1, int(-(-size // block_words)))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.collect()]


def contaminated(spark: SparkSession, docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document and item that match."""
    out = None
    for items in item_blocks(bench, item_id, item_text):
        found = _scan(spark, docs, items, doc_id, text, (k, threshold, radius))
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(doc_id), F.col("item").cast(bench.schema[item_id].dataType).alias(item_id), "similarity", "first_word", "n_words")


def _scan(spark, docs, items, doc_id, text, settings) -> DataFrame:
    sent = spark.sparkContext.broadcast(items)
    picked = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()

    def run(batches):
        m = Matcher(sent.value, *settings)
        for batch, s in _spark.text_slices(batches, "text"):
            found = m.matches(s)
            ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            cols = [pa.array([f[i] for f in found], t) for i, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "item", "similarity", "first_word", "n_words"])

    return picked.mapInArrow(_spark.tidy(run), f"id {id_type}, item string, similarity double, first_word long, n_words long")


def clean(spark: SparkSession, docs: DataFrame, bench: DataFrame, text: str = "text", k: int = K, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, whose text matches no item."""
    for items in item_blocks(bench):
        docs = _keep_clean(spark, docs, items, text, (k, threshold, radius))
    return docs


def _keep_clean(spark, docs, items, text, settings) -> DataFrame:
    sent = spark.sparkContext.broadcast(items)
    at = docs.columns.index(text)

    def run(batches):
        m = Matcher(sent.value, *settings)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for s in tv.slices(batch.column(at)):
                for found in m.matches(s):
                    keep[s.first + found[0]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(_spark.tidy(run), docs.schema)
