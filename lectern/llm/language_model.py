"""Language-model scores from a log-frequency Bloom filter.

Counting: one pass over all training texts; each task counts its words and word
pairs by 64-bit hashes and sends sorted runs, dealt by hash to parts.  A part
adds them up, one kind at a time, and makes (a) its exact word counts and (b) its
segment of the filter.  There is a part for every ``part_bytes`` of text, so a
part's size doesn't grow with the corpus.

The filter holds, for an n-gram of count c, the keys (n-gram, 1) to (n-gram, q),
where q is the number of ``STEPS`` (1, 2, 3, 4, 6, 8, 12, 16, ...: two to a
doubling) that c reaches.  A lookup probes level after level until one is missing
and so learns q, that is the two steps between which c lies; a false positive,
of a probability of about 2**-probes, can only raise it.

No n-gram is left out, whatever their number: segments have ``bits_per_key`` bits
a key, and the workers get them in groups of at most ``max_filter_bytes`` (a
single larger segment alone), which bounds what is broadcast.  One group is the
usual case; with more, each group is probed in a pass over the texts of its own,
which writes down the levels that it finds, and the last one scores.  The result
is the same, byte for byte.

The exact counts of the words of the ``table_size`` largest ones are broadcast
(12 bytes each) for base_score; rarer words are looked up by a join on their
hashes, for which the filter leaves only words that are held (and false ones).

Scores: base_score is the sum over tokens of log10((c+1) / (N+V+1)).  score is
the model's: a text starts after an end token, and

    P(w | v) = a * lo(v w) / hi(v) + (1 - a) * (lo(w) + 1) / (N + V + 1)

lo and hi are the ends of the step of a count, so that (false positives aside)
the probabilities after v of all known words and one unknown sum to at most 1.
a is 0 where v is unknown, else the share of a training pair's occurrences that
are not its only one (Good and Turing's estimate that a pair was seen before).

A text of no words (null, empty, white space) is one token, the end.  Repeated
rows and ids count and score each for themselves; a null id is dealt as the empty
text.  Extra columns play no part, whatever their names.  Without training texts
N and V are 0 and every token has probability 1; an empty table gives an empty
result.  Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv

END = tv.U64(0x2545F4914F6CDD1D)
FLUSH = 1 << 21
WORDS, PAIRS = 0, 1
#: What a count must reach for each level, from 1.
STEPS = np.unique(np.ceil(2.0 ** (np.arange(124) / 2)).astype(np.int64))
_LOW = np.concatenate([[0], STEPS]).astype(float)
_HIGH = np.concatenate([[0], STEPS[1:] - 1, [STEPS[-1]]]).astype(float)


def tokens(s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document, each followed by an end token, and their offsets."""
    w = tv.words(s, tv.NONSPACE)
    h = tv.hashes(s, w)
    of = w.of + np.arange(s.n + 1)
    out = np.full(of[-1], END, tv.U64)
    if len(h):
        out[np.arange(len(h)) + w.doc] = h
    return out, of


def pairs(t: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The hash of each token after its predecessor; the first of a text follows an end token."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[of[:-1]] = END
    return tv.mix(before * tv.U64(0x9E3779B97F4A7C15) + tv.mix(t + tv.U64(0x632BE59BD9B4E019)))


def add_up(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    keys, counts = (np.concatenate([r[i] for r in runs]) if runs else np.zeros(0, t) for i, t in ((0, tv.U64), (1, np.int64)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _of_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> tv.U64(32)) * tv.U64(parts) >> tv.U64(32)).astype(np.int64)


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Keys as 8 bytes each, counts in the fewest bytes that hold the largest."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not len(counts) or counts.max() <= np.iinfo(t).max)
    return keys.tobytes(), bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[counts[0]]
    return np.frombuffer(keys, tv.U64), np.frombuffer(counts, kind, offset=1).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STEPS, counts, side="right")


def _state(keys: np.ndarray, level: int) -> np.ndarray:
    return tv.mix(keys + tv.U64(level * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))


def _place(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((x >> tv.U64(32)) * bits >> tv.U64(32)).astype(np.int64)


def _step(x: np.ndarray) -> np.ndarray:
    x = x * tv.U64(0xD6E8FEB86659FD93) + tv.U64(1)
    return x ^ (x >> tv.U64(29))


def segment(keys: np.ndarray, counts: np.ndarray, bits_per_key: int, n: int) -> bytes:
    """The filter's bits of one part: 8 bytes of their number, then the bits."""
    levels = level_of(counts)
    bits = max(64, bits_per_key * int(levels.sum()))
    flags = np.zeros(-(-bits // 8) * 8, bool)
    for level in range(1, int(levels.max()) + 1 if len(levels) else 1):
        x = _state(keys[levels >= level], level)
        for _ in range(n):
            flags[_place(x, tv.U64(bits))] = True
            x = _step(x)
    return np.int64(bits).tobytes() + np.packbits(flags, bitorder="little").tobytes()


class Filter:
    """Some parts' segments in one array; bits and start (in bits) of each part, of no bits if it isn't here."""

    def __init__(self, data: np.ndarray, bits: np.ndarray, start: np.ndarray, n: int):
        self.data, self.bits, self.start, self.n, self.parts = data, bits, start, n, len(bits)

    @classmethod
    def gathered(cls, segments, parts: int, n: int) -> Filter:
        """From (part, bytes), one at a time."""
        data, bits, start = bytearray(8), np.zeros(parts, tv.U64), np.zeros(parts, np.int64)
        for part, x in segments:
            bits[part], start[part] = np.frombuffer(x, np.int64, 1)[0], 8 * len(data)
            data += memoryview(x)[8:]
        return cls(np.frombuffer(data, np.uint8), bits, start, n)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """q of each key, 0 if it isn't held."""
        part = _of_part(keys, self.parts)
        bits, start = self.bits[part], self.start[part]
        out, live, level = np.zeros(len(keys), np.int64), np.flatnonzero(bits), 1
        while len(live):
            x = _state(keys[live], level)
            for _ in range(self.n):
                at = start[live] + _place(x, bits[live])
                hit = ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                live, x = live[hit], _step(x[hit])
            out[live] = level
            level += 1
        return out


COUNTED = "part long, kind int, keys binary, counts binary"
MERGED = "part long, kind int, keys binary, counts binary, bits binary, n_bits long, tokens long, single long"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f for f, _ in fields])


def counted(texts: DataFrame, parts: int) -> DataFrame:
    """COUNTED: sorted runs of words and pairs with their counts, by part."""

    def count(batches):
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush():
            for kind in (WORDS, PAIRS):
                keys, counts = np.unique(np.concatenate(held[kind]) if held[kind] else np.zeros(0, tv.U64), return_counts=True)
                part = _of_part(keys, parts)
                edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
                for i in range(0, len(edge) - 1, 4096):
                    some = edge[i : i + 4097]
                    yield _rows(COUNTED, [(int(part[a]), kind, *_pack(keys[a:b], counts[a:b])) for a, b in zip(some, some[1:], strict=False)])
                held[kind].clear()

        for batch in batches:
            for s in tv.slices(batch.column(0)):
                t, of = tokens(s)
                held[WORDS].append(t)
                held[PAIRS].append(pairs(t, of))
                size += len(t)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(_spark.tidy(count), COUNTED)


def train(spark: SparkSession, texts: DataFrame, text: str, parts: int, bits_per_key: int, probes: int) -> DataFrame:
    """MERGED: for each part, its words with their counts and its segment of words, and its segment of pairs."""

    def merge(batches):
        """Rows come sorted, so that one part's words or pairs are held at a time."""
        at, runs = None, []

        def done():
            keys, counts = add_up(runs)
            runs.clear()
            bits = segment(keys, counts, bits_per_key, probes)
            packed = _pack(keys, counts) if at[1] == WORDS else (b"", b"")
            yield _rows(MERGED, [(*at, *packed, bits, len(bits), int(counts.sum()), int((counts == 1).sum()))])

        for batch in batches:
            for p, kind, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != (p, kind):
                    if at is not None:
                        yield from done()
                    at = (p, kind)
                runs.append(_unpack(keys, counts))
                if sum(len(r[0]) for r in runs[1:]) > 2 * len(runs[0][0]) + 100_000:
                    runs[:] = [add_up(runs)]
        if at is not None:
            yield from done()

    runs = counted(texts.select(F.col(text).cast("string").alias("t")), parts)
    merged = runs.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_spark.tidy(merge), MERGED)
    return _spark.materialize(spark, merged, "lm-counts")


def word_table(words: DataFrame, table_size: int) -> tuple[int, int]:
    """The number of different words, and the least count of the exact table: at most ``table_size`` words have it."""

    def histogram(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c, n = np.unique(np.minimum(_unpack(keys, counts)[1], 1 << 16), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["c", "n"])

    rows = words.select("keys", "counts").mapInArrow(histogram, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    threshold, room = 1 << 62, table_size
    for r in sorted(rows, key=lambda r: -r.c):
        if r.n > room:
            break
        room, threshold = room - r.n, r.c
    return sum(r.n for r in rows), threshold


def exact_table(words: DataFrame, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words that stand threshold times or more: at most table_size."""

    def pick(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = _unpack(keys, counts)
                a, b = _pack(k[c >= threshold], c[c >= threshold])
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["keys", "counts"])

    got = words.select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").collect()
    return add_up([_unpack(bytes(r["keys"]), bytes(r["counts"])) for r in got])


def lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Counts, 0 for what the table lacks."""
    have, counts = table
    if not len(have):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, counts[at], 0)


def groups_of(merged: DataFrame, max_bytes: int) -> list[tuple[int, int]]:
    """First and last part of each group of segments, of at most max_bytes each (a single larger part alone)."""
    out: list[list[int]] = []
    for r in merged.groupBy("part").agg(F.sum("n_bits").alias("n")).orderBy("part").toLocalIterator():
        if not out or out[-1][2] + r.n > max_bytes:
            out.append([r.part, r.part, 0])
        out[-1][1], out[-1][2] = r.part, out[-1][2] + r.n
    return [(a, b) for a, b, _ in out] or [(0, 0)]


def _filters(merged: DataFrame, first: int, last: int, parts: int, probes: int) -> list[Filter]:
    some = merged.where(F.col("part").between(first, last))
    return [Filter.gathered(((r.part, r.bits) for r in some.where(F.col("kind") == kind).select("part", "bits").toLocalIterator()), parts, probes) for kind in (WORDS, PAIRS)]


class Scorer:
    """The model: what is known of it in numbers, besides the filter."""

    def __init__(self, n_train: int, v_train: int, weight: float):
        self.denominator, self.weight = max(n_train + v_train + 1, 1), weight

    def unigram(self, level: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, (_LOW[level] + 1) / self.denominator)

    def probability(self, before: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of each token, from the levels of the one before, its own, and the pair's."""
        a = np.where(before > 0, self.weight, 0.0)
        return a * np.minimum(1.0, _LOW[pair] / np.maximum(_HIGH[before], 1.0)) + (1 - a) * self.unigram(word)


def _levels(filters: list[Filter], s: tv.Slice, so_far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their offsets, and three rows of levels (the token before, the token, the pair), added to those of earlier passes."""
    t, of = tokens(s)
    kinds, back = np.unique(t, return_inverse=True)
    word = filters[WORDS].levels(kinds)[back]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[of[:-1]] = filters[WORDS].levels(np.array([END]))[0]
    pair, at = np.unique(pairs(t, of), return_inverse=True)
    found = np.stack([before, word, filters[PAIRS].levels(pair)[at]]).astype(np.uint8)
    return t, of, found if so_far is None else found + so_far


def language_model_scores(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2, probes: int = 4, bits_per_key: int = 10, max_filter_bytes: int = 128 << 20, part_bytes: int = 32 << 20, table_size: int = 1 << 20) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    training = docs.where(_spark.crc_mod(id_col, modulus) != held_out)
    size = training.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    merged = train(spark, training, text, parts, bits_per_key, probes)
    words = merged.where(F.col("kind") == WORDS)
    totals = {r.kind: r for r in merged.groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("single").alias("single")).collect()}
    n_train = totals[WORDS].tokens if totals else 0
    v_train, threshold = word_table(words, table_size)
    scorer = Scorer(n_train, v_train, 1 - totals[PAIRS].single / max(totals[PAIRS].tokens, 1) if totals else 0.0)

    picked = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("t"), F.lit(None).cast("binary").alias("levels"))
    kind = picked.schema["id"].dataType.simpleString()
    groups = groups_of(merged, max_filter_bytes)
    for first, last in groups[:-1]:
        picked = _pass(spark, picked, kind, _filters(merged, first, last, parts, probes))
    sent = spark.sparkContext.broadcast((_filters(merged, *groups[-1], parts, probes), exact_table(words, threshold), scorer))

    def score(batches):
        filters, table, scorer = sent.value
        for batch in batches:
            for s in tv.slices(batch.column(1)):
                part = batch.slice(s.first, s.n)
                t, of, (before, word, pair) = _levels(filters, s, _before(part.column(2)))
                doc = np.repeat(np.arange(s.n), np.diff(of))
                kinds, back = np.unique(t, return_inverse=True)
                exact = lookup(table, kinds)
                known = (exact > 0)[back]
                base = np.bincount(doc, np.log10((exact + 1) / scorer.denominator)[back], minlength=s.n)
                model = np.bincount(doc, np.log10(scorer.probability(before, word, pair)), minlength=s.n)
                # rare words: hash and number in each document, to be looked up exactly
                other = np.flatnonzero(~known & (word > 0))
                code = (doc[other].astype(np.int64) << 32) | back[other]
                code, times = np.unique(code, return_counts=True)
                edge = np.searchsorted(code >> 32, np.arange(s.n + 1))
                keys = kinds[code & 0xFFFFFFFF].view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x)) for x in (keys, times.astype(np.int64))]
                cols = [part.column(0), pa.array(np.diff(of)), pa.array(np.bincount(doc, known, minlength=s.n).astype(np.int64)), pa.array(base), pa.array(model), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "n_known", "base", "score", "keys", "times"])

    scored = picked.mapInArrow(_spark.tidy(score), f"id {kind}, n_tokens long, n_known long, base double, score double, keys array<long>, times array<long>")
    # the row's number is written with it, so it stays what it is
    out = _spark.materialize(spark, scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    held = (_spark.crc_mod("id", modulus) == held_out).alias("held_out")
    names = [F.col("id").alias(id_col), held, "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score"]
    if threshold <= 1:  # all known words are in the table
        return out.withColumn("base_score", F.col("base")).select(*names)

    def rarer(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = _unpack(keys, counts)
                yield pa.RecordBatch.from_arrays([pa.array(k[c < threshold].view(np.int64)), pa.array(c[c < threshold])], names=["key", "c"])

    counts = words.select("keys", "counts").mapInArrow(_spark.tidy(rarer), "key long, c long")
    asked = out.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", "x.keys", "x.times")
    met = asked.join(counts, F.col("keys") == F.col("key"))
    add = met.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    joined = out.drop("keys", "times").join(add, "row", "left")
    return joined.select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    ).select(*names)


def _before(column: pa.Array) -> np.ndarray | None:
    """The levels that earlier passes have found, three rows for the tokens of all documents."""
    if column.null_count == len(column):
        return None
    each = [np.frombuffer(x, np.uint8).reshape(3, -1) for x in column.to_pylist()]
    return np.concatenate(each, axis=1)


def _pass(spark: SparkSession, picked: DataFrame, kind: str, filters: list[Filter]) -> DataFrame:
    """picked with the levels that these filters hold added to those in ``levels``."""
    sent = spark.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for s in tv.slices(batch.column(1)):
                part = batch.slice(s.first, s.n)
                _, of, found = _levels(sent.value, s, _before(part.column(2)))
                levels = pa.array([found[:, a:b].tobytes() for a, b in zip(of, of[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), levels], names=["id", "t", "levels"])

    out = _spark.materialize(spark, picked.mapInArrow(_spark.tidy(run), f"id {kind}, t string, levels binary"), "lm-levels")
    sent.unpersist()
    return out
