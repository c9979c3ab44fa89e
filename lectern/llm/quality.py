"""Quality scores from a factorisation machine.

Inputs are hashed words (2**bits of them, weighted by the root of their
frequency, each text's vector scaled to length 1), statistics of the text's
structure and metadata (its length).  The pairwise interactions have rank
``rank`` and are summed in linear time with the sum-of-squares identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The machine is fitted on the driver on at most ``train_rows`` labelled
documents; scoring is one map over whole texts with the model (about 0.3 MB)
sent along.

Null and empty texts get the score of a text without words; texts of any length
are read whole; repeated rows give repeated results; a null id is dealt as the
empty text and takes no label; extra columns, whatever their names, play no part;
without labels every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv
from .sample import labelled_sample

N_STATS = 14
_ALL = np.arange(256)
_UPPER = (_ALL >= 65) & (_ALL <= 90)
_LOWER = (_ALL >= 97) & (_ALL <= 122)
_DIGIT = (_ALL >= 48) & (_ALL <= 57)
_HIGH = _ALL >= 128
_STOP = np.isin(_ALL, [ord(c) for c in ".,;:!?'\""])
_SYMBOL = (_ALL > 32) & (_ALL < 127) & ~(_UPPER | _LOWER | _DIGIT | _STOP)
_LINES = _ALL != 10


def _sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values)])
    return c[of[1:]] - c[of[:-1]]


def _distinct(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its most frequent one stands."""
    n = len(of) - 1
    doc = np.repeat(np.arange(n), np.diff(of)).astype(np.uint64)
    key = np.sort((doc << np.uint64(44)) | (h >> np.uint64(20)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    of_doc = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of_doc, times)
    return np.bincount(of_doc, minlength=n).astype(float), most


def features(s: tv.Slice, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words in rows (bucket, value, offsets) and the statistics of each document."""
    w = tv.words(s, tv.ALNUM)
    h = tv.hashes(s, w)
    doc = w.doc.astype(np.uint64)
    key = np.sort((doc << np.uint64(32)) | (h >> np.uint64(64 - bits)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value = np.sqrt(np.diff(np.append(first, len(key))).astype(np.float32))
    of_doc = (key[first] >> np.uint64(32)).astype(np.int64)
    bucket = (key[first] & np.uint64((1 << bits) - 1)).astype(np.int32)
    norm = np.sqrt(np.bincount(of_doc, value.astype(float) ** 2, minlength=s.n))
    value = value / norm[of_doc].astype(np.float32) if len(value) else value
    ptr = np.concatenate([[0], np.cumsum(np.bincount(of_doc, minlength=s.n))])

    size = np.maximum(np.diff(s.off), 1).astype(float)
    share = lambda mask: _sums(mask[s.buf], s.off) / size
    n_words = w.counts.astype(float)
    words = np.maximum(n_words, 1)
    distinct, most = _distinct(h, w.of)
    lines = tv.words(s, _LINES)
    line_kinds, line_most = _distinct(tv.hashes(s, lines), lines.of)
    n_lines = np.maximum(lines.counts, 1)
    stats = np.stack([
        np.log1p(np.diff(s.off)), np.log1p(n_words), _sums(w.end - w.start, w.of) / words, share(_UPPER), share(_LOWER), share(_DIGIT), share(_HIGH), share(_STOP), share(_SYMBOL),
        distinct / words, most / words, line_kinds / n_lines, line_most / n_lines, np.log1p(n_words / n_lines),
    ], axis=1)
    return bucket, value, ptr, stats


@dataclass
class Machine:
    bits: int
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)

    def logits(self, bucket, value, ptr, x) -> tuple[np.ndarray, np.ndarray]:
        """Of each document, and the factors' sums."""
        n, d = len(ptr) - 1, 1 << self.bits
        rows = np.repeat(np.arange(n), np.diff(ptr))
        total = lambda a: np.bincount(rows, a, minlength=n)
        v, vs, ws = self.v[bucket], self.v[d:], self.w[d:]
        linear = self.bias + total(self.w[bucket] * value) + x @ ws
        sums = np.stack([total(v[:, f] * value) for f in range(v.shape[1])], axis=1) + x @ vs
        squares = total((v**2).sum(1) * value**2) + (x**2) @ (vs**2).sum(1)
        return linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, s: tv.Slice) -> np.ndarray:
        bucket, value, ptr, stats = features(s, self.bits)
        z, _ = self.logits(bucket, value, ptr, self.scaled(stats))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], bits: int, rank: int = 8, epochs: int = 12, batch: int = 128, rate: float = 0.08, penalty: float = 2e-5) -> Machine:
    """Adagrad on the logistic loss over (bucket, value, statistics, label) of each document."""
    d, rng = 1 << bits, np.random.Generator(np.random.PCG64(7))
    m = Machine(bits, 0.0, np.zeros(d + N_STATS, np.float32), (rng.standard_normal((d + N_STATS, rank)) * 0.03).astype(np.float32), np.zeros(N_STATS), np.ones(N_STATS))
    if not rows:
        m.v[:] = 0.0
        return m
    stats, y = np.stack([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-3
    rate_of_1 = (y.sum() + 1) / (len(y) + 2)
    m.bias = float(np.log(rate_of_1 / (1 - rate_of_1)))
    x_all = m.scaled(stats)
    gw, gv, gb = np.full(len(m.w), 1e-3, np.float32), np.full(m.v.shape, 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            bucket, value = (np.concatenate([rows[j][k] for j in part]) for k in (0, 1))
            ptr = np.concatenate([[0], np.cumsum([len(rows[j][0]) for j in part])])
            x = x_all[part]
            z, sums = m.logits(bucket, value, ptr, x)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            each, doc = np.repeat(g, np.diff(ptr)), np.repeat(np.arange(len(part)), np.diff(ptr))
            ids, back = np.unique(bucket, return_inverse=True)
            dw = np.bincount(back, each * value, minlength=len(ids))
            v = m.v[bucket]
            grad = (each * value)[:, None] * (sums[doc] - v * value[:, None])
            dv = np.stack([np.bincount(back, grad[:, f], minlength=len(ids)) for f in range(rank)], axis=1)
            vs = m.v[d:]
            dws = x.T @ g
            dvs = np.einsum("n,ni,nf->if", g, x, sums) - np.einsum("n,ni,if->if", g, x**2, vs)
            for at, a, b in ((ids, dw, dv), (np.arange(d, d + N_STATS), dws, dvs)):
                a, b = a + penalty * m.w[at], b + penalty * m.v[at]
                gw[at] += a**2
                gv[at] += b**2
                m.w[at] -= rate * a / np.sqrt(gw[at])
                m.v[at] -= 0.5 * rate * b / np.sqrt(gv[at])
            gb += float(g.sum()) ** 2
            m.bias -= rate * float(g.sum()) / gb**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", modulus: int = 4, excluded: int = 2, train_rows: int = 8000, bits: int = 13) -> Machine:
    """train_rows bounds what the driver gets: about 2 kB a document."""
    sample = labelled_sample(docs, labels, target, modulus, excluded, train_rows)

    def run(s: tv.Slice) -> dict:
        import pyarrow as pa

        bucket, value, ptr, stats = features(s, bits)
        cut = lambda a: [a[i:j].tobytes() for i, j in zip(ptr, ptr[1:], strict=False)]
        return {"bucket": pa.array(cut(bucket), pa.binary()), "value": pa.array(cut(value.astype(np.float32)), pa.binary()), "stats": pa.array([r.tobytes() for r in stats.astype(np.float64)], pa.binary())}

    made = _spark.map_text(sample, ["doc_id", "y"], "text", "bucket binary, value binary, stats binary", run)
    got = sorted(made.collect(), key=lambda r: (r.doc_id, r.bucket, r.value))
    return fit([(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.value, np.float32), np.frombuffer(r.stats), r.y) for r in got], bits)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 4, excluded: int = 2, threshold: float = 0.7, train_rows: int = 8000) -> DataFrame:
    model = train(docs, labels, "quality", modulus, excluded, train_rows)
    out = _spark.map_text(docs, ["doc_id"], "text", "score double", lambda s: {"score": model.scores(s).astype(np.float64)})
    return out.select("doc_id", (_spark.crc_mod("doc_id", modulus) == excluded).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
