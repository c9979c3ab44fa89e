"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has the logit ``b + sum of
its words' weights``; the sentences' probabilities are joined by noisy-or,
``P(document) = 1 - prod(1 - p_sentence) = 1 - exp(-sum softplus(logit))``,
and the weights are learned from document labels alone.  Afterwards the
sentences' own scores say where the offence is.

Words with a weight are those whose document frequency differs between the two
labels by more than ``least_z`` standard errors; all other words weigh nothing.
They are held by their 64-bit hashes, so no other word shares their weight.
The fit uses at most ``train_rows`` labelled documents: their words are counted
on the executors, the driver gets the places of words with a weight only, and the
``most_words`` (the size of the model) of the strongest difference get a weight.
Scoring is one map over whole texts of any length.

Null and empty texts have no sentence and score 0; of equally bad sentences the
first is the worst; repeated rows give repeated results; a null id is dealt as the
empty text and takes no label; extra columns, whatever their names, are kept by
``keep_clean`` and not read otherwise; without labels every score is 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv
from .sample import labelled_sample

_ENDS = np.zeros(256, np.int64)
_ENDS[[ord("."), ord("!"), ord("?"), 10]] = 1


def sentences(s: tv.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; the sentence of each word; the document, and the first byte, of each sentence.

    Sentences end at . ! ? or a line's end; those without words are none.
    """
    w = tv.words(s, tv.ALNUM)
    h, doc = tv.hashes(s, w), w.doc
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = np.cumsum(_ENDS[s.buf])[w.start] + doc  # a border of documents ends a sentence too
    new = np.concatenate([[True], mark[1:] != mark[:-1]])
    new |= np.concatenate([[True], doc[1:] != doc[:-1]])
    return h, np.cumsum(new) - 1, doc[new], w.start[new]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, h: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        if not len(self.words) or not len(h):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return self.bias + np.bincount(sentence, np.where(self.words[at] == h, self.weights[at], 0.0), minlength=n)

    def scores(self, s: tv.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document; and the probability and first code point of its worst sentence (-1: none)."""
        h, sentence, doc, start = sentences(s)
        z = self.logits(h, sentence, len(doc))
        total = np.bincount(doc, softplus(z), minlength=s.n) if len(doc) else np.zeros(s.n)
        worst, where = np.zeros(s.n), np.full(s.n, -1, np.int64)
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        if len(doc):
            np.maximum.at(worst, doc, p)
            top = np.flatnonzero(p == worst[doc])[::-1]
            begins = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])  # bytes to code points
            where[doc[top]] = (begins[start] - begins[s.off[doc]])[top]
        return -np.expm1(-total), worst, where


def fit(words: np.ndarray, weights: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, int, int]], rounds: int = 300, rate: float = 0.3, penalty: float = 1e-4) -> Model:
    """words: sorted hashes; weights: where to start from; bags: for each document the words it holds
    (indices), the sentence of each, the number of sentences, and the label."""
    y = np.array([b[3] for b in bags], float)
    if not y.sum() or y.all():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    # only sentences that hold such a word differ; the others of a document share one term
    at_w, at_s, doc_s, plain = [], [], [], np.zeros(len(bags))
    for i, (at, sentence, n, _) in enumerate(bags):
        own, local = np.unique(sentence, return_inverse=True)
        at_w.append(at)
        at_s.append(local + len(doc_s))
        doc_s.extend([i] * len(own))
        plain[i] = n - len(own)
    at_w, at_s, doc_s = np.concatenate(at_w).astype(np.int64), np.concatenate(at_s).astype(np.int64), np.array(doc_s, np.int64)
    bias, gb, gw = -8.0, 1e-6, np.full(len(words), 1e-6)
    for _ in range(rounds):
        zs = bias + np.bincount(at_s, weights[at_w], minlength=len(doc_s))
        total = plain * softplus(bias) + np.bincount(doc_s, softplus(zs), minlength=len(bags))
        gone = np.exp(-np.maximum(total, 1e-9))
        slope = np.where(y == 1, -gone / np.maximum(1 - gone, 1e-9), 1.0) / len(y)
        sig, sig0 = 1 / (1 + np.exp(-zs)), 1 / (1 + np.exp(-bias))
        ds = slope[doc_s] * sig
        dw = np.bincount(at_w, ds[at_s], minlength=len(words)) + penalty * weights / len(y)
        db = float(ds.sum() + (slope * plain).sum() * sig0)
        gw, gb = gw + dw**2, gb + db**2
        weights = weights - rate * dw / np.sqrt(gw)
        bias = min(bias - rate * db / gb**0.5, -5.0)
    return Model(words, weights, float(bias))


def telling_words(sample: DataFrame, least_z: float = 3.0, least_docs: int = 3, most_words: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and log odds, of the words that stand in more documents of label 1 than chance gives.

    The frequencies are added up on the executors; the driver gets the most_words of the largest z.
    """

    def count(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for s in tv.slices(batch.column(0)):
                w = tv.words(s, tv.ALNUM)
                h, doc = tv.hashes(s, w), w.doc
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                kinds, back = np.unique(h[new], return_inverse=True)
                f1 = np.bincount(back, y[s.first + doc[new]], minlength=len(kinds)).astype(np.int64)
                f = np.bincount(back, minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(f1), pa.array(f - f1)], names=["w", "f1", "f0"])

    n = sample.agg(F.sum("y").alias("n1"), F.count("*").alias("n")).first()
    n1 = float(n.n1 or 0)
    n0 = n.n - n1
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    f = sample.select("text", "y").mapInArrow(_spark.tidy(count), "w long, f1 long, f0 long").groupBy("w").agg(F.sum("f1").alias("f1"), F.sum("f0").alias("f0"))
    share = (F.col("f1") + F.col("f0") + 1) / F.lit(n.n + 2.0)
    z = (F.col("f1") / n1 - F.col("f0") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    # a word of sentence-level offence is rare among the clean; common words differ with length only
    odds = F.log((F.col("f1") + 0.5) / (n1 + 1)) - F.log((F.col("f0") + 0.5) / (n0 + 1))
    strong = f.where(F.col("f1") + F.col("f0") >= least_docs).select("w", z.alias("z"), odds.alias("odds")).where(f"z > {least_z} and odds > 1.0")
    got = strong.orderBy(F.desc("z"), "w").limit(most_words).collect()
    words = np.array([r.w for r in got], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([r.odds for r in got], float)[order]


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, excluded: int = 0, train_rows: int = 16000) -> Model:
    """train_rows bounds what the driver gets: of each document, the places of its telling words."""
    sample = labelled_sample(docs, labels, "toxic", modulus, excluded, train_rows)
    words, weights = telling_words(sample)

    def run(s: tv.Slice) -> dict:
        h, sentence, doc, _ = sentences(s)
        at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        hit = np.flatnonzero(words[at] == h) if len(words) else np.zeros(0, np.int64)
        first = np.searchsorted(doc, np.arange(s.n + 1))
        of = np.searchsorted(sentence[hit], first)
        at, where = at[hit].astype(np.int32), sentence[hit].astype(np.int32)
        cut = lambda i: (at[of[i] : of[i + 1]], where[of[i] : of[i + 1]] - first[i].astype(np.int32))
        rows = [cut(i) for i in range(s.n)]
        return {"at": pa.array([a.tobytes() for a, _ in rows], pa.binary()), "s": pa.array([b.tobytes() for _, b in rows], pa.binary()), "n": np.diff(first)}

    made = _spark.map_text(sample, ["doc_id", "y"], "text", "at binary, s binary, n long", run).select("doc_id", "y", "at", "s", "n")
    got = sorted(made.collect(), key=lambda r: (r.doc_id, r.n, r.at, r.s))
    return fit(words, weights, [(np.frombuffer(r.at, np.int32), np.frombuffer(r.s, np.int32), r.n, r.y) for r in got])


def score_with(model: Model, docs: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    def run(s: tv.Slice) -> dict:
        score, worst, where = model.scores(s)
        return {"score": score, "worst_score": worst, "worst_start": where}

    return _spark.map_text(docs, ids, text, "score double, worst_score double, worst_start long", run)


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 5, excluded: int = 0, threshold: float = 0.5, train_rows: int = 16000) -> DataFrame:
    """doc_id, held_out, score, predicted; worst_start is the first code point of the worst sentence, -1 without one."""
    out = score_with(train(docs, labels, modulus, excluded, train_rows), docs, ["doc_id"])
    return out.select("doc_id", (_spark.crc_mod("doc_id", modulus) == excluded).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_score", "worst_start")


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    model = train(docs, labels, **settings)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = [model.scores(s)[0] for s in tv.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold)) if scores else batch

    return docs.mapInArrow(_spark.tidy(run), docs.schema)
