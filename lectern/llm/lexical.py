"""Ranked lexical search: the k documents of highest score for each item of a query table.

Terms are runs of letters and digits (every non-ASCII character counts as one), A-Z in lower case.  N documents hold a
term at all, with L terms in all; a document has n, and m = 25 + (75 n N) div L; a term stands in df documents and tf times in one.
A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document scores, over the item's terms with repeats,
the sum of w ((10^9 tf) div (1000 tf + 8 m)), in 64-bit integers.

Two passes over the texts and no exchange of either: one adds up N, L and the df of the items' terms, the other is the
search.  Each task cuts its documents into shards of about ``shard_bytes``, makes the postings of the items' terms
and runs MaxScore over them: the largest tf and smallest n of a posting list bound what its term can add; sorted by
that bound, the terms whose bounds together are below the k-th score so far are non-essential: a document that holds
only those can't enter.  Documents are taken in blocks of ids, from the essential lists; the others are probed, the
largest bound first, for those documents only that can still reach the k-th score.  The k best of each shard and item are ranked at the end.

Items go out in blocks of about ``block_terms`` terms, each with its two passes; their terms are all that is broadcast.
Rows of one item id are one item with the terms of its distinct texts.  An item without terms, or without a document that
scores above 0, has no rows.  A null text has no terms; a null id is an id, after all others in a tie, then
ties are equal rows.  Repeated rows are documents of their own.  Texts of any length count whole.
Empty tables give an empty result.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv

#: Rows that stand for N and L among the frequencies of terms.
DOCS, WORDS = -1, -2
#: Documents of the first block of a shard; each block doubles, as the k-th score soon stands.
FIRST_BLOCK = 256


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item, term, times."""

    def run(s: tv.Slice) -> dict:
        w = tv.words(s, tv.ALNUM)
        spelled = tv.spelled(s, w, tv.ALNUM).cast(pa.string())
        return {"terms": pa.ListArray.from_arrays(pa.array(w.of, pa.int32()), spelled)}

    own = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text")).distinct()
    terms = _spark.map_text(own, ["item"], "text", "terms array<string>", run).select("item", F.explode("terms").alias("term"))
    return terms.groupBy("item", "term").agg(F.count("*").alias("times"))


class Queries:
    """A block of items: its distinct terms, and for each item (place in items) the places and times of its terms."""

    def __init__(self, items: pa.Array, item: np.ndarray, terms: list[str], times: np.ndarray):
        coded = pa.array(terms, pa.large_string()).dictionary_encode()
        self.terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(item, kind="stable")
        self.items, self.code, self.times = items, code[order], times[order]
        self.of = np.searchsorted(item[order], np.arange(len(items) + 1))

    def found(self, s: tv.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each document; and the code, document and tf of each posting."""
        w = tv.words(s, tv.ALNUM)
        at = pc.index_in(tv.spelled(s, w, tv.ALNUM), value_set=self.terms)
        have = at.is_valid().to_numpy(zero_copy_only=False)
        code = at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        each, tf = np.unique(code * s.n + w.doc[have], return_counts=True)
        return w.counts, each // s.n, each % s.n, tf


class Shard:
    """Documents with the postings of the queries' terms, documents numbered in the order of their ids."""

    def __init__(self, ids: pa.Array, n: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]], terms: int):
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.ids, self.n = ids.take(pa.array(order)), n[order]
        code, doc, self.tf = (np.concatenate(x) for x in zip(*postings, strict=True))
        doc = place[doc]
        by = np.lexsort((doc, code))
        self.doc, self.tf = doc[by], self.tf[by]
        self.of = np.searchsorted(code[by], np.arange(terms + 1))
        self.most, self.least = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
        used = np.flatnonzero(np.diff(self.of))
        if len(used):
            self.most[used] = np.maximum.reduceat(self.tf, self.of[used])
            self.least[used] = np.minimum.reduceat(self.n[self.doc], self.of[used])


def length_norm(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    return 25 + (75 * n.astype(np.int64) * docs) // max(words, 1)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1)


def max_score(shard: Shard, norm: np.ndarray, code: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and documents of the k best of one item, best first, ties by document; and how many documents were scored."""
    order = np.argsort(bound, kind="stable")
    code, weight, bound = code[order], weight[order], bound[order]
    below = np.concatenate([[0], np.cumsum(bound)])  # what the terms before each can add together
    scores, docs, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    lo, size = 0, FIRST_BLOCK
    while lo < len(norm):
        hi = min(lo + size, len(norm))
        floor = int(scores[-1]) if len(scores) == k else 0
        cut = int(np.searchsorted(below, max(floor, 1), side="left")) - 1  # terms before it are not essential
        if cut >= len(code):
            break
        sums = np.zeros(hi - lo, np.int64)
        lists = []
        for c in code:
            a, b = shard.of[c], shard.of[c + 1]
            lists.append((a + np.searchsorted(shard.doc[a:b], lo), a + np.searchsorted(shard.doc[a:b], hi)))
        for t in range(cut, len(code)):
            a, b = lists[t]
            d = shard.doc[a:b]
            sums[d - lo] += weight[t] * gain(shard.tf[a:b], norm[d])
        at = np.flatnonzero(sums)
        scored += len(at)
        for t in range(cut - 1, -1, -1):
            at = at[sums[at] + below[t + 1] >= max(floor, 1)]
            a, b = lists[t]
            if a == b or not len(at):
                continue
            d = shard.doc[a:b]
            where = np.minimum(np.searchsorted(d, at + lo), len(d) - 1)
            hit = d[where] == at + lo
            own = where[hit] + a
            sums[at[hit]] += weight[t] * gain(shard.tf[own], norm[shard.doc[own]])
        at = at[sums[at] >= max(floor, 1)]
        if len(at):
            scores, docs = np.concatenate([scores, sums[at]]), np.concatenate([docs, at + lo])
            best = np.lexsort((docs, -scores))[:k]
            scores, docs = scores[best], docs[best]
        lo, size = hi, size * 2
    return scores, docs, scored


def _cut(batches, queries: Queries, shard_bytes: int):
    """Shards of whole texts."""
    ids, n, postings, held, docs = [], [], [], 0, 0
    for batch, s in _spark.text_slices(batches):
        counts, code, doc, tf = queries.found(s)
        ids.append(batch.column(0))
        n.append(counts)
        postings.append((code, doc + docs, tf))
        docs, held = docs + s.n, held + len(s.buf)
        if held >= shard_bytes:
            yield Shard(pa.concat_arrays(ids), np.concatenate(n), postings, len(queries.terms))
            ids, n, postings, held, docs = [], [], [], 0, 0
    if docs:
        yield Shard(pa.concat_arrays(ids), np.concatenate(n), postings, len(queries.terms))


def frequencies(docs: DataFrame, sent) -> tuple[int, int, np.ndarray]:
    """N, L, and df of each term of the broadcast queries."""

    def run(batches):
        q = sent.value
        df, total, words = np.zeros(len(q.terms), np.int64), 0, 0
        for _, s in _spark.text_slices(batches):
            counts, code, _, _ = q.found(s)
            df += np.bincount(code, minlength=len(df))
            total, words = total + int((counts > 0).sum()), words + int(counts.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([DOCS, WORDS, *used.tolist()], pa.int32()), pa.array([total, words, *df[used].tolist()], pa.int64())], names=["term", "n"])

    size = len(sent.value.terms)
    got = {r.term: r.n for r in docs.select("text").selectExpr("0 AS id", "text").mapInArrow(_spark.tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.get(DOCS, 0), got.get(WORDS, 0), np.array([got.get(i, 0) for i in range(size)], np.int64)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_bytes: int = 32 << 20, block_terms: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id, score."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    wanted = _spark.materialize(spark, item_terms(items, item_id, item_text), "search-items")
    kind, item_kind = docs.schema["id"].dataType.simpleString(), wanted.schema["item"].dataType.simpleString()
    blocks = max(1, -(-wanted.count() // block_terms))
    out = spark.createDataFrame([], f"item {item_kind}, id {kind}, score long")
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        item = rows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        queries = Queries(item.dictionary, item.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.column("term").to_pylist(), rows.column("times").to_numpy())
        sent = spark.sparkContext.broadcast(queries)
        total, words, df = frequencies(docs, sent)
        weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)

        def run(batches, sent=sent, weight=weight, total=total, words=words):
            q = sent.value
            for shard in _cut(batches, q, shard_bytes):
                norm = length_norm(shard.n, total, words)
                bound = weight * gain(shard.most, length_norm(shard.least, total, words))
                for i in range(len(q.items)):
                    code, times = q.code[q.of[i] : q.of[i + 1]], q.times[q.of[i] : q.of[i + 1]]
                    live = bound[code] > 0
                    code, times = code[live], times[live]
                    if not len(code):
                        continue
                    scores, found, _ = max_score(shard, norm, code, weight[code] * times, bound[code] * times, k)
                    yield pa.RecordBatch.from_arrays([q.items.take(pa.array([i] * len(scores), pa.int32())), shard.ids.take(pa.array(found)), pa.array(scores)], names=["item", "id", "score"])

        out = out.unionByName(docs.mapInArrow(_spark.tidy(run), f"item {item_kind}, id {kind}, score long"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_col), "score")


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n, coalesce(sum(len(terms)), 0)::BIGINT AS l FROM d),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n),
r AS (
  SELECT q.item_id, d.d, d.doc_id, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + ((75 * len(d.terms) * s.n) // s.l)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.d = p.d, s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM r WHERE score > 0)
WHERE rank <= 10
"""
