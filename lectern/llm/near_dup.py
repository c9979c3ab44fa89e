"""Near-duplicate groups by ProbMinHash, banding and exact verification.

A text is the weighted set of its shingles of ``k`` words (words stand between
ASCII white space, A-Z lower-cased; the weight is the shingle's count; a text
of fewer words is one shingle).  Two texts are linked when their probability
Jaccard similarity

    J_P(x, y) = sum_d 1 / sum_e max(x_e / x_d, y_e / y_d)

is ``threshold`` or more; for weights of 1 it is the Jaccard similarity.
Groups are the connected components of the links.

1. One pass makes, for each document, a fingerprint of its word sequence and
   its ProbMinHash signature: each shingle emits a Poisson process of arrivals
   with its weight as rate, each arrival falls on a random register, a register
   keeps its earliest one.  Processes stop as soon as they are later than all
   registers of the document.  Registers agree with probability J_P.
2. Texts equal word for word become one node; copies go no further.
3. ``bands`` bands of ``rows`` registers are hashed.  In each bucket all nodes are
   first paired with one leader, the node that meets the most others.  With 30
   bands of 5, a pair at 0.8 meets in no band with a probability of 7e-6.
4. Pairs are verified exactly from the texts, in blocks of one leader and at
   most about ``block`` members.
5. Two members of a bucket that are of different components now may still be linked
   to each other.  Such a bucket's members are dealt in a grid of blocks, each block
   meeting itself and every other in one task, which holds their shingles in postings:
   adding up a text's postings bounds its J_P with all others at once (exactly so for
   weights of 1), and only pairs above the threshold whose components the task hasn't
   joined yet are verified.  Only links that join two components leave the task, so no
   pair that isn't one becomes a row, and one pass is enough: every two texts that share a
   band are of one component, or verified, or excluded by the bound.

With X and Y the sums of two texts' weights, and C_x and C_y the parts of them on the shingles d
that both have, J_P <= sum_d 1 / ((X - C_x) / x_d + (Y - C_y) / y_d + max(C_x / x_d, C_y / y_d)).
A group of copies linked to one leader costs one comparison each; n texts of a bucket that are
alike but not linked meet n * n / 2 times, in numpy's sums, blocks by blocks.

A document without words (null, empty, white space) is a group of its own.
Repeated rows and exact copies share a group; ids that repeat with different
texts are told apart by text.  An empty table gives an empty result.
Fingerprints have 64 bits: two different texts share one with a probability of
2**-64 per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark
from . import textvec as tv
from .graph import components

K, BANDS, ROWS, THRESHOLD = 5, 30, 5, 0.8
#: Documents whose arrivals, some 1,200 each however short the text, are held at once.
SIGNED_AT_ONCE = 256
#: Members, and shingles, of a block of a bucket's grid, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1_000_000
_LOW48 = tv.U64((1 << 48) - 1)


def weighted_shingles(s: tv.Slice, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles, their counts and offsets by document; text fingerprints and word counts."""
    if s.n >= 1 << 16:
        raise ValueError("too many documents in a slice")
    w = tv.words(s, tv.NONSPACE)
    h = tv.hashes(s, w)
    sh, of = tv.shingles(h, w.of, k)
    doc = np.repeat(np.arange(s.n, dtype=np.uint64), np.diff(of))
    key = np.sort((doc << tv.U64(48)) | (sh >> tv.U64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    offs = np.searchsorted(key >> tv.U64(48), np.arange(s.n + 1, dtype=np.uint64))
    return key & _LOW48, count, offs, _fingerprints(h, w), w.counts


def _fingerprints(h: np.ndarray, w: tv.Words) -> np.ndarray:
    """Of each document's sequence of words."""
    if not len(h):
        return np.zeros(len(w.of) - 1, tv.U64)
    place = (np.arange(len(h)) - w.of[:-1][w.doc]).astype(np.uint64)
    c = np.concatenate([np.zeros(1, tv.U64), np.cumsum(tv.mix(h ^ (place * tv.U64(0x9E3779B97F4A7C15))), dtype=tv.U64)])
    return tv.mix((c[w.of[1:]] - c[w.of[:-1]]) ^ w.counts.astype(tv.U64))


def text_keys(s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and word counts of each document."""
    w = tv.words(s, tv.NONSPACE)
    return _fingerprints(tv.hashes(s, w), w).view(np.int64), w.counts


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, offs: np.ndarray, m: int) -> np.ndarray:
    """Signatures, one row of m 64-bit values for each document (0s for those without elements).

    Arrivals of an element depend on it alone, scaled by its weight, so documents agree on them.
    """
    n = len(offs) - 1
    sizes = np.diff(offs)
    best = np.full(n * m, np.inf)
    who = np.zeros(n * m, tv.U64)
    if not len(elements):
        return who.reshape(n, m)
    doc = np.repeat(np.arange(n), sizes)
    total = np.bincount(doc, weights, minlength=n)
    # time by which all registers are filled with a probability of about 0.95
    bound = np.where(sizes > 0, m / np.maximum(total, 1) * (np.log(m) + 3), 0.0)
    live, at, step = np.arange(len(elements)), np.zeros(len(elements)), np.zeros(len(elements), np.int64)
    parked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        while len(live):
            # as many arrivals at a time as are expected before the bound
            expect = (bound[doc[live]] - at) * weights[live] / 1.0
            size = np.clip(np.ceil(expect), 1, 4 * m).astype(np.int64)
            ends = np.cumsum(size)
            own = np.repeat(np.arange(len(live)), size)
            nth = np.arange(ends[-1]) - np.repeat(ends - size, size) + step[own]
            x = tv.mix(elements[live][own] * tv.U64(0xD6E8FEB86659FD93) + (nth.astype(np.uint64) + tv.U64(1)) * tv.U64(0xA24BAED4963EE407))
            gap = -np.log(((x & tv.U64((1 << 40) - 1)).astype(np.float64) + 0.5) * 2.0**-40) / weights[live][own]
            run = np.cumsum(gap)
            t = run - np.repeat(run[ends - size] - gap[ends - size], size) + at[own]
            d = doc[live][own]
            ok = t <= bound[d]
            slot = d[ok] * m + ((x[ok] >> tv.U64(40)) * tv.U64(m) >> tv.U64(24)).astype(np.int64)
            t_ok = t[ok]
            np.minimum.at(best, slot, t_ok)
            won = best[slot] == t_ok
            who[slot[won]] = elements[live[own[ok][won]]]
            last = t[ends - 1]
            going = last <= bound[doc[live]]
            parked.append((live[~going], at[~going], step[~going]))
            live, at, step = live[going], last[going], (step + size)[going]
            # early termination: nothing later than a document's latest register matters
            latest = best.reshape(n, m).max(axis=1)
            bound = np.minimum(bound, latest)
        open_docs = np.isinf(best.reshape(n, m).max(axis=1)) & (sizes > 0)
        if not open_docs.any():
            break
        # an element that had stopped takes up its process where it was before its last arrivals
        live, at, step = (np.concatenate([p[i] for p in parked]) for i in range(3))
        again = open_docs[doc[live]]
        parked = [(live[~again], at[~again], step[~again])]
        live, at, step = live[again], at[again], step[again]
        bound = np.where(open_docs, bound * 2, bound)
    return who.reshape(n, m)


def bands_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, different for each band's number."""
    out = np.tile(np.arange(bands, dtype=np.uint64) * tv.U64(0x9E3779B97F4A7C15), (len(signatures), 1))
    parts = signatures.reshape(len(signatures), bands, rows)
    for i in range(rows):
        out = tv.mix(out * tv.U64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return out


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, each of sorted distinct elements and their weights."""
    (ea, wa), (eb, wb) = a, b
    _, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_x, only_y = float(wa.sum() - x.sum()), float(wb.sum() - y.sum())
    if (x == 1).all() and (y == 1).all():
        return len(x) / (len(x) + only_x + only_y)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    upto = np.searchsorted(y / x, y / x, side="right")  # elements of no larger ratio take x's side
    cx, cy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float((1 / ((only_x + cx[upto]) / x + (only_y + cy[-1] - cy[upto]) / y)).sum())


def signatures(df: DataFrame, ids: list[str], text: str, k: int, bands: int, rows: int) -> DataFrame:
    """ids, node (fingerprint of the words, null without any), bands array<long>."""

    def run(s: tv.Slice) -> dict:
        el, count, offs, key, words = weighted_shingles(s, k)
        weight, parts = count.astype(float), []
        for i in range(0, s.n, SIGNED_AT_ONCE):
            own = offs[i : i + SIGNED_AT_ONCE + 1]
            some = slice(own[0], own[-1])
            parts.append(bands_of(prob_min_hash(el[some], weight[some], own - own[0], bands * rows), bands, rows))
        b = np.concatenate(parts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * bands), pa.array(b.reshape(-1).view(np.int64)))
        return {"node": pa.array(key.view(np.int64), mask=words == 0), "bands": lists}

    return _spark.map_text(df, ids, text, "node long, bands array<long>", run)


COMPARED = "a long, b long, linked boolean, size long"


def compared(pairs: DataFrame, texts: DataFrame, k: int, threshold: float, block: int = 256) -> DataFrame:
    """COMPARED of all pairs (a, b): whether they are linked, and b's number of shingles; texts: node, text, a row a node.

    A leader's text is sent once to each block of its members.
    """
    blocks = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int"))
    members = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    leaders = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = members.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    rows = rows.unionByName(leaders.join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "text"))

    def run(batches):
        leader, own = None, None
        for batch in batches:
            for s in tv.slices(batch.column(4)):
                el, count, offs, _, _ = weighted_shingles(s, k)
                part = batch.slice(s.first, s.n)
                a, p, role, b = (part.column(i).to_pylist() for i in range(4))
                out = []
                for i in range(s.n):
                    it = (el[offs[i] : offs[i + 1]], count[offs[i] : offs[i + 1]])
                    if role[i] == 0:
                        leader, own = (a[i], p[i]), it
                    elif (a[i], p[i]) == leader:
                        out.append((a[i], b[i], prob_jaccard(own, it) >= threshold, len(it[0])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "linked", "size"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return dealt.mapInArrow(_spark.tidy(run), COMPARED)


def _first_pairs(led: DataFrame) -> DataFrame:
    """(a, b): each bucket's leader and its members."""
    return led.where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _open_buckets(led: DataFrame, done: DataFrame, comp: DataFrame) -> DataFrame:
    """bucket, node, comp, size of the members (leader aside) of buckets of several components; one of the buckets of the same leader and members."""
    rows = led.where("a <> node")
    h = F.xxhash64("node")
    sets = rows.groupBy("bucket", "a").agg(F.count("*").alias("n"), F.bit_xor(h).alias("mixed"), F.sum(F.shiftright(h, 24)).alias("summed"))
    sets = sets.where("n > 1").groupBy("a", "n", "mixed", "summed").agg(F.min("bucket").alias("bucket")).select("bucket")
    rows = rows.join(sets, "bucket").withColumnRenamed("node", "b").join(done.select("a", "b", "size"), ["a", "b"]).select("bucket", F.col("b").alias("node"), "size")
    rows = rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("held")).where("lo <> hi")
    return rows.join(several.select("bucket", "n", "held"), "bucket")


def _grid(members: DataFrame, block_members: int, block_shingles: int) -> DataFrame:
    """bucket, i, j, own, node, comp: each member in the cells where its block meets itself and the others."""
    blocks = F.greatest(F.ceil(F.col("n") / block_members), F.ceil(F.col("held") / block_shingles)).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")


class Cell:
    """The texts of one block, or two, of a bucket: their shingles in postings, and which components are joined."""

    def __init__(self, nodes: list[int], comps: list[int], own: list[int], sets: list[tuple[np.ndarray, np.ndarray]]):
        self.nodes, self.sets, self.own = nodes, sets, np.array(own)
        kinds, self.comp = np.unique(np.array(comps, np.int64), return_inverse=True)
        self.above = list(range(len(kinds)))
        self.most = int(np.bincount(self.comp).argmax())  # the largest component: within it there is nothing to find
        self.of = np.concatenate([[0], np.cumsum([len(e) for e, _ in sets])])
        _, code = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True)
        self.code, self.weight = code, np.concatenate([w for _, w in sets]).astype(float)
        self.member = np.repeat(np.arange(len(sets)), np.diff(self.of))
        self.total = np.bincount(self.member, self.weight, len(sets))
        self.verified = 0

    def root(self, c: int) -> int:
        while self.above[c] != c:
            self.above[c] = self.above[self.above[c]]
            c = self.above[c]
        return c

    def bounds(self, x: int, postings: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Bounds of x's J_P with every text that has postings."""
        own = slice(self.of[x], self.of[x + 1])
        lo = start[self.code[own]]
        n = start[self.code[own] + 1] - lo
        at = postings[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        y, wy, wx = self.member[at], self.weight[at], np.repeat(self.weight[own], n)
        m = len(self.sets)
        cx, cy = np.bincount(y, wx, m), np.bincount(y, wy, m)
        beyond = (self.total[x] - cx)[y] / wx + (self.total - cy)[y] / wy
        return np.bincount(y, 1 / (beyond + np.maximum(cx[y] / wx, cy[y] / wy)), m)

    def probe(self, queries: np.ndarray, targets: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Links (node, node) between the queries and targets that join components."""
        postings = np.flatnonzero(targets[self.member])
        postings = postings[np.argsort(self.code[postings], kind="stable")]
        start = np.searchsorted(self.code[postings], np.arange(self.code.max() + 2))
        out = []
        for x in np.flatnonzero(queries).tolist():
            for y in np.flatnonzero(self.bounds(x, postings, start) >= threshold - 1e-9).tolist():
                a, b = self.root(int(self.comp[x])), self.root(int(self.comp[y]))
                if a != b:
                    self.verified += 1
                    if prob_jaccard(self.sets[x], self.sets[y]) >= threshold:
                        self.above[a] = b
                        out.append((self.nodes[x], self.nodes[y]))
        return out

    def links(self, threshold: float) -> list[tuple[int, int]]:
        small = self.comp != self.most
        first = self.own == self.own.min()
        if first.all():
            return self.probe(small, first, threshold)
        return self.probe(first & small, ~first, threshold) + self.probe(~first & small, first & ~small, threshold)


def _linked(grid: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b): links between the members of each cell that join components."""

    def run(batches):
        key, held = None, []

        def found():
            if len({c for _, c, _, _ in held}) > 1:
                nodes, comps, own, sets = zip(*held, strict=True)
                links = Cell(nodes, comps, own, sets).links(threshold)
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for s in tv.slices(batch.column(6)):
                el, count, offs, _, _ = weighted_shingles(s, k)
                bucket, i, j, own, node, comp = (batch.slice(s.first, s.n).column(c).to_pylist() for c in range(6))
                for n in range(s.n):
                    if (bucket[n], i[n], j[n]) != key:
                        yield from found()
                        key, held = (bucket[n], i[n], j[n]), []
                    one = slice(offs[n], offs[n + 1])
                    held.append((node[n], comp[n], own[n], (el[one].copy(), count[one].copy())))
        yield from found()

    cell = ["bucket", "i", "j"]
    rows = grid.join(texts, "node").select(*cell, "own", "node", "comp", "text")
    return rows.repartition(*cell).sortWithinPartitions(*cell, "node").mapInArrow(_spark.tidy(run), "a long, b long")


def _texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of wanted(node, id): of each node the text of one row of its id. Each row of base is met at most once."""
    ids = wanted.select(F.col("id").alias("asked")).distinct()
    rows = base.join(ids, base["id"].eqNullSafe(ids["asked"]), "left_semi")

    def run(batches):
        for batch in batches:
            for s in tv.slices(batch.column(1)):
                key, words = text_keys(s)
                part = batch.slice(s.first, s.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key, mask=words == 0)], names=["own_id", "text", "own"])

    keyed = rows.mapInArrow(_spark.tidy(run), f"own_id {rows.schema['id'].dataType.simpleString()}, text string, own long")
    met = keyed.join(wanted.select("node", "id"), (keyed["own"] == wanted["node"]) & keyed["own_id"].eqNullSafe(wanted["id"]))
    return met.select("node", "text").dropDuplicates(["node"])


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block_members: int = BLOCK_MEMBERS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """id, class_id (smallest id of the group), class_size, n_texts (different texts of it), node for every row of docs."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    sig = _spark.materialize(spark, signatures(base, ["id"], "text", k, bands, rows), "dup-signatures")
    # one row a text: its smallest id, and any row's bands as all are equal
    nodes = sig.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"))
    nodes = _spark.materialize(spark, nodes, "dup-nodes")
    entries = nodes.select("node", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = _spark.materialize(spark, shared, "dup-buckets")
    met = _spark.materialize(spark, entries.join(shared, "band").select(F.col("band").alias("bucket"), "node", "n"), "dup-met")
    degrees = _spark.materialize(spark, met.groupBy("node").agg(F.sum("n").alias("degree")), "dup-degrees")

    wanted = _spark.materialize(spark, degrees.join(nodes.select("node", "id"), "node"), "dup-wanted")
    found = _spark.materialize(spark, _texts(base, wanted), "dup-texts")

    leader = F.max_by("node", F.struct("degree", -F.col("node"))).alias("a")
    led = met.select("bucket", "node").join(met.join(degrees, "node").groupBy("bucket").agg(leader), "bucket")
    led = _spark.materialize(spark, led, "dup-led")
    done = _spark.materialize(spark, compared(_first_pairs(led), found, k, threshold), "dup-compared")
    comp = components(spark, done.where("linked").select("a", "b"))
    members = _spark.materialize(spark, _open_buckets(led, done, comp), "dup-open")
    links = _spark.materialize(spark, _linked(_grid(members, block_members, block_shingles), found, k, threshold), "dup-links")
    if links.limit(1).count():
        comp = components(spark, done.where("linked").select("a", "b").unionByName(links))
    _spark.release(nodes, shared, met, degrees, wanted, found, led, done, members, links)

    classed = sig.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = classed.where("comp is not null").groupBy("comp").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.count_distinct("node").alias("n_texts"))
    out = classed.join(classes, "comp", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "node")


def one_of_each(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, **settings) -> DataFrame:
    """docs, all columns whatever their names, with one row of each group, that of its smallest id (null last).

    Documents without words all stay.  Of several rows of that id and text, equal but for other
    columns, the first by those columns' hash stays.
    """
    from pyspark.sql import types as T

    found = near_duplicates(spark, docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id", "text", k, **settings).where("node is not null")
    keep = found.where(F.col("id").eqNullSafe(F.col("class_id"))).select("id", "node").distinct()
    names = docs.columns
    at = names.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            keys = [np.zeros(0, np.int64)]
            for s in tv.slices(batch.column(at)):
                key, words = text_keys(s)
                keys.append(np.where(words > 0, key, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys))], names=[*batch.schema.names, "node"])

    keyed = inner.mapInArrow(_spark.tidy(run), T.StructType([*inner.schema.fields, T.StructField("node", T.LongType())]))
    plain = [F.to_json(F.col(c)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(c) for c, f in zip(inner.columns, inner.schema.fields, strict=True)]
    told = lambda c: {"id_text": F.coalesce(F.col(c).cast("string"), F.lit("")), "id_null": F.col(c).isNull()}
    # documents without words are keys of their own; the join's partitioning serves the aggregate too
    key = F.when(F.col("node") == 0, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("node"))
    keyed = keyed.withColumns({"hash": F.xxhash64(*plain), "key": key, **told(f"c{names.index(id_col)}")})
    keep = keep.withColumns({"key": F.col("node"), "kept": F.lit(True), **told("id")}).drop("id", "node")
    on = ["key", "id_text", "id_null"]
    met = keyed.join(keep, on, "left").where("node = 0 or kept")
    one = met.groupBy(*on).agg(F.min_by(F.struct(*inner.columns), "hash").alias("one"))
    return one.select(*[F.col(f"one.{c}") for c in inner.columns]).toDF(*names)
