"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree (branching ``branch``, leaves of at most ``leaf`` sample vectors) is
fitted on the driver to at most ``sample`` unit vectors, those whose ids have
the smallest hashes; every vector is then put into a leaf of it.  Leaves of more
than ``most`` vectors get a tree of their own, fitted beside their vectors to at
most about ``sample`` of them, and so on until none is larger, so the number
of leaves grows with the table and their size doesn't.

A query walks a tree through a priority queue of nodes by the distance of their
centres, so it sees leaves best first, and widens its visits to as many leaves
as the calibration found to be needed: for ``probes`` queries the true neighbours
are found by a scan of all vectors, and the number of leaves, for each level of
trees, is the one by which ``recall`` of them are reached.  A query goes on while its
leaves hold fewer than k vectors besides its own, so it doesn't return fewer
than there are.  Leaves that themselves have trees are walked in the same way.

Of equal vectors, only as many rows of the smallest ids as one query can return
are searched: all others score the same and lose the tie, so a frequent vector
costs no more than another.  Queries of one leaf are dealt out in blocks of about
``block``, each with a copy of the leaf.  Each level of trees adds one exchange.

Scores are cosines in double precision of the original vectors, computed row by
row, so equal vectors score equally; ties go to the smaller id.  Vectors that
are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or candidates; nor do rows without an id.  An
id's own rows are never its candidates; of several vectors of a query's id the least, byte by byte, asks; repeated
candidate rows are candidates of their own.  Extra columns play no part, whatever
their names.  Without vectors the result is empty.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _spark


@dataclass
class Tree:
    """centres: of all nodes; children: rows of node numbers (empty for leaves); leaf: number or -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, going down to the nearest child."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            for v in np.unique(node[inner]):
                rows, kids = inner[node[inner] == v], self.children[v]
                c = self.centres[kids]
                node[rows] = kids[np.argmin((c**2).sum(1)[None, :] - 2 * (x[rows][:, None, :] * c[None, :, :]).sum(2), axis=1)]

    def leaves(self, q: np.ndarray):
        """Leaves best first."""
        heap = [(0.0, 0)]
        while heap:
            _, v = heapq.heappop(heap)
            if self.leaf[v] >= 0:
                yield int(self.leaf[v])
            else:
                kids = self.children[v]
                for d, kid in zip(((self.centres[kids] - q) ** 2).sum(1).tolist(), kids.tolist(), strict=True):
                    heapq.heappush(heap, (d, kid))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        for j in range(k):
            if (own == j).any():
                centres[j] = x[own == j].mean(0)
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def fit(x: np.ndarray, branch: int = 8, leaf: int = 64) -> Tree:
    rng = np.random.Generator(np.random.PCG64(3))
    centres, children, leaves, n = [x.mean(0)], [np.zeros(0, np.int64)], [-1], 0
    todo = [(0, np.unique(x, axis=0))]
    while todo:
        v, rows = todo.pop()
        own = _kmeans(rows, min(branch, len(rows)), rng) if len(rows) > leaf else np.zeros(len(rows), np.int64)
        parts = [rows[own == j] for j in range(own.max() + 1) if (own == j).any()]
        if len(parts) < 2:
            leaves[v], n = n, n + 1
            continue
        kids = []
        for p in parts:
            kids.append(len(centres))
            centres.append(p.mean(0))
            children.append(np.zeros(0, np.int64))
            leaves.append(-1)
            todo.append((kids[-1], p))
        children[v] = np.array(kids)
    return Tree(np.array(centres), children, np.array(leaves))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _best(q: np.ndarray, own: int, x: np.ndarray, unit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k best of a block for one query, by exact score, then id."""
    near = unit @ (q / np.sqrt((q * q).sum()))
    near[ids == own] = -np.inf
    n = int((ids != own).sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    least = np.partition(near, len(near) - min(k, n))[len(near) - min(k, n)]
    rows = np.flatnonzero(near >= least - 1e-9)
    score = (x[rows] * q).sum(1) / (np.sqrt((x[rows] * x[rows]).sum(1)) * np.sqrt((q * q).sum()))
    order = np.lexsort((ids[rows], -score))[:k]
    return rows[order], score[order]


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id, v (float64 bytes) of the vectors that take part, and their length."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("a"))
    sizes = rows.groupBy(F.size("a").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes.n if sizes else 0

    def run(batches):
        for batch in batches:
            flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["id", "v"])

    return rows.where(F.size("a") == dim).mapInArrow(run, "id long, v binary"), dim


#: A leaf's number is its parent's times FAN plus its place in the parent's tree plus 1; the root's is 0.
FAN = 1 << 12
ROWS = "leaf long, split long, role long, id long, v binary"


def _beside(rows: DataFrame, payload: DataFrame, block: int) -> DataFrame:
    """ROWS: rows(leaf, id, v) in blocks of about ``block`` of one leaf, each after the payload(leaf, id, v) of its leaf (role 0)."""
    splits = rows.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("splits"))
    own = rows.join(splits, "leaf").select("leaf", F.pmod(F.xxhash64("id", "v"), "splits").alias("split"), F.lit(1).cast("long").alias("role"), "id", "v")
    each = payload.join(splits, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).alias("split"), F.lit(0).cast("long").alias("role"), "id", "v")
    return each.unionByName(own).repartition("leaf", "split").sortWithinPartitions("leaf", "split", "role")


def _fitted(rows: DataFrame, dim: int, sample: int, settings: dict) -> DataFrame:
    """leaf, id (the number of leaves), v (the tree) of the leaves in rows(leaf, id, v, n), from a sample of each's vectors."""

    def run(batches):
        at, held = None, []

        def done():
            tree = fit(_unit(np.frombuffer(b"".join(held)).reshape(-1, dim)), **settings)
            if tree.n_leaves >= FAN:
                raise ValueError("a tree of too many leaves")
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([tree.n_leaves]), pa.array([pickle.dumps(tree)], pa.binary())], names=["leaf", "id", "v"])

        for batch in batches:
            for leaf, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if leaf != at:
                    if at is not None:
                        yield done()
                    at, held = leaf, []
                held.append(v)
        if at is not None:
            yield done()

    some = rows.where(F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / sample)) == 0).select("leaf", "v")
    return some.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(_spark.tidy(run), "leaf long, id long, v binary").where("id > 1")


def _walked(dealt: DataFrame, dim: int, step) -> DataFrame:
    """leaf, id, v of what step(tree, leaf, ids, vectors) yields for the rows after each tree, batch by batch."""

    def run(batches):
        at, tree = None, None
        for batch in batches:
            leaf, split, role = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (split[1:] != split[:-1]) | (role[1:] != role[:-1])])) if len(leaf) else []
            for a, b in zip(edges, [*edges[1:], len(leaf)], strict=True):
                if role[a] == 0:
                    at, tree = (leaf[a], split[a]), pickle.loads(batch.column(4)[int(a)].as_py())
                elif (leaf[a], split[a]) == at:
                    ids, v = batch.column(3).to_numpy()[a:b], batch.column(4).slice(a, b - a)
                    out = step(tree, int(leaf[a]), ids, v, _unit(_matrix(v, dim)))
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), out[2]], names=["leaf", "id", "v"])

    return dealt.mapInArrow(_spark.tidy(run), "leaf long, id long, v binary")


def _placed(tree: Tree, leaf: int, ids, v, unit):
    return leaf * FAN + 1 + tree.place(unit), ids, v


def _router(visits: int):
    def route(tree: Tree, leaf: int, ids, v, unit):
        """The first ``visits`` leaves of each query."""
        goal, who = [], []
        for i, q in enumerate(unit):
            for n, x in enumerate(tree.leaves(q)):
                if n >= visits:
                    break
                goal.append(leaf * FAN + 1 + x)
                who.append(i)
        return goal, ids[who] if who else [], v.take(pa.array(who, pa.int64()))

    return route


def _ranked(tree: Tree, leaf: int, ids, v, unit):
    """For ids that are a leaf's number, the rank that a query sees it at."""
    order = [{x: i for i, x in enumerate(tree.leaves(q))} for q in unit]
    return np.full(len(ids), leaf), [o[(int(i) - 1) % FAN] + 1 for o, i in zip(order, ids, strict=True)], v


def true_neighbours(placed: DataFrame, queries: DataFrame, dim: int, k: int, probes: int) -> list[tuple[bytes, int]]:
    """(query, leaf of one of its k nearest) of at most ``probes`` queries, by a scan of all vectors."""
    some = [(r.id, bytes(r.v)) for r in queries.orderBy(F.xxhash64("id"), "id").limit(probes).collect()]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, leaf = batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy()
            unit, out = _unit(x), []
            for qid, q in some:
                rows, score = _best(np.frombuffer(q), qid, x, unit, ids, k)
                out += [(qid, int(ids[r]), float(s), int(leaf[r])) for r, s in zip(rows, score, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=["q", "id", "score", "leaf"])

    found = placed.select("id", "v", "leaf").mapInArrow(_spark.tidy(run), "q long, id long, score double, leaf long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    by_id = dict(some)
    return [(by_id[r.q], r.leaf) for r in found.withColumn("nth", nth).where(F.col("nth") <= k).collect()]


def _ancestors(leaf: int) -> list[int]:
    """Numbers of a leaf's ancestors and its own, from the top tree's leaf on."""
    out = [leaf]
    while out[0] > FAN:
        out.insert(0, (out[0] - 1) // FAN)
    return out


def nearest(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.97, sample: int = 16384, probes: int = 128, most: int = 2048, block: int = 1024, branch: int = 8, leaf: int = 64) -> DataFrame:
    """query_id, rank, <id>, score: the k nearest found of each row whose id is divisible by ``every``, among all rows."""
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows, dim = usable(df, id_col, vec_col)
    rows = _spark.materialize(spark, rows, "ann-vectors")
    own_rows = rows.groupBy("id").count().agg(F.max("count")).first()[0] or 1
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    cand = _spark.materialize(spark, rows.withColumn("nth", nth).where(F.col("nth") <= k + own_rows).select("id", "v"), "ann-candidates")
    got = cand.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").collect()
    if not got:
        return spark.createDataFrame([], schema)
    settings = {"branch": branch, "leaf": leaf}
    top = fit(_unit(np.frombuffer(b"".join(bytes(r.v) for r in got)).reshape(-1, dim)), **settings)
    if top.n_leaves >= FAN:
        raise ValueError("a tree of too many leaves")
    sent = spark.sparkContext.broadcast(top)

    def place(batches):
        for batch in batches:
            at = sent.value.place(_unit(_matrix(batch.column(1), dim))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64) + 1)], names=["id", "v", "leaf"])

    placed = _spark.materialize(spark, cand.mapInArrow(_spark.tidy(place), "id long, v binary, leaf long"), "ann-leaves")
    # one number a leaf of the top tree: at most FAN
    sizes = {r.leaf - 1: r["count"] for r in placed.groupBy("leaf").count().collect()}
    levels: list[DataFrame] = []  # leaf, id, v: the trees of leaves that were too large
    while True:
        large = placed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > most)
        trees = _spark.materialize(spark, _fitted(placed.join(large, "leaf"), dim, sample, settings), "ann-trees")
        if not trees.limit(1).count():
            break
        levels.append(trees)
        again = placed.join(trees.select("leaf"), "leaf", "left_semi").select("leaf", "id", "v")
        finer = _walked(_beside(again, trees, 1 << 14), dim, _placed)
        new = _spark.materialize(spark, placed.join(trees.select("leaf"), "leaf", "left_anti").select("id", "v", "leaf").unionByName(finer), "ann-leaves")
        _spark.release(placed)
        placed = new

    queries = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    share = recall ** (1 / (1 + len(levels)))
    quantile = lambda ranks: int(np.quantile(ranks, share, method="higher")) if len(ranks) else 1
    true = [(q, _ancestors(x)) for q, x in true_neighbours(placed, queries, dim, k, probes)]
    seen = {q: {x: i + 1 for i, x in enumerate(top.leaves(_unit(np.frombuffer(q)[None, :])[0]))} for q in {q for q, _ in true}}
    visits = quantile([seen[q][path[0] - 1] for q, path in true])
    known = spark.sparkContext.broadcast(sizes)

    def start(batches):
        for batch in batches:
            size, v = known.value, batch.column(1)
            ids, goal, who = batch.column(0).to_pylist(), [], []
            for i, q in enumerate(_unit(_matrix(v, dim)) if batch.num_rows else []):
                have = n = 0
                for x in sent.value.leaves(q):
                    if x not in size:
                        continue
                    if n >= visits and have >= k + own_rows:
                        break
                    n, have = n + 1, have + size[x]
                    goal.append(x + 1)
                    who.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(goal, pa.int64()), pa.array([ids[i] for i in who], pa.int64()), v.take(pa.array(who, pa.int64()))], names=["leaf", "id", "v"])

    routed = queries.select("id", "v").mapInArrow(_spark.tidy(start), "leaf long, id long, v binary")
    for i, trees in enumerate(levels):
        asked = [(path[i], path[i + 1], q) for q, path in true if len(path) > i + 1]
        ranks = []
        if asked:
            some = spark.createDataFrame(asked, "leaf long, id long, v binary")
            ranks = [r.id for r in _walked(_beside(some, trees, block), dim, _ranked).select("id").collect()]
        deeper = routed.join(trees.select("leaf"), "leaf", "left_semi")
        deeper = _walked(_beside(deeper, trees, block), dim, _router(max(quantile(ranks), k + own_rows)))
        routed = _spark.materialize(spark, routed.join(trees.select("leaf"), "leaf", "left_anti").unionByName(deeper), "ann-routed")

    def search(batches):
        at, ids, vs, ready = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            vec, out = batch.column(4).to_pylist(), []
            for (number, split, role, i), v in zip(keys, vec, strict=True):
                if (number, split) != at:
                    at, ids, vs, ready = (number, split), [], [], None
                if role == 0:
                    ids.append(i)
                    vs.append(v)
                elif ids:
                    if ready is None:
                        x = np.frombuffer(b"".join(vs)).reshape(-1, dim)
                        ready = (x, _unit(x), np.array(ids))
                    x, unit, own = ready
                    found, score = _best(np.frombuffer(v), i, x, unit, own, k)
                    out += [(i, int(own[r]), float(s)) for r, s in zip(found, score, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "id", "score"])

    found = _beside(routed, placed.select("leaf", "id", "v"), block).mapInArrow(_spark.tidy(search), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
