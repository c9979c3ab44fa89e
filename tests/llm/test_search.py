"""Sharding, divergence, lexical search and the cells of near duplicates against brute force; repeated ids."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import ann, divergence, lexical, near_dup, sharding
from lectern.llm import textvec as tv
from lectern.llm.sample import labelled_sample

D = "/root/testdata/sf0.001"
ODD = [None, "", " \n", "😀 One two", "The the THE and and", "x" * 5000, "a b c d", "a b c d", "a1b2 the é É ñ", "0 1 2", "one " * 30000]
SCHEMA = "doc_id long, text string, lang string, source string, n string, term string, size string, shard string, at string, id string, item string"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(None if i % 4 == 3 else 10_000 + i, x, None if i % 3 else "en", None if i % 2 else "zz") for i, x in enumerate(ODD)]
    odd += [(10_006, "a b c d", "en", "zz")] * 5 + [(None, None, None, None)] * 3
    out = real.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    return out.withColumns({c: F.lit(c) for c in ("n", "term", "size", "shard", "at", "id", "item")}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


# sharding


def draw(key: str, k: int, weight: float = 1.0) -> float:
    h = xxhash.xxh64(struct.pack("<i", k), seed=xxhash.xxh64(key.encode(), seed=42).intdigest()).intdigest()
    return math.log(((h >> 11) + 0.5) / 2**53) / weight


def test_sharding_agrees_with_brute_force(spark, docs, rows):
    got = sharding.shard(spark, docs).collect()
    text = lambda r: (r.text or "").encode()
    want = Counter()
    for r in rows:
        d = [draw("" if r.doc_id is None else str(r.doc_id), k) for k in range(17)]
        own = max(range(16), key=lambda k: d[k])
        want[r.doc_id, len(text(r)) + 1, zlib.crc32(text(r)), "key", own, 16 if d[16] > d[own] else own] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in held.values())


def test_slots_of_many_blocks_and_many_copies(spark):
    ids = spark.range(3000).selectExpr("id AS doc_id", "cast(id AS string) AS text").unionByName(spark.range(1000).selectExpr("7L AS doc_id", "'same' AS text"))
    ids = ids.unionByName(spark.range(1000).selectExpr("cast(null AS bigint) AS doc_id", "cast(id AS string) AS text"))
    own = sharding.assign(sharding.digest(ids))
    small, large = (sharding.slots(spark, own, block_rows=b, span=s).collect() for b, s in ((20, 64), (10**6, 10**6)))
    assert sorted(small, key=str) == sorted(large, key=str) and len(small) == 5000
    assert len({(r.shard, r.slot) for r in small}) == 5000
    again = sharding.slots(spark, sharding.assign(sharding.digest(ids.repartition(7))), block_rows=20).collect()
    assert sorted(again, key=str) == sorted(small, key=str)


def test_weights_and_growth(spark):
    ids = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    weighed = sharding.assign(ids, weights=[1.0, 2.0, 5.0], shards=3, next_weight=2.0)
    share = {r.shard: r["count"] / 20_000 for r in weighed.groupBy("shard").count().collect()}
    assert all(abs(share[k] - w / 8) < 0.02 for k, w in enumerate((1, 2, 5)))
    moved = weighed.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 3").count() == 0 and abs(moved.count() / 20_000 - 0.2) < 0.02
    larger = sharding.assign(ids, weights=[1.0, 2.0, 5.0, 2.0], shards=4).select("doc_id", F.col("shard").alias("now"))
    assert weighed.join(larger, "doc_id").where("now <> grown_shard").count() == 0
    assert sharding.assign(ids.withColumn("doc_id", F.col("doc_id").cast("int"))).join(sharding.assign(ids).select("doc_id", F.col("shard").alias("s")), "doc_id").where("s <> shard").count() == 0
    with pytest.raises(ValueError):
        sharding.assign(ids, weights=[1.0, 0.0], shards=2)


def test_sharding_of_nothing_and_no_python(spark, docs):
    assert sharding.shard(spark, docs.limit(0)).collect() == []
    plan = sharding.assign(sharding.digest(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_written_shards_hold_all_columns(spark, docs, tmp_path):
    sharding.write(docs.drop("shard"), f"file://{tmp_path}/out", file_bytes=8_000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.drop("shard").exceptAll(docs.drop("shard").select(back.drop("shard").columns)).count() == 0 and back.count() == docs.count()
    assert back.exceptAll(sharding.assign(docs).drop("grown_shard").select(back.columns)).count() == 0
    assert len(list((tmp_path / "out" / "shard=3").glob("*.parquet"))) > 1


# divergence


def words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def diverge(rows, least, top):
    n, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        w = words(r.text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
        langs[lang].add(source)
        n[lang, source].update(w)
        df[lang].update(set(w))
    out = set()
    for lang, sources in langs.items():
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        v = len(kept)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        q = shares(sum((n[lang, s] for s in sources), Counter()))
        p = {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            far = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            near = sorted(((q[t] - p[s][t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, -f, i) for i, (f, o) in enumerate(far, 1)}
            out |= {(lang, s, "term", t, -f, i) for i, (f, t) in enumerate(near[:top], 1)}
    return out


@pytest.mark.parametrize(("least", "top", "tile"), [(2, 7, 3), (30, 50, 256), (10**6, 5, 2)])
def test_divergence_agrees_with_brute_force(spark, docs, rows, least, top, tile):
    got = divergence.divergence(spark, docs, least_docs=least, top=top, tile=tile).collect()
    assert {tuple(r) for r in got} == diverge(rows, least, top) and len(got) == len({tuple(r) for r in got})


def test_divergence_in_parts(spark, docs, rows):
    kept = divergence.kept_terms(spark, docs.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text"), 2)
    groups = divergence.group_table(spark, docs.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source"), kept)
    one, many = (sorted(map(tuple, divergence.pairs(kept, groups, t, r).collect())) for t, r in ((256, 10**9), (4, 500)))
    assert one == many and len(one) > 100


def test_only_promising_terms_are_evaluated(spark):
    """One source has 40 terms of its own among 4,000 that all use alike."""
    rng = random.Random(5)
    common = [f"w{''.join(rng.choices('abcdefghij', k=6))}" for _ in range(4000)]
    own = [f"only{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    made = [(i, " ".join(rng.sample(common, 1500) + (own * 4 if i % 2 else [])), "en", "ab"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    kept = divergence.kept_terms(spark, d, 5)
    best = divergence.leading_terms(spark, kept, divergence.group_table(spark, d, kept), top=10)
    assert {r.item for r in best.where("source = 'b'").collect()} <= set(own)
    assert best.evaluated < kept.count() / 2


def test_divergence_of_nothing(spark, docs):
    assert divergence.divergence(spark, docs.limit(0)).collect() == []


# lexical search


def ranked(rows, items, k=10):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    docs = [(r.doc_id, Counter(words(r.text, pattern))) for r in rows]
    n = sum(1 for _, c in docs if c)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = defaultdict(list)
    for item, text in items:
        scored = []
        for doc, c in docs:
            m = 25 + 75 * sum(c.values()) * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text, pattern) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out[item] = [(None if none else d, -s) for s, none, d in sorted(scored)[:k]]
    return {i: x for i, x in out.items() if x}


def by_item(got):
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


@pytest.mark.parametrize(("shard_bytes", "block_terms"), [(32 << 20, 200_000), (20_000, 200)])
def test_search_agrees_with_brute_force(spark, docs, rows, shard_bytes, block_terms):
    real = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    items = [*real, (900, "a b c d THE the the"), (901, None), (902, "zzzzunknown"), (None, "one é 0"), (900, "a b c d THE the the")]
    made = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("x"), "item": F.lit(1)})
    got = lexical.search(spark, docs, made, shard_bytes=shard_bytes, block_terms=block_terms).collect()
    assert by_item(got) == ranked(rows, items)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(spark, docs.limit(0), items).collect() == []
    assert lexical.search(spark, docs, items.limit(0)).collect() == []


def test_max_score_skips_and_keeps_ties():
    rng = np.random.default_rng(3)
    n_docs, terms = 6000, 12
    spread = np.linspace(0.9, 0.002, terms)
    rows = [(c, np.flatnonzero(rng.random(n_docs) < spread[c])) for c in range(terms)]
    code = np.concatenate([np.full(len(d), c) for c, d in rows])
    doc = np.concatenate([d for _, d in rows])
    tf = rng.integers(1, 4, len(doc))
    n = rng.integers(50, 60, n_docs)
    shard = lexical.Shard(pa.array(rng.permutation(n_docs)), n, [(code, doc, tf)], terms)
    norm = lexical.length_norm(shard.n, n_docs, int(n.sum()))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * np.array([len(d) for _, d in rows]) + 1))).astype(np.int64)
    bound = weight * lexical.gain(shard.most, lexical.length_norm(shard.least, n_docs, int(n.sum())))
    for pick in (np.arange(terms), np.array([0, 1]), np.array([11, 0, 5]), np.array([3])):
        dense = np.zeros(n_docs, np.int64)
        for c in pick:
            a, b = shard.of[c], shard.of[c + 1]
            dense[shard.doc[a:b]] += weight[c] * lexical.gain(shard.tf[a:b], norm[shard.doc[a:b]])
        want = np.lexsort((np.arange(n_docs), -dense))[:10]
        scores, docs, scored = lexical.max_score(shard, norm, pick, weight[pick], bound[pick], 10)
        assert docs.tolist() == want.tolist() and scores.tolist() == dense[want].tolist()
        if len(pick) == terms:
            assert scored < 0.7 * np.count_nonzero(dense)


def test_spelled_words_are_exact():
    s = next(tv.of_texts(["Ab c9\x00É.x", "", "Zz"]))
    w = tv.words(s, tv.ALNUM)
    assert tv.spelled(s, w, tv.ALNUM).to_pylist() == ["ab", "c9", "É", "x", "zz"] and w.doc.tolist() == [0, 0, 0, 0, 2]


# near duplicates: cells of a bucket's grid, texts by fingerprint


def sets_of(texts):
    return [near_dup.weighted_shingles(next(tv.of_texts([t])))[:2] for t in texts]


def passage_texts(n, seed):
    """Short texts around one passage, none linked to another."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    own = lambda k: [f"q{rng.randrange(10**9)}" for _ in range(k)]
    return [" ".join(own(8) + passage + own(8)) for _ in range(n)]


def test_a_cell_verifies_what_its_bounds_leave():
    texts = passage_texts(720, 1)
    linked = texts + [x + " and one more" for x in texts[:20]]
    cell = near_dup.Cell(list(range(740)), list(range(740)), [0] * 740, sets_of(linked))
    links = cell.links(0.8)
    assert sorted(tuple(sorted(x)) for x in links) == [(i, 720 + i) for i in range(20)] and cell.verified <= 40
    same = near_dup.Cell(list(range(740)), [0] * 740, [0] * 740, sets_of(linked))
    assert same.links(0.8) == [] and same.verified == 0


def test_bounds_hold_and_are_exact_for_counts_of_one():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(6, 60))) for _ in range(60)] + passage_texts(20, 3)
    sets = sets_of(texts)
    cell = near_dup.Cell(list(range(80)), list(range(80)), [0] * 80, sets)
    postings = np.argsort(cell.code, kind="stable")
    start = np.searchsorted(cell.code[postings], np.arange(cell.code.max() + 2))
    for x in range(80):
        bounds = cell.bounds(x, postings, start)
        for y in range(80):
            true = near_dup.prob_jaccard(sets[x], sets[y])
            assert bounds[y] >= true - 1e-9
            if sets[x][1].max() == sets[y][1].max() == 1:
                assert bounds[y] == pytest.approx(true)


@pytest.mark.parametrize(("members", "shingles"), [(5, 10**6), (10**6, 400)])
def test_grids_of_small_blocks_lose_no_link(spark, members, shingles):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        t = list(base) if not i else list(texts[rng.randrange(max(0, i - 6), i)])
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(60)] = f"v{rng.randrange(10**6)}"
        texts.append(t)
    texts = [" ".join(t) for t in texts] + passage_texts(60, 9)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = sets_of(texts)
    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and near_dup.prob_jaccard(sets[i], sets[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dup.near_duplicates(spark, df, block_members=members, block_shingles=shingles).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == [find(i) for i in range(len(texts))]


def test_texts_of_null_ids_are_found_by_fingerprint(spark):
    texts = passage_texts(200, 4)
    rows = [(None, t + end) for t in texts for end in ("", " and one more")] + [(7, texts[0])] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(spark, df).collect()
    assert Counter((r.class_size, r.n_texts) for r in got) == {(2, 2): 398, (52, 2): 52}
    wanted = near_dup.signatures(df, ["doc_id"], "text", 5, 2, 2).groupBy("node").agg(F.min("doc_id").alias("id"))
    found = near_dup._texts(df.withColumnRenamed("doc_id", "id"), wanted)
    assert found.count() == 400 and found.select("text").distinct().count() == 400


# samples and queries of repeated ids


def test_one_row_of_each_id_is_sampled(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, f"text {i} {j}") for i in range(40) for j in range(1 + 500 * (i == 3))] + [(5, None)], "doc_id long, text string")
    got = labelled_sample(docs, labels, "quality", 4, 2, 1000).collect()
    again = labelled_sample(docs.repartition(7), labels, "quality", 4, 2, 1000).collect()
    assert len(got) == len({r.doc_id for r in got}) and sorted(map(str, got)) == sorted(map(str, again))
    assert all(r.y == r.doc_id % 2 for r in got)


def test_nearest_of_repeated_ids_is_the_same_in_any_order(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 60, rng.normal(size=6).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, other = (sorted(map(tuple, ann.nearest(spark, x, every=10).collect())) for x in (df, df.orderBy(F.rand(3)).repartition(9)))
    assert one == other and len(one) == 30


def test_a_top_tree_of_too_many_leaves_is_refused(spark, monkeypatch):
    monkeypatch.setattr(ann, "FAN", 2)
    df = spark.range(300).selectExpr("id AS vec_id", "array(cos(id), sin(id)) AS embedding")
    with pytest.raises(ValueError, match="too many leaves"):
        ann.nearest(spark, df)
