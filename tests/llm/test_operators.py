"""The operators against brute force on small texts, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import ann, decontaminate, language_model, licenses, mixing, near_dup, pii, quality, token_counts, toxicity
from lectern.llm import textvec as tv

D = "/root/testdata/sf0.001"
ODD = [None, "", " \n", "😀 one two", "The the THE and and", "x" * 5000, "a b c d", "a b c d", "Licensed under the Apache License, Version 2.0. <|endoftext|> é",
       "mail a@b.c_d@e.f or +1 (555) 555-0100, 4111 1111 1111 1111, 10.0.0.1, 256.1.1.1", "call (555) 123-4567, ssn 123-45-6789", "This work is under the MIT License", "CC BY-NC"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, size string, id string"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(10_000 + i, x, "en", None if i % 2 else "zz", len(x or "")) for i, x in enumerate(ODD)] + [(10_000, None, "en", "zz", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = real.unionByName(odd).withColumns({"score": F.lit(0.5), "node": F.lit(1), "size": F.lit("s"), "id": F.lit("i")})
    return out.cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_word_hashes():
    texts = ["Ab c", None, "é\tab", ""]
    s = next(tv.of_texts(texts))
    w = tv.words(s, tv.NONSPACE)
    assert tv.hashes(s, w).tolist() == [int(tv.hash_of(x)) for x in ("ab", "c", "é", "ab")]
    assert w.of.tolist() == [0, 2, 2, 4, 4]


def test_pii(spark, docs, rows):
    def base(text):
        text, out = text or "", {}
        luhn = lambda d: 13 <= len(d) <= 19 and sum(d[::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0
        out["email"] = [m.span() for m in re.finditer(pii.EMAIL, text)]
        out["ip"] = [m.span() for m in re.finditer(pii.IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in re.finditer(pii.CARD, text) if luhn([int(c) for c in m[0] if c.isdigit()][::-1])]
        out["phone"] = [m.span() for m in re.finditer(pii.PHONE, text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return out

    want = Counter()
    for r in rows:
        b = base(r.text)
        listed = ",".join(f"{k}:{i}:{j}" for k in b for i, j in b[k])
        want[(r.doc_id, *(len(b[k]) for k in b), hashlib.sha256(listed.encode()).hexdigest())] += 1
    got = pii.find(docs).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert "id_number" in next(r.spans for r in got if r.doc_id == 10_010)
    clean = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert clean[10_009].text == "mail [EMAIL][EMAIL] or [PHONE], [CARD], [IP], 256.1.1.1" and clean[10_000].text is None and clean[10_009].id == "i"
    assert pii.find(empty(spark)).count() == 0


def test_pii_many_matches(spark):
    """More matches than fit a block, with texts between that are not ASCII."""
    n = 5 * pii.BLOCK + 1
    text = "é ".join(f"x{i}@ab.com 10.0.0.{i % 300} " for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find(df).first()
    emails = [f"email:{m.start()}:{m.end()}" for m in re.finditer(pii.EMAIL, text)]
    ips = [f"ip:{m.start()}:{m.end()}" for m in re.finditer(pii.IP, text) if int(m[0].split(".")[3]) <= 255]
    assert (got.n_email, got.n_ip, got.spans) == (n, len(ips), ",".join(emails + ips))
    want = re.sub(pii.IP, lambda m: "[IP]" if int(m[0].split(".")[3]) <= 255 else m[0], re.sub(pii.EMAIL, "[EMAIL]", text))
    assert pii.redacted(df).first().text == want


def test_pii_overlaps_across_blocks(spark):
    """One span first, then overlapping pairs: each block's end parts a pair."""
    n = 2 * pii.BLOCK
    text = "a@b.com" + " x +1.2.3.4 567890123" * n
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii.find(df).first()
    assert (got.n_email, got.n_ip, got.n_phone) == (1, n, n)
    assert pii.redacted(df).first().text == "[EMAIL]" + " x [PHONE]" * n


def test_tree_sql_agrees_with_trees(spark):
    x, _ = pii.examples(50, 5)
    trees, _ = pii.model()
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<double>").select("i", F.expr(" + ".join(pii.tree_sql(t, "f") for t in trees)).alias("z"))
    got = np.array([r.z for r in df.orderBy("i").collect()])
    assert np.allclose(got, sum(pii._value(t, x) for t in trees))
    assert all(precision >= 0.95 and recall >= 0.8 for precision, recall in pii.accuracy().values())


def test_pii_very_long_matches(spark):
    """Runs that a recursive or quadratic pattern doesn't survive; brute force in Python, one scan a kind."""
    texts = ["7" * 1_000_000, " ".join(str(10 + i % 90) for i in range(200_000)), "x@" + ".".join(["ab"] * 20_000), ".".join(["12"] * 20_000), "+" + "(1) " * 50_000 + "2", "a" * 500_000 + "@b", "4111 1111 1111 1111 " * 1000, "1.2.3.4.300.1.1.1" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    for i, x in enumerate(texts):
        ip = [m.span() for m in re.finditer("(?<![0-9])" + pii.IP, x) if all(int(p) <= 255 for p in m[0].split("."))]
        email = [m.span() for m in re.finditer("(?<![A-Za-z0-9._%+-])" + pii.EMAIL, x)]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == (len(email), len(ip), 0, 0), i
    assert clean[0] == texts[0] and clean[2] == "[EMAIL]" and clean[5] == texts[5]


def brute_language_model(rows):
    """(id, held out, tokens, known, N, base score, score) of each row; a filter without false positives."""
    tok = lambda x: [*words(x), "\0"]
    c, pair = Counter(), Counter()
    for i, text in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            t = tok(text)
            c.update(t)
            pair.update(zip(["\0", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    lo = lambda x: max([s for s in language_model.STEPS.tolist() if s <= x], default=0)
    hi = lambda x: min(s for s in language_model.STEPS.tolist() if s > x) - 1
    seen = 1 - sum(x == 1 for x in pair.values()) / max(1, n)
    out = []
    for i, text in rows:
        t, score = tok(text), 0.0
        for u, w in zip(["\0", *t], t, strict=False):
            a = seen if c[u] else 0.0
            score += math.log10(a * lo(pair[u, w]) / max(1, hi(c[u])) + (1 - a) * (lo(c[w]) + 1) / max(1, n + v + 1))
        base = sum(math.log10((c[w] + 1) / max(1, n + v + 1)) for w in t)
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n, round(base, 4), round(score, 4)))
    return Counter(out)


def scored(df, **settings):
    got = language_model.language_model_scores(df.sparkSession, df, **settings).collect()
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in got)


SURE = {"bits_per_key": 80, "probes": 8}


def test_language_model(spark, docs, rows):
    want = brute_language_model([(r.doc_id, r.text) for r in rows])
    assert scored(docs, **SURE) == want
    assert scored(docs, **SURE, table_size=50, part_bytes=1 << 16) == want
    plain = language_model.language_model_scores(spark, docs).collect()
    held = [r for r in plain if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.language_model_scores(spark, empty(spark)).count() == 0


def test_language_model_in_passes(spark, docs, rows):
    """Filters far larger than what may be broadcast: the same scores, nothing left out."""
    merged = language_model.train(spark, docs, "text", 8, 80, 8)
    assert len(language_model.groups_of(merged, 1 << 19)) > 2
    assert scored(docs, **SURE, max_filter_bytes=1 << 19, table_size=0) == brute_language_model([(r.doc_id, r.text) for r in rows])


def test_language_model_repeated_and_null_ids(spark):
    rows = [(1, "foo"), (1, "bar"), (None, "foo baz"), (None, "bar bar"), (5, None), (5, ""), (7, "x " * 30_000), (1, "foo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("i"), "row": F.lit(1), "levels": F.lit("l"), "base": F.lit(0)})
    for size in (0, 2, 1 << 20):
        assert scored(df, **SURE, table_size=size) == brute_language_model(rows)
    only = spark.createDataFrame([(3, "a b")], "doc_id long, text string")
    assert zlib.crc32(b"3") % 7 == 2 or scored(only) == brute_language_model([(3, "a b")])


def test_language_model_without_training_texts(spark):
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")
    assert all((r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0, 0) for r in language_model.language_model_scores(spark, df).collect())


def test_probabilities_sum_to_one_at_most():
    counts = Counter({"a": 7, "b": 3, "c": 1, "d": 1})
    n, v = sum(counts.values()), len(counts)
    level = lambda x: language_model.level_of(np.array(x))
    for after in ([2, 3, 1, 1], [0, 1, 0, 0], [0, 0, 0, 0]):
        for weight in (0.0, 0.4, 1.0):
            m = language_model.Scorer(n, v, weight)
            before = level([sum(after)] * (v + 1))
            p = m.probability(before, level([*counts.values(), 0]), level([*after, 0]))
            assert 0 < p.sum() <= 1 + 1e-12


def test_bloom_levels():
    keys, counts = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(1, 2001)
    bloom = language_model.Filter.gathered([(0, language_model.segment(keys, counts, 10, 4))], 1, 4)
    level = bloom.levels(keys)
    assert (level >= language_model.level_of(counts)).all() and (level == language_model.level_of(counts)).mean() > 0.9
    assert (bloom.levels(keys + np.uint64(1)) > 0).mean() < 0.1
    assert not language_model.Filter.gathered([], 3, 4).levels(keys).any()


def test_quality_and_toxicity(spark, docs, labels):
    for out, mod, cut in ((quality.quality_scores(spark, docs, labels), (4, 2), 0.7), (toxicity.toxicity_scores(spark, docs, labels), (5, 0), 0.5)):
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod[0] == mod[1]) for r in got)
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity_scores(spark, docs, none).collect()} == {0.0}
    assert quality.quality_scores(spark, empty(spark), none).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(spark, name):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality.quality_scores(spark, docs, labels) if name == "quality" else toxicity.toxicity_scores(spark, docs, labels)
    row = out.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(name)).cast("double"))).first()
    assert row[0] > 0.97


def test_sum_of_squares_identity():
    s = next(tv.of_texts(["a b b c", "d"]))
    bucket, value, ptr, stats = quality.features(s, 6)
    m = quality.fit([(bucket[:3], value[:3], stats[0], 1), (bucket[3:], value[3:], stats[1], 0)], 6, rank=3, epochs=3)
    x = np.zeros((2, 64 + quality.N_STATS))
    for i in range(2):
        x[i, bucket[ptr[i] : ptr[i + 1]]] = value[ptr[i] : ptr[i + 1]]
    x[:, 64:] = m.scaled(stats)
    z = m.bias + x @ m.w + np.array([sum(m.v[i] @ m.v[j] * r[i] * r[j] for i in range(len(r)) for j in range(i)) for r in x])
    assert np.allclose(z, m.logits(bucket, value, ptr, m.scaled(stats))[0], atol=1e-4)


def test_decontamination(spark, docs, rows):
    bench = spark.read.parquet(f"{D}/benchmark.parquet").unionByName(spark.createDataFrame([(901, None), (902, ""), (903, "a b c d")], "item_id long, text string"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    alnum = lambda x: re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    want = set()
    for item, text in items:
        w = alnum(text)
        k = min(5, len(w))
        need = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else None
        for r in rows if need else []:
            h = alnum(r.text)
            for at in range(max(1, len(h) - len(w) + 1)):
                part = h[at : at + len(w)]
                have = Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))
                if sum((need & have).values()) >= 0.8 * sum((need | have).values()):
                    want.add((r.doc_id, item))
                    break
    got = decontaminate.contaminated(spark, docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= 3
    assert {r.doc_id for r in decontaminate.clean(spark, docs, bench).collect()} == {r.doc_id for r in rows} - {x for x, _ in want}
    assert decontaminate.contaminated(spark, empty(spark), bench).count() == decontaminate.contaminated(spark, docs, bench.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    g = decontaminate.ItemsOfLength(10, 5)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    g.ids, g.prints, g.counts = list(range(50)), list(base), [Counter({7: g.size}) for _ in base]  # one shingle, so that all could meet
    g.seal(20)
    probes = base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (18, 50), dtype=np.uint64), axis=0)
    brute = {(i, j) for i in range(50) for j in range(50) if int(probes[i] ^ base[j]).bit_count() <= 20}
    assert {tuple(x) for x in g.within(probes, np.arange(50), np.full(50, 7, np.uint64), 20).tolist()} == brute


def test_candidates_stay_few_as_items_grow():
    """A window is compared with items that it shares rare wording with, however many there are."""
    rng = random.Random(5)
    made = [0]

    def compared(n):
        items = [(str(i), " ".join(["how", "many", "of", "the", "following", *(f"w{rng.randrange(5000)}" for _ in range(35))])) for i in range(n)]
        m = decontaminate.Matcher(items)
        (g,) = m.groups
        inner, made[0] = decontaminate.similarity, 0
        text = " ".join(x for _, x in items[:20])
        try:
            decontaminate.similarity = lambda a, b: made.__setitem__(0, made[0] + 1) or inner(a, b)
            found = m.matches(next(tv.of_texts([text])))
        finally:
            decontaminate.similarity = inner
        assert {x[1] for x in found} == {str(i) for i in range(20)}
        return made[0]

    assert compared(2000) <= compared(100) + 20


def test_decontamination_ties_types_and_long_items(spark):
    long = " ".join(f"w{i}" for i in range(6000))
    bench = spark.createDataFrame([("a", "p q r s t u v"), ("b", "p q r s t u v"), ("c", long), ("d", None), (None, "x1 x2 x3 x4 x5 x6")], "item_id string, text string")
    rows = [(1, "P q r. s t u v -- p q r s t u v"), (2, "z " * 50 + long + " z" * 50), (3, None), (None, "x1 x2 x3 x4 x5 x6"), (5, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit(1), "item_id": F.lit("x"), "similarity": F.lit(0)})
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in decontaminate.contaminated(spark, df, bench).collect()}
    assert got == {(1, "a"): (1.0, 0, 7), (1, "b"): (1.0, 0, 7), (2, "c"): (1.0, 50, 6000), (None, None): (1.0, 0, 6)}
    kept = decontaminate.clean(spark, df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 5}
    for kind in ("int", "decimal(10,2)", "date"):
        one = spark.createDataFrame([("p q r s t u v",)], "text string").withColumn("item_id", F.lit("2020-01-01" if kind == "date" else "7").cast(kind))
        (r,) = decontaminate.contaminated(spark, df, one).collect()
        assert r.item_id == one.first().item_id


def test_licenses(spark, docs, rows):
    got = licenses.license_scan(docs).collect()
    want = Counter()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        want[r.doc_id, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


def hashed(text):
    return np.array([int(tv.hash_of(w)) for w in text.split()], np.uint64)


def test_template_automata():
    m = licenses.compile_template("x", "[[the]] alpha beta gamma [[opt one]] <<who:1-3>> end")
    assert m.match(hashed("alpha beta gamma bob end"), 0) == (0, 5)
    assert m.match(hashed("alpha beta gamma opt one bob lee end"), 0) == (0, 8)
    assert m.match(hashed("alpha beta gamma end"), 0) is None and m.match(hashed("alpha beta delta bob end"), 0) is None
    assert m.match(hashed("alpha beta gamma a b c d end"), 0) is None
    needs = licenses.compile_template("x", "by <<who:1-2>> [[of here]] alpha beta")
    assert len(needs.anchor) == 1
    before = licenses.compile_template("x", "[[a b]] <<who:1-2>> alpha beta")
    assert before.match(hashed("alpha beta"), 0) is None
    assert before.match(hashed("z alpha beta"), 1) == (0, 3)
    with pytest.raises(ValueError):
        licenses.compile_template("x", "[[only optional]]")


def test_license_labels_by_expansion(spark):
    """Every template against texts written out from it, with the least and the most of its regions."""
    rows, want = [], {}
    for label, texts in licenses.TEMPLATES.items():
        for template in texts:
            for full in (False, True):
                t = template
                while "[[" in t:
                    t = re.sub(r"\[\[([^\[\]]*)\]\]", r"\1" if full else " ", t)
                t = re.sub(r"<<\w+:(\d+)-(\d+)>>", lambda m: " ".join(["zork"] * int(m[2 if full else 1])), t)
                want[len(rows)] = label
                rows.append((len(rows), " ... ".join(["Before", t.upper(), "after"])))
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases={}).collect()}
    assert all(label in got[i] for i, label in want.items())
    notice = "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
    ask = spark.createDataFrame([(1, notice), (2, "Zork " + notice), (3, "All rights reserved."), (4, "Permission is hereby granted")], "doc_id long, text string").withColumn("labels", F.lit(1))
    got = {r.doc_id: (r.labels, r.spans) for r in licenses.license_scan(ask).collect()}
    assert got[1] == ("", "") and got[2] == ("gpl", f"gpl:0:{len(notice.split()) + 1}") and got[3] == ("all-rights-reserved", "all-rights-reserved:0:3") and got[4] == ("", "")
    assert licenses.license_scan(empty(spark)).count() == 0


def test_token_counts(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.token_counts(spark, docs, path, table_size=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(spark, empty(spark), path).count() == 0


def test_mixing(spark, docs, rows):
    got = mixing.mix(spark, docs, block=4).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r.doc_id, len(words(r.text))) for r in rows)
    by = Counter()
    for r in rows:
        by[r.source] += len(words(r.text))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(by.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate > 2 * by[s]}
        for s in full or open_:
            target[s] = 2.0 * by[s] if full else weight[s] * rate
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == by[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= max(20, 0.02 * target[s]) for s in order if s != "zz" and s is not None)
    again = mixing.mix(spark, docs.repartition(3), block=4).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(spark, empty(spark)).count() == 0


def test_near_duplicates(spark, docs, rows):
    sets = []
    for r in rows:
        s = next(tv.of_texts([r.text]))
        el, count, *_ = near_dup.weighted_shingles(s)
        sets.append((el, count))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_dup.prob_jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), r.doc_id)
    want = sorted((r.doc_id, least[find(i)]) for i, r in enumerate(rows))
    got = near_dup.near_duplicates(spark, docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == want
    kept = near_dup.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    wordless = [r.doc_id for r in rows if not words(r.text)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want if c not in wordless} | set()) [:0] + sorted(list({c for _, c in want if c not in wordless}) + wordless)
    assert near_dup.near_duplicates(spark, empty(spark)).count() == 0


def family(kind, n, seed, size=120):
    """Variants of one text: each derived from one of the 20 before it, or all from the first, by edits, cuts or repeated lines."""
    rng = random.Random(seed)
    word = lambda: f"{kind}{rng.randrange(3000)}"
    base, out = [word() for _ in range(size)], []
    for i in range(n):
        t = list(base)
        if kind == "chain":
            t = list(out[rng.randrange(max(0, i - 20), i)]) if i else t
            for _ in range(rng.randrange(1, 6)):
                t[rng.randrange(size)] = word()
        elif kind == "star":
            for _ in range(rng.randrange(1, 8)):
                t[rng.randrange(size)] = word()
        elif kind == "cut":
            at = rng.randrange(size - 20)
            del t[at : at + rng.randrange(1, 25)]
            if rng.random() < 0.5:
                t.insert(rng.randrange(len(t)), word())
        else:
            t += base[10:20] * rng.randrange(0, 6)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(size - 20)] = word()
        out.append(t)
    return [" ".join(t) for t in out]


def classes_of(texts):
    """The least place of each text's component, by comparing all pairs."""
    sets = [near_dup.weighted_shingles(next(tv.of_texts([t])))[:2] for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and near_dup.prob_jaccard(sets[i], sets[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def variants():
    texts = family("chain", 200, 3) + family("star", 150, 4) + family("cut", 120, 5) + family("repeat", 80, 6)
    return texts, classes_of(texts)


def test_near_duplicates_of_variants(spark, variants):
    texts, want = variants
    got = near_dup.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == want


def test_pipeline_stage_of_variants(spark, variants):
    texts, want = variants
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, D).collect()) == sorted(set(want))


def test_stages_keep_columns_of_any_name(spark):
    names = ["text", "copy", "_copy", "size", "_k", "_n", "_node", "node", "hash", "row", "key", "id", "id_text", "kept", "source", "lang", "_id", "c0", "_t", "_runs", "similarity", "n_chars", "doc_id"]
    text = "one two three four five six seven eight"
    rows = [(i if i % 7 else None, [text, "nine " + text[::-1], None, "", "a b@c.de f g h i"][i % 5]) for i in range(30)]
    df = spark.createDataFrame([(*[x if n == "text" else i if n in ("doc_id", "n_chars") else f"{n}-{i}" for n in names],) for i, x in rows], ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    whole = Counter(map(tuple, df.collect()))
    bench = spark.createDataFrame([(1, "not in any text of these")], "item_id long, text string")
    for out in (toxicity.keep_clean(spark, df, labels.limit(0)), decontaminate.clean(spark, df, bench)):
        assert out.columns == names and Counter(map(tuple, out.collect())) == whole
    kept = near_dup.one_of_each(spark, df)
    got = Counter(map(tuple, kept.collect()))
    assert kept.columns == names and not got - whole
    assert sorted(r[0] or "" for r in got.elements()) == sorted([*[r[0] or "" for r in whole.elements() if not words(r[0])], *{r[0] for r in whole if words(r[0])}])
    clean = pii.redacted(df)
    assert clean.columns == names and Counter(tuple(r)[1:] for r in clean.collect()) == Counter({k[1:]: 0 for k in whole} | Counter(x[1:] for x in whole.elements()))
    mix = mixing.mixed(spark, df)
    taken = Counter(tuple(r)[:-1] for r in mix.collect())
    assert mix.columns == [*names, "__copy"] and not set(taken) - set(whole) and all(n <= 2 * whole[r] for r, n in taken.items())
    assert taken == Counter(tuple(r)[:-1] for r in mixing.mixed(spark, df.repartition(3)).collect())
    want = mixing.mix(spark, df.select("doc_id", "source", "text")).agg(F.sum("copies")).first()[0]
    assert abs(sum(taken.values()) - want) <= 1


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        assert docs.count() == 0


def test_mixing_solves_the_balance(spark):
    """The rates against a bisection of each source's tilt."""
    rng = random.Random(2)
    rows = [(i, "abc"[i % 3] if i % 11 else None, " ".join(["w"] * rng.randrange(1, 400))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = mixing.sizes(df).groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = mixing.source_targets(spark, sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    histogram = sized.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("c.source", "size", "n", "source_size", "target").cache()
    got = {r.source: r for r in mixing.balance(spark, histogram).collect()}
    for source in {r[1] for r in rows}:
        h = [(r["size"], r.n, r.target) for r in histogram.where(F.col("source").eqNullSafe(source)).collect()]
        target, mean = h[0][2], sum(s * n for s, n, _ in h) / sum(n for _, n, _ in h)
        have = lambda tilt: sum(2 * n * s / (1 + math.exp(-tilt * s / mean)) for s, n, _ in h)  # noqa: E731, B023
        if target < 2 * sum(s * n for s, n, _ in h) * (1 - 1e-9):
            lo, hi = -60.0, 60.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if have(mid) < target else (lo, mid)
            assert got[source].tilt == pytest.approx(lo, abs=1e-5)
        else:
            assert got[source].tilt == mixing.MOST


def between_two_leaders(name):
    """Ids and texts: two groups of 8, and two texts that are linked to each other only, each nearer to the leader of another group."""
    some = lambda p, a, b: [f"{p}{name}x{i}" for i in range(a, b)]
    texts = [[*some(p, 0, 100), *some(f"{own}{i}", 0, i)] for p, own in (("b", "d"), ("c", "g")) for i in range(8)]
    texts += [[*some("b", 0, 47), *some("c", 0, 43)], [*some("b", 0, 43), *some("c", 0, 47)]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_duplicates_between_two_leaders(spark):
    df = spark.createDataFrame(between_two_leaders(1), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark, df, k=1, bands=6, rows=1).collect()}
    assert got[17] == got[16] == 16


def test_prob_jaccard_brute():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x, y = (dict(zip(rng.choice(12, 7, replace=False).tolist(), rng.integers(1, 4, 7).tolist(), strict=True)) for _ in range(2))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        a, b = ((np.array(sorted(z)), np.array([z[k] for k in sorted(z)])) for z in (x, y))
        assert near_dup.prob_jaccard(a, b) == pytest.approx(want)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(600)] + [(600 + i, [1.0] * 8) for i in range(300)]
    vecs += [(2000, None), (2050, [0.0] * 8), (2100, [None] + [1.0] * 7), (2150, [float("nan")] * 8), (2200, [1.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    good = [(i, np.array(v)) for i, v in vecs[:900]]
    got = {}
    for r in ann.nearest(spark, df, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for q, v in good:
        if q % 50 == 0:
            true = sorted(((i, float(v @ w / np.linalg.norm(v) / np.linalg.norm(w))) for i, w in good if i != q), key=lambda x: (-round(x[1], 12), x[0]))[:5]
            hit += len({i for i, _ in true} & {i for i, _ in got[q]})
            assert len(got[q]) == 5
    assert hit / (5 * 18) >= 0.9 and set(got) == {i for i, _ in good if i % 50 == 0}
    assert [i for i, _ in got[650]] == [600, 601, 602, 603, 604]
    few = ann.nearest(spark, df.where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1), (0, 2)]
    assert ann.nearest(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [4])
def test_nearest_with_trees_of_leaves(spark, dim):
    """Far more vectors than the sample and the leaves' bound: three levels of trees, and one frequent vector."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, dim))
    x[1000:1600] = x[0]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumns({"leaf": F.lit(1), "id": F.lit("x"), "v": F.lit(b"")})
    grown, inner = [], ann._fitted
    ann._fitted = lambda *a: grown.append(1) or inner(*a)
    try:
        rows = ann.nearest(spark, df, sample=200, most=40, block=16, leaf=16, branch=4).collect()
    finally:
        ann._fitted = inner
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got, hit = {}, 0
    for r in rows:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert len(grown) >= 3 and set(got) == set(range(0, 4000, 50))
    for q, found in got.items():
        near = unit @ unit[q]
        near[q] = -2
        true = np.lexsort((np.arange(4000), -near.round(12)))[:5]
        hit += len({i for i, _ in found.values()} & set(true.tolist()))
        assert sorted(found) == [1, 2, 3, 4, 5] and all(s == pytest.approx(near[i]) for i, s in found.values())
    assert hit / (5 * len(got)) >= 0.9
    assert [got[1050][i][0] for i in range(1, 6)] == [0, 1000, 1001, 1002, 1003] and [got[1000][i][0] for i in range(1, 6)] == [0, 1001, 1002, 1003, 1004]


def test_noisy_or():
    """A document's score from its sentences', and the first of the worst in code points."""
    model = toxicity.Model(*(lambda w: (w[np.argsort(w)], np.array([2.0, 3.0])[np.argsort(w)]))(np.array([tv.hash_of(x) for x in ("bad", "worse")])), -4.0)
    texts = ["Größe. Bad one! worse bad? é. worse BAD", "fine", None, "...", "bad\nbad\nbad"]
    score, worst, where = model.scores(next(tv.of_texts(texts)))
    p = lambda z: 1 / (1 + math.exp(-z))
    assert score == pytest.approx([1 - (1 - p(-4)) ** 2 * (1 - p(-2)) * (1 - p(1)) ** 2, p(-4), 0, 0, 1 - (1 - p(-2)) ** 3])
    assert where.tolist() == [texts[0].index("worse"), 0, -1, -1, 0] and worst == pytest.approx([p(1), p(-4), 0, 0, p(-2)])


def test_classifiers_without_labels_or_rows(spark, docs, labels):
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(spark, docs, none).collect()} == {0.5}
    assert toxicity.toxicity_scores(spark, empty(spark), labels).count() == 0
    assert toxicity.keep_clean(spark, docs, none).count() == docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = corpus_pipeline.run(spark, D)
    assert out.columns == [*docs.columns, "copy"] and 0 < out.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), D).columns == docs.columns
