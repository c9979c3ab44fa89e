"""Very long texts, repeated anchors, ties and clashing columns, each with the result that brute force gives."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import decontaminate, lexical, licenses, mixing, quality, token_counts, toxicity

CLASH = ("labels", "score", "size", "source_size", "target", "n_tokens", "n_bytes", "spans", "id", "item", "term")


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns).withColumns({c: F.lit("x") for c in CLASH})


def test_decontamination_of_a_very_long_document(spark):
    item = " ".join(f"i{i}" for i in range(6000))
    noise = lambda a, n: " ".join(f"n{a + i % 5000}" for i in range(n))
    docs = table(spark, [(1, f"{noise(0, 200_000)} {item} {noise(7, 100_000)}"), (2, noise(0, 300_000)), (3, item)])
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.similarity, r.first_word, r.n_words) for r in decontaminate.contaminated(spark, docs, bench).collect()}
    assert got == {1: (5, 1.0, 200_000, 6000), 3: (5, 1.0, 0, 6000)}
    assert [r.doc_id for r in decontaminate.clean(spark, docs, bench).collect()] == [2]


def test_licenses_of_a_very_long_text_and_equal_places(spark):
    anchor = "permission is hereby granted "
    text = anchor * 40_000 + "under the MIT License " + anchor * 10 + "apache license version 2"
    docs = table(spark, [(1, text), (2, "under the mit license apache license version 2"), (3, "apache license version 2 under the mit license")])
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (160_048, 2, 160_000, 160_044)
    assert got[1].base_labels == got[2].base_labels == got[3].base_labels == "apache-2,mit"
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("text", ["word " * 200_000, "x" * 300_000, "é😀 " * 50_000])
def test_token_counts_of_very_long_texts(spark, text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, [(1, text), (2, "word"), (2, "word"), (None, None)])
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(spark, docs, path).collect()), key=str)
    n = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    one = len(Tokenizer.from_file(path).encode("word", add_special_tokens=False).ids)
    assert got == sorted([(1, len(text.encode()), n, n > 1024), (2, 4, one, False), (2, 4, one, False), (None, 0, 0, False)], key=str)


def test_mixing_of_a_very_long_text(spark):
    rows = [(1, "a " * 500_000, "s"), (2, "b c", "s"), (3, "d " * 1000, "t"), (4, None, None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in CLASH})
    got = {r.doc_id: r for r in mixing.mix(spark, docs).collect()}
    assert (got[1].size, got[2].size, got[3].size, got[4].size) == (500_000, 2, 1000, 0)
    assert got[1].source_size == 500_002 and all(r.taken <= 2 * r.size for r in got.values()) and got[3].target == pytest.approx(2000)


def test_classifiers_of_a_very_long_text(spark):
    rows = [(i, ("good calm words here. " if i % 2 else "vile nasty slur here. ") * (1 + i % 3)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = table(spark, [*rows, (100, "good calm words here. " * 60_000), (101, "good calm words here. " * 60_000 + "vile nasty slur here.")])
    for out in (quality.quality_scores(spark, docs, labels), toxicity.toxicity_scores(spark, docs, labels)):
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == 62 and all(0 <= r.score <= 1 for r in got.values())
    assert got[101].predicted == 1 and got[101].worst_start == 60_000 * 22 and got[101].score > got[100].score > got[1].score
    assert got[101].worst_score > 100 * got[100].worst_score


def test_search_over_a_very_long_text(spark):
    docs = table(spark, [(1, "needle " + "hay " * 400_000), (2, "needle hay"), (3, "hay"), (4, "needle hay")])
    items = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    assert [(r["rank"], r.doc_id) for r in lexical.search(spark, docs, items).orderBy("rank").collect()] == [(1, 2), (2, 4), (3, 1)]
