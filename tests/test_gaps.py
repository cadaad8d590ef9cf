"""Seed tokens, sentence records, declared buckets, receipts and diagnostics."""

import json

import pytest
from pyspark.sql import functions as F

from glossmill.operators import lexicon, projection, quality, seed_tokens
from glossmill.sources import dictionaries


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit("clash"))


def spans(rows):
    return [(r.doc_id, r.surface, r.start, r.end, r.language, r.pos, r.confidence, r.priority) for r in rows.orderBy("doc_id", "start", "end").collect()]


def test_seed_tokens(spark):
    got = spans(seed_tokens.tokenize(docs(spark, "學習快 reading", "卡拉OK", None, "", "123", "學習語言", "the")))
    assert got == [
        (0, "學習", 0, 2, "zh", "v", 0.94, 0.85), (0, "快", 2, 3, "zh", "x", 0.2, 0.2), (0, "reading", 4, 11, "en", "v", 0.76, 0.85),
        (1, "卡拉OK", 0, 4, "zh", "n", 0.94, 0.85), (1, "OK", 2, 4, "en", "x", 0.25, 0.2),
        (5, "學習", 0, 2, "zh", "v", 0.94, 0.85), (5, "語言", 2, 4, "zh", "n", 0.94, 0.85), got[-1],
    ]
    assert got[-1][:6] == (6, "the", 0, 3, "en", "det")


def test_seed_token_modes(spark):
    rows = docs(spark, "學習 reading")
    assert [t[1] for t in spans(seed_tokens.tokenize(rows, mode="en"))] == ["reading"]
    assert [t[1] for t in spans(seed_tokens.tokenize(rows, mode="zh"))] == ["學習"]
    with pytest.raises(ValueError):
        seed_tokens.tokenize(rows, mode="fr")


def test_sentence_records(spark):
    texts = spark.createDataFrame([(1, "One two. Three", 4), (2, "Solo", None), (3, None, 1)], "page_id long, text string, root_revision int")
    runs = spark.createDataFrame([(1, "n0", 0, 4), (1, "n1", 4, 14), (2, "n0", 0, 4)], "page_id long, node_id string, start int, end int")
    got = {(r.page_id, r.record_id): [tuple(f) for f in r.fragments] for r in projection.sentence_records(texts, runs).collect()}
    assert got == {(1, "4:0:8"): [("n0", 0, 4), ("n1", 0, 4)], (1, "4:9:14"): [("n1", 5, 10)], (2, "0:0:4"): [("n0", 0, 4)]}


def test_bucket_violations(spark):
    lex = lexicon.seed_lexicon(spark).where("locale = 'en'")
    declared = lexicon.manifest(lex, 4)
    good = lexicon.bucketed(lex, 4)
    assert lexicon.bucket_violations(good, declared, 4).count() == 0
    codes = lambda df, d=declared: {(r.bucket, r.code) for r in lexicon.bucket_violations(df, d, 4).collect()}
    one = good.where("bucket = 1").limit(1).first().norm
    assert codes(good.where(F.col("norm") != one)) == {(1, "COUNT"), (1, "HASH")}
    assert codes(good.withColumn("confidence", F.when(F.col("bucket") == 2, 0.123).otherwise(F.col("confidence")))) == {(2, "HASH")}
    assert codes(good.where("bucket <> 3")) == {(3, "MISSING")}
    assert codes(good, declared.where("bucket <> 0")) == {(0, "UNDECLARED")}
    moved = good.withColumn("bucket", F.when(F.col("norm") == one, 2).otherwise(F.col("bucket")))
    assert (2, "BUCKET_ID") in codes(moved)


def test_receipt(spark, tmp_path):
    entries = spark.createDataFrame([("d", "a", "a", "n", "g"), ("d", "a", "a", "n", "g"), ("d", "b", "b", "v", None)], "dataset_id string, norm string, lemma string, pos string, gloss string")
    rejected = spark.createDataFrame([("d", 1), ("only-rejected", 1)], "dataset_id string, line_number int")
    files = spark.createDataFrame([("d", "x", 3, "00"), ("d", "y", 4, "11")], "dataset_id string, path string, bytes long, sha256 string")
    receipt = dictionaries.build_receipt(entries, rejected, files)
    by_id = {r.dataset_id: r for r in receipt.collect()}
    assert (by_id["d"].n_entries, by_id["d"].n_rejected) == (3, 1)
    assert (by_id["only-rejected"].n_entries, by_id["only-rejected"].input_hash, by_id["only-rejected"].output_hash) == (0, None, "0")
    fewer = {r.dataset_id: r for r in dictionaries.build_receipt(entries.where("norm = 'b'"), rejected, files).collect()}
    assert fewer["d"].output_hash != by_id["d"].output_hash and fewer["d"].input_hash == by_id["d"].input_hash
    other = dictionaries.build_receipt(entries, rejected, files.where("path = 'x'")).where("dataset_id = 'd'").first()
    assert other.input_hash != by_id["d"].input_hash
    dictionaries.write_receipt(receipt, str(tmp_path / "r"))
    lines = [json.loads(x) for p in (tmp_path / "r").glob("*.json") for x in p.read_text().splitlines()]
    assert [x["dataset_id"] for x in lines] == ["d", "only-rejected"] and lines[0]["n_entries"] == 3


def test_unavailable_capabilities(spark):
    tokens = spark.createDataFrame([(0, "n", "verified-lexical-index", "en"), (1, "x", "bootstrap-lexicon", "zh-Hant")], "doc_id long, pos string, source string, language string")
    rows = {r.doc_id: (r.fallback_used, r.unavailable) for r in quality.diagnostics(docs(spark, "a", "學", None), tokens).collect()}
    every = ["chunk", "grammar-role", "learning-state", "tense-aspect"]
    assert rows == {0: (False, ["learning-state"]), 1: (True, every), 2: (False, every)}


def test_order_violations(spark):
    rows = spark.createDataFrame([("p", 0, "a"), ("p", 1, "c"), ("p", 2, "b"), ("q", 0, "a")], "part string, ix int, norm string")
    assert [(r.part, r.ix) for r in lexicon.order_violations(rows, ["norm"], ["part"]).collect()] == [("p", 2)]


def test_evaluate_and_gate(spark):
    gold = spark.createDataFrame([("c", "en", 0, 1, "a", None, False), ("c", "en", 2, 3, "b", "plural", False), ("c", "en", 4, 5, None, None, True)], "case_id string, locale string, start int, end int, lemma string, form string, unknown boolean")
    predicted = spark.createDataFrame([("c", 0, 1, "n", "a", None), ("c", 2, 3, "n", "z", "plural"), ("c", 4, 5, "x", None, None)], "case_id string, start int, end int, pos string, lemma string, form string")
    r = quality.evaluate(gold, predicted).first()
    assert (r.n_tokens, r.lemma_asked, r.lemma_passed, r.form_asked, r.form_passed, r.unknown_asked, r.unknown_passed) == (3, 2, 1, 1, 1, 1, 1)
    scores = spark.createDataFrame([("a", 0.95, 3, 3), ("b", 0.95, 3, 2), ("c", 0.5, 3, 3)], "name string, value double, expected int, passed_count int")
    assert [x.passed for x in quality.quality_gate(scores).orderBy("name").collect()] == [True, False, False]
