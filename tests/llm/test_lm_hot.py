"""Frequent bigrams of the language model are counted in the pass that counts words, exactly and without a pass of their own."""

import math
import re
from collections import Counter

import pytest
from glossmill.llm import lm
from pyspark.sql import functions as F


def documents(spark):
    """200 documents that share a frequent bigram, and one of the sketch's sixteenth that holds a frequent bigram alone."""
    texts = [f"new  york\tw{i % 7} " * 12 + f"New York u{i}" for i in range(200)] + ["new", "york new", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alone = spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit("salt lake " * 300).alias("text"))
    return rows.union(alone.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) == 0).limit(1))


def brute_force(rows):
    docs = {r.doc_id: (r.text or "").lower().split() for r in rows}
    uni = Counter(w for d in docs.values() for w in d)
    own = {i: Counter(zip(d, d[1:])) for i, d in docs.items()}
    every, held, n = sum(own.values(), Counter()), Counter(p for c in own.values() for p in c), sum(uni.values())
    out = {}
    for i, d in docs.items():
        s = math.log(uni[d[0]] / n) if d else 0.0
        s += sum(c * (math.log(every[a, b] / uni[a]) if held[a, b] > 1 else math.log(lm.BACKOFF * uni[b] / n)) for (a, b), c in own[i].items())
        out[i] = (len(d), sum(c for p, c in own[i].items() if held[p] > 1), s)
    return out


@pytest.mark.parametrize("form", ["narrow", "wide", "shuffled", "met", "none"])
def test_frequent_bigrams(spark, monkeypatch, form):
    docs = documents(spark)
    want, rows = brute_force(docs.collect()), docs.withColumnRenamed("doc_id", "doc")
    hot = {r.hot for r in lm.hot_bigrams(rows).collect()}
    pair = lambda a, b: spark.range(1).select(F.xxhash64(F.xxhash64(F.lit(a)), F.xxhash64(F.lit(b)))).first()[0]
    assert {pair("new", "york"), pair("salt", "lake")} <= hot
    if form == "wide":
        monkeypatch.setattr(lm, "moved_words", lambda counts: None)
    if form == "shuffled":
        monkeypatch.setattr(lm, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lm, "SHARES", 4)
    if form == "met":  # bigrams share hashes, so none may stay hot
        plain = lm.pair_hash
        monkeypatch.setattr(lm, "pair_hash", lambda *a: F.pmod(plain(*a), F.lit(3)))
    if form == "none":
        monkeypatch.setattr(lm, "hot_bigrams", lambda docs: spark.createDataFrame([], "hot long"))
    got = {r.doc_id: r for r in lm.scores(docs).collect()}
    assert got.keys() == want.keys()
    for i, (words, seen, score) in want.items():
        assert (got[i].n_words, got[i].n_seen) == (words, seen) and abs(got[i].log_score - score) < 2e-4


def test_texts_are_read_four_times(spark):
    """Sketch, counts, sums of logarithms, bigrams: no pass more, and none cuts a text twice."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(i, f"a b c{i} a b") for i in range(50)], "doc_id long, text string")
    assert len(lm.scores(docs.withColumn("text", counted("text"))).collect()) == 50
    assert 4 * 50 <= read.value < 5 * 50  # the sketch's documents come once more, after the function's filter


def test_words_are_cut_as_compiled_code(spark, capsys):
    lm.word_pairs(spark.createDataFrame([(1, "a  b")], "doc long, text string"), "doc").explain()
    plan = capsys.readouterr().out
    assert "lambda" not in plan and plan.count("split(") == 1
    carried = re.search(r"Generate .*\), \[(.*?)\], true", plan)[1]
    assert "doc#" in carried and "words#" not in carried
