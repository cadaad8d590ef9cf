"""Profiles as VARIANT, order over files, whole evaluations, and texts cut in linear time."""

import json

import pytest
from pyspark.sql import functions as F

from glossmill.operators import lexicon, profiles, projection, quality
from glossmill.plans import checks


def rows(spark, values):
    return profiles.parsed(spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "id int, json string"))


def test_migration_of_odd_values(spark):
    odd = [
        {}, None, "no json", {"density": None, "minConfidence": True, "maxMarkedTokens": "250"}, {"density": "x", "minConfidence": "", "profileId": 5, "profileRevision": -1, "enabled": "no"},
        {"posLabels": False, "channels": {"posLabel": True, "learningState": True, "chunk": True}, "schemaVersion": 2}, {"runtimeBudgets": {"maxSentences": 0, "viewportBufferPx": 0, "maxShardIds": 7.5}, "maxTextNodes": 1e9},
    ]
    got = profiles.migrated(rows(spark, odd)).orderBy("id").collect()
    assert [(r.density, r.min_confidence, r.profile_id) for r in got] == [(0.65, 0.6, "migrated")] * 3 + [(0.0, 1.0, "migrated"), (0.65, 0.0, "migrated"), (0.65, 0.6, "default"), (0.65, 0.6, "migrated")]
    assert (got[3].max_marked_tokens, got[4].profile_revision, got[4].enabled, got[6].max_text_nodes) == (250, 0, True, 2000)
    assert (got[5].channels["posLabel"], got[5].channels["learningState"], got[5].channels["chunk"]) == (True, False, True)
    assert [got[6].runtime_budgets[k] for k in ("maxSentences", "viewportBufferPx", "maxShardIds", "timeSliceMs")] == [1, 0, 8, 8]


def test_strict_form(spark):
    whole = json.loads(checks._JSON)
    nested = whole | {"sitePolicy": {"schemaVersion": 1, "userDenylist": ["A.org", 3]}, "channels": {}, "runtimeBudgets": None}
    got = [r.codes for r in profiles.violations(rows(spark, [whole, {}, None, nested, whole | {"density": True, "profileRevision": 2**60}])).orderBy("id").collect()]
    assert got[0] == [] and got[1] == sorted(f"MISSING:{f}" for f in profiles.FIELDS) and got[2] == ["OBJECT:profile"]
    assert got[3] == sorted(["INVALID:sitePolicy.userDenylist", "OBJECT:runtimeBudgets", *(f"MISSING:channels.{c}" for c in profiles.SWITCHES)])
    assert got[4] == ["INVALID:density", "INVALID:profileRevision"]


def test_migrated_profiles_are_strict_ones(spark):
    """What migration gives, written as JSON again, breaks no rule but those of the fields that it leaves to others."""
    found = profiles.migrated(rows(spark, [{}, {"density": 3, "languageMode": "zh"}]))
    text = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.col("profile_id").alias("profileId"), F.col("profile_revision").alias("profileRevision"), "enabled", F.col("language_mode").alias("languageMode"), F.col("trigger_mode").alias("triggerMode"), "channels", "density", F.col("min_confidence").alias("minConfidence"), F.col("label_position").alias("labelPosition"), F.col("runtime_budgets").alias("runtimeBudgets"), F.col("max_text_nodes").alias("maxTextNodes"), F.col("max_marked_tokens").alias("maxMarkedTokens")))
    again = profiles.violations(profiles.parsed(found.select("id", text.alias("json"))))
    assert [r.codes for r in again.collect()] == [["MISSING:sitePolicy"]] * 2


@pytest.mark.parametrize("split", ["512m", "1k"])
def test_order_over_files(spark, tmp_path, split):
    files = [["a", "b", "b", "d"], ["c", "e", "é", "~"], [None, "x"], ["x", "y", "w"]]
    for i, keys in enumerate(files):
        spark.createDataFrame([(k, 1) for k in keys], "k string, n int").coalesce(1).write.parquet(str(tmp_path / f"f/p={i}"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = lexicon.file_order_violations(spark, str(tmp_path / "f"), ["k", "n"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(((r.path.split("p=")[1][0], r.row, r.key[0]) for r in found), key=str) == [("1", 0, "c"), ("1", 3, "~"), ("2", 0, None), ("3", 2, "w")]


def test_order_inside_large_files(spark, tmp_path):
    """Several row groups and batches in a file, with one fault at a place that is in the middle of them."""
    ids = spark.range(40_000).select(F.lpad(F.when(F.col("id") == 20_000, 19_000).otherwise(F.col("id")).cast("string"), 6, "0").alias("k"))
    ids.coalesce(1).write.option("parquet.block.size", 20_000).parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = lexicon.file_order_violations(spark, str(tmp_path / "f"), ["k"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row, r.key) for r in found] == [(20_000, ["019000"])]


def test_whole_evaluation(spark):
    cases = spark.createDataFrame([("a", "en"), ("b", "en"), ("c", "zh"), ("d", "zh")], "case_id string, locale string")
    gold = spark.createDataFrame([("a", "en", 0, 1, "n", "cat", "plural", False, None), ("a", "en", 2, 3, "v", None, None, False, None), ("b", "en", 0, 1, "x", None, None, True, None), ("c", "zh", 0, 1, "n", None, None, False, "学")], "case_id string, locale string, start int, end int, pos string, lemma string, form string, unknown boolean, simplified string")
    predicted = spark.createDataFrame([("a", 0, 1, "n", "cat", "plural", "r", 0.9, None), ("a", 2, 3, "n", "go", None, "r", 0.9, None), ("b", 0, 1, "x", None, None, None, 0.15, None), ("c", 0, 1, "n", None, None, "r", 7.0, "学"), ("c", 1, 2, "n", None, None, "", 0.5, None)], "case_id string, start int, end int, pos string, lemma string, form string, lexical_ref string, confidence double, simplified string")
    got = {r.locale: r for r in quality.evaluate_corpus(cases, gold, predicted).collect()}
    en, zh = got["en"], got["zh"]
    assert (en.n_cases, en.n_exact, en.matched, en.n_with_refs, en.n_sound, en.span_f1) == (2, 2, 3, 2, 3, 1.0)
    assert (zh.n_cases, zh.n_exact, zh.matched, zh.n_with_refs, zh.n_sound, zh.simplified_asked, zh.simplified_passed) == (2, 1, 1, 1, 1, 1, 1)
    assert abs(en.pos_macro_f1 - (2 / 3 + 0 + 1) / 3) < 1e-12 and (en.unknown_asked, en.unknown_passed, en.form_passed) == (1, 1, 1)
    gates = {(r.locale, r.name) for r in quality.corpus_gate(quality.evaluate_corpus(cases, gold, predicted)).where("not passed").collect()}
    assert gates == {("en", "pos_macro_f1"), ("zh", "pos_macro_f1"), ("zh", "span_f1"), ("zh", "exact_cases"), ("zh", "confidence")}


def test_segments_of_a_long_text_with_signs_beyond_the_basic_plane(spark):
    text = "a\U0001f600é漢 " * 40_000
    spans = [(i, i + 2) for i in range(0, 200_000, 5)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    runs = projection.segments(docs, spark.createDataFrame([(1, a, b) for a, b in spans], "doc_id long, start int, end int")).orderBy("doc_id", "seg_ix").collect()
    assert "".join(r.text for r in runs) == text and len(runs) == 80_000 and {r.text for r in runs if r.marked} == {"a\U0001f600"}


def test_a_profile_of_many_rows_is_read_once(spark):
    texts = [json.dumps({"profileId": "a", "density": 2}), "[1]", None]
    raw = spark.createDataFrame([(i, texts[i % 3]) for i in range(300)], "id int, json string")
    read = []

    def of(distinct):
        read.append(distinct.count())
        return profiles.migrated(profiles.violations(profiles.parsed(distinct))).select("json", "codes", "profile_id", "density")

    for rows in (10_000, 1):
        found = {(r.id, tuple(r.codes), r.profile_id, r.density) for r in profiles.per_text(raw, of, rows=rows).collect()}
        whole = profiles.migrated(profiles.violations(profiles.parsed(raw)))
        assert found == {(r.id, tuple(r.codes), r.profile_id, r.density) for r in whole.collect()} and len(found) == 300
    assert read == [3, 3]
