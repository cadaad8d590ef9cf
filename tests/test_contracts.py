"""Contract checks: tables that keep their contract, and one fault of each kind."""

from glossmill.operators import contracts as C
from glossmill.operators import lexicon

ENTRY = "entry_id string, locale string, surface string, norm string, lemma string, pos string, confidence double, glosses array<string>, dataset_id string"
MANIFEST = "dataset_id string, locale string, version string, url string, acquired_at string, license_id string, files array<struct<role:string,path:string,bytes:bigint,sha256:string>>"


def codes(df):
    return sorted(r.code for r in df.collect())


def test_entries(spark):
    good = ("e1", "en", "a", "a", "a", "n", 1.0, ["g"], "d")
    assert codes(C.entry_violations(spark.createDataFrame([good], ENTRY))) == []
    bad = ("e1", "fr", "", "a", None, "noun", 2.0, [], "")
    assert codes(C.entry_violations(spark.createDataFrame([good, bad], ENTRY))) == ["CONFIDENCE", "DATASET", "DUPLICATE_ID", "GLOSSES", "LEMMA", "LOCALE", "POS", "SURFACE"]


def test_manifests(spark):
    good = ("d", "en", "1", "https://a", "2026-01-01T00:00:00Z", "l", [("data", "a.txt", 5, "0" * 64)])
    assert codes(C.manifest_violations(spark.createDataFrame([good], MANIFEST))) == []
    bad = ("d", "en", "1", "http://a", "yesterday", "l", [("data", "../a", 0, "x"), ("data", "b", 1, "0" * 64)])
    assert codes(C.manifest_violations(spark.createDataFrame([bad], MANIFEST))) == ["ACQUIRED_AT", "DUPLICATE_FILE", "FILE_FIELDS", "FILE_PATH", "URL"]


def test_licences_and_receipts(spark):
    cols = "license_id string, name string, url string, commercial_use boolean, redistribution boolean, attribution string"
    rows = [("l", "L", "https://a", True, True, "name it"), ("m", "M", "https://b", None, True, "")]
    assert codes(C.license_violations(spark.createDataFrame(rows, cols))) == ["ATTRIBUTION", "RIGHTS"]
    entries = spark.createDataFrame([("d",), ("d",)], "dataset_id string")
    cols = "dataset_id string, input_hash string, output_hash string, n_entries bigint, n_rejected bigint, built_at string"
    rows = [("d", "0" * 64, "1" * 64, 2, 0, "2026-01-01T00:00:00Z"), ("x", "0" * 64, "1", 2, 0, "2026-01-01T00:00:00Z")]
    assert codes(C.receipt_violations(spark.createDataFrame(rows, cols), entries)) == ["ENTRY_COUNT", "HASH"]


def test_lexicon_contract(spark):
    assert C.lexicon_contract(lexicon.seed_lexicon(spark)) == [] and C.lexicon_contract(lexicon.synthetic(spark, 10)) == []
    assert C.lexicon_contract(lexicon.seed_lexicon(spark).drop("tier")) == ["tier: string"]
