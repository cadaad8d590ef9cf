"""Contract checks of lexical entries, dataset manifests, licences and build receipts: violations by code.

Each check returns subject and code rows; a table that keeps its contract returns none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W

LOCALES = ["en", "zh-Hant"]
SHA256 = "^[0-9a-f]{64}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
LEXICON = {"norm": "string", "locale": "string", "lemma": "string", "pos": "string", "confidence": "double", "lexical_ref": "string", "tier": "string"}


def _fails(ok: Column, code: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))


def _filled(name: str) -> Column:
    return F.trim(F.col(name)) != ""


def _rows(df: DataFrame, subject: str, checks: list[Column]) -> DataFrame:
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(F.array_compact(F.array(*checks))).alias("code"))


def entry_violations(entries: DataFrame) -> DataFrame:
    """entries(entry_id, locale, surface, norm, lemma, pos, confidence, glosses array of string, dataset_id)."""
    twice = entries.groupBy("entry_id").count().where("count > 1").select(F.col("entry_id").alias("subject"), F.lit("DUPLICATE_ID").alias("code"))
    checks = [
        _fails(_filled("entry_id"), "ENTRY_ID"), _fails(F.col("locale").isin(LOCALES), "LOCALE"), _fails(_filled("surface") & _filled("norm"), "SURFACE"), _fails(_filled("lemma"), "LEMMA"),
        _fails(F.col("pos").isin(W.POS_ORDER), "POS"), _fails(F.col("confidence").between(0, 1), "CONFIDENCE"), _fails((F.size("glosses") > 0) & F.forall("glosses", lambda g: F.trim(g) != ""), "GLOSSES"), _fails(_filled("dataset_id"), "DATASET"),
    ]
    return _rows(entries, "entry_id", checks).unionByName(twice)


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """manifests(dataset_id, locale, version, url, acquired_at, license_id, files array of (role, path, bytes, sha256))."""
    names = F.transform("files", lambda f: f["path"])
    roles = F.transform("files", lambda f: f["role"])
    checks = [
        _fails(_filled("dataset_id"), "DATASET_ID"), _fails(F.col("locale").isin(LOCALES), "LOCALE"), _fails(_filled("version"), "VERSION"), _fails(F.col("url").startswith("https://"), "URL"),
        _fails(F.col("acquired_at").rlike(ISO_TIME) & F.try_to_timestamp("acquired_at").isNotNull(), "ACQUIRED_AT"), _fails(_filled("license_id"), "LICENSE"), _fails(F.size("files") > 0, "FILES"),
        _fails(F.forall("files", lambda f: (f["bytes"] > 0) & f["sha256"].rlike(SHA256)), "FILE_FIELDS"), _fails((F.size(F.array_distinct(names)) == F.size(names)) & (F.size(F.array_distinct(roles)) == F.size(roles)), "DUPLICATE_FILE"),
        _fails(~F.exists("files", lambda f: f["path"].startswith("/") | f["path"].contains("..")), "FILE_PATH"),
    ]
    return _rows(manifests, "dataset_id", checks)


def license_violations(licenses: DataFrame) -> DataFrame:
    """licenses(license_id, name, url, commercial_use, redistribution, attribution)."""
    checks = [_fails(_filled("license_id"), "LICENSE_ID"), _fails(_filled("name"), "NAME"), _fails(F.col("url").startswith("https://"), "URL"), _fails(F.col("commercial_use").isNotNull() & F.col("redistribution").isNotNull(), "RIGHTS"), _fails(~F.coalesce("redistribution", F.lit(False)) | _filled("attribution"), "ATTRIBUTION")]
    return _rows(licenses, "license_id", checks)


def receipt_violations(receipts: DataFrame, entries: DataFrame) -> DataFrame:
    """receipts(dataset_id, input_hash, output_hash, n_entries, n_rejected, built_at) against the entries they count."""
    counted = entries.groupBy("dataset_id").agg(F.count("*").alias("found"))
    both = receipts.join(counted, "dataset_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    checks = [_fails(F.col("input_hash").rlike(SHA256) & F.col("output_hash").rlike(SHA256), "HASH"), _fails(F.col("n_entries") == F.col("found"), "ENTRY_COUNT"), _fails(F.col("n_rejected") >= 0, "REJECTED_COUNT"), _fails(F.col("built_at").rlike(ISO_TIME), "BUILT_AT")]
    return _rows(both, "dataset_id", checks)


def lexicon_contract(lexicon: DataFrame) -> list[str]:
    """Columns that a provider's lexicon lacks or types otherwise; none: any operator takes it."""
    types = dict(lexicon.dtypes)
    return [f"{name}: {kind}" for name, kind in LEXICON.items() if types.get(name) != kind]
