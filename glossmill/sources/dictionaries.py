"""Dictionary files: synsets, exception lists, CEDICT, manifests, and their integrity."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import gloss_cue_pos


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_number (from 1), line. Line numbers need whole files, which for dictionaries are tens of MB."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_number"), "line")


def synsets(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries, a row for each word of a synset record, and rejected records with a code."""
    body = lines.where("line <> '' and not startswith(line, ' ')")
    head = F.filter(F.split(F.trim(F.split("line", r"\|", 2)[0]), r"\s+"), lambda x: x != "")
    f = body.withColumn("f", head).withColumn("gloss", F.trim(F.get(F.split("line", r"\|", 2), F.lit(1))))
    at = lambda i: F.get("f", F.lit(i) if isinstance(i, int) else i)
    fixed = at(0).rlike(r"^\d{8}$") & at(1).rlike(r"^\d{2}$") & at(2).isin("n", "v", "a", "s", "r") & at(3).rlike("^[0-9a-fA-F]{2}$")
    n = F.when(at(3).rlike("^[0-9a-fA-F]{2}$"), F.conv(at(3), 16, 10).cast("int"))
    f = f.withColumn("n", n).withColumn("pcount", at(4 + 2 * F.col("n")))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), lambda i: F.struct(F.get("f", 4 + 2 * i).alias("word"), F.get("f", 5 + 2 * i).alias("lex_id")))
    f = f.withColumn("pairs", F.when(F.col("n") > 0, pairs))
    shaped = F.col("pcount").rlike(r"^\d{3}$") & F.forall("pairs", lambda p: p["word"].isNotNull() & p["lex_id"].rlike("^[0-9a-fA-F]$"))
    pointers = F.when(F.col("pcount").rlike(r"^\d{3}$"), F.col("pcount").cast("int"))
    tail = F.size("f") - (5 + 2 * F.col("n"))
    # Verbs carry frames after the pointers; other records end with them.
    ended = F.when(at(2) == "v", tail >= pointers * 4).otherwise(tail == pointers * 4)
    code = F.when(~F.coalesce(fixed, F.lit(False)), "HEADER").when(~F.coalesce(F.col("n") > 0, F.lit(False)), "WORD_COUNT").when(~F.coalesce(shaped, F.lit(False)), "FIELDS").when(~F.coalesce(ended, F.lit(False)), "POINTERS").when(F.coalesce("gloss", F.lit("")) == "", "GLOSS")
    f = f.withColumn("code", code)
    rejected = f.where("code is not null").select("path", "line_number", "code", F.get("f", F.lit(0)).alias("record_ref"))
    pos = F.when(at(2).isin("a", "s"), "adj").when(at(2) == "r", "adv").otherwise(at(2))
    rows = f.where("code is null").select("path", "line_number", F.concat_ws(":", at(0), at(2)).alias("record_ref"), pos.alias("pos"), "gloss", F.posexplode("pairs").alias("word_ix", "p"))
    surface = F.replace(F.regexp_replace("p.word", r"\((a|p|ip)\)$", ""), F.lit("_"), F.lit(" "))
    entries = rows.select("path", "line_number", F.concat_ws(":", "record_ref", F.col("word_ix").cast("string")).alias("entry_id"), "record_ref", surface.alias("surface"), F.lower(surface).alias("norm"), surface.alias("lemma"), "pos", F.lit(1.0).alias("confidence"), "gloss")
    return entries, rejected


def exceptions(lines: DataFrame, pos: str) -> tuple[DataFrame, DataFrame]:
    """inflected, lemma, pos rows of an exception list, and rejected lines."""
    parts = lines.where("trim(line) <> ''").withColumn("f", F.transform(F.split(F.trim("line"), r"\s+"), lambda w: F.lower(F.replace(w, F.lit("_"), F.lit(" ")))))
    rejected = parts.where(F.size("f") < 2).select("path", "line_number", F.lit("EXCEPTION").alias("code"), F.get("f", F.lit(0)).alias("record_ref"))
    rows = parts.where(F.size("f") >= 2).select("path", "line_number", F.get("f", F.lit(0)).alias("inflected"), F.explode(F.slice("f", 2, F.size("f"))).alias("lemma"), F.lit(pos).alias("pos"))
    return rows.dropDuplicates(["inflected", "lemma", "pos"]), rejected


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function. Meant for dictionary forms and distinct types."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


RECORD = r"^(\S+)\s+(\S+)\s+\[([^\[\]]+)\]\s+/(.*)/$"


def cedict(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of a CEDICT file keyed by their Traditional form, and rejected records."""
    body = lines.where("trim(line) <> '' and not startswith(line, '#')").withColumn("line", F.trim("line"))
    part = lambda i: F.regexp_extract("line", RECORD, i)
    rows = body.withColumn("fits", F.col("line").rlike(RECORD)).withColumn("glosses", F.split(part(4), "/"))
    code = F.when(F.col("line").contains("[["), "V2_RECORD").when(~F.col("fits"), "RECORD").when(F.exists("glosses", lambda g: F.trim(g) == ""), "GLOSS")
    rows = rows.withColumn("code", code)
    rejected = rows.where("code is not null").select("path", "line_number", "code", F.col("line").alias("record_ref"))
    pos, confidence = gloss_cue_pos(F.col("glosses"))
    entries = rows.where("code is null").select("path", "line_number", nfc(part(1)).alias("surface"), nfc(part(2)).alias("simplified"), part(3).alias("pinyin"), "glosses", pos.alias("pos"), confidence.alias("confidence"))
    first = entries.groupBy("surface", "simplified", "pinyin", "glosses").agg(F.min("line_number").alias("first_line"))
    repeated = entries.join(first, ["surface", "simplified", "pinyin", "glosses"]).where("line_number > first_line")
    rejected = rejected.unionByName(repeated.select("path", "line_number", F.lit("DUPLICATE_RECORD").alias("code"), "surface").withColumnRenamed("surface", "record_ref"))
    kept = entries.join(first.withColumnRenamed("first_line", "line_number"), ["surface", "simplified", "pinyin", "glosses", "line_number"])
    return kept.withColumn("norm", F.col("surface")).withColumn("lemma", F.col("surface")).withColumn("gloss", F.get("glosses", F.lit(0))), rejected


def cedict_header_violations(lines: DataFrame, manifest_date: str | None = None) -> DataFrame:
    """code of each rule that the `#! key=value` header breaks."""
    pairs = lines.where("startswith(line, '#! ')").select(F.regexp_extract("line", r"^#! (\w+)=(.*)$", 1).alias("k"), F.regexp_extract("line", r"^#! (\w+)=(.*)$", 2).alias("v"))
    h = pairs.where("k <> ''").groupBy().agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("h"))
    want = lambda k, v, c: F.when(~F.coalesce(F.col("h")[k] == v, F.lit(False)), F.lit(c))
    dated = F.try_to_timestamp(F.col("h")["date"]).isNotNull()
    same = F.lit(True) if manifest_date is None else F.coalesce(F.substring(F.col("h")["date"], 1, 10) == manifest_date, F.lit(False))
    codes = F.array_compact(F.array(want("version", "1", "VERSION"), want("subversion", "0", "SUBVERSION"), want("format", "ts", "FORMAT"), want("charset", "UTF-8", "CHARSET"), F.when(~F.coalesce(F.try_to_number(F.col("h")["entries"], F.lit("999999999")) > 0, F.lit(False)), F.lit("ENTRIES")), F.when(~F.coalesce(dated, F.lit(False)), F.lit("DATE")), F.when(~same, F.lit("MANIFEST_DATE"))))
    return h.select(F.explode(codes).alias("code"))


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, bytes, sha256 of whole files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_violations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, code where files and manifest(role, path, bytes, sha256) differ, before anything is parsed."""
    m = manifest.select("path", F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha"), F.lit(True).alias("listed"))
    both = found.withColumn("there", F.lit(True)).join(m, "path", "full_outer")
    code = F.when(F.col("there").isNull(), "MISSING").when(F.col("listed").isNull(), "UNLISTED").when(F.col("bytes") != F.col("m_bytes"), "BYTES").when(F.col("sha256") != F.col("m_sha"), "SHA256")
    twice = lambda c: manifest.groupBy(c).count().where("count > 1").select(F.col(c).alias("path"), F.lit(f"DUPLICATE_{c.upper()}").alias("code"))
    return both.select("path", code.alias("code")).where("code is not null").unionByName(twice("path")).unionByName(twice("role"))


def dataset_hash(manifest: DataFrame) -> DataFrame:
    """One hash over the path-sorted file descriptors of each dataset."""
    d = F.struct("path", "bytes", "sha256")
    return manifest.groupBy("dataset_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(d))), 256).alias("dataset_hash"))


def build_receipt(entries: DataFrame, rejected: DataFrame, files: DataFrame) -> DataFrame:
    """dataset_id, receipt_id, n_entries, n_rejected, input_hash, output_hash.

    entries, rejected and files(path, bytes, sha256) carry dataset_id. The input hash is that of the files, the output
    hash sums 64-bit hashes of the entries, so that repeated rows count; without entries it is zero.
    """
    row = F.xxhash64("norm", "lemma", "pos", "gloss").cast("decimal(38,0)")
    e = entries.groupBy("dataset_id").agg(F.count("*").alias("n_entries"), F.sum(row).alias("output_hash"))
    r = rejected.groupBy("dataset_id").agg(F.count("*").alias("n_rejected"))
    both = e.join(r, "dataset_id", "full_outer").join(dataset_hash(files), "dataset_id", "full_outer")
    zero = F.lit(0).cast("long")
    name = F.concat_ws(":", "dataset_id", F.substring("dataset_hash", 1, 16))
    return both.select("dataset_id", name.alias("receipt_id"), F.coalesce("n_entries", zero).alias("n_entries"), F.coalesce("n_rejected", zero).alias("n_rejected"), F.col("dataset_hash").alias("input_hash"), F.coalesce(F.col("output_hash"), F.lit(0)).cast("string").alias("output_hash"))


def write_receipt(receipt: DataFrame, path: str) -> None:
    """One JSON line for each dataset, a row of the receipt each."""
    receipt.coalesce(1).sortWithinPartitions("dataset_id").write.mode("overwrite").json(path)


def _starts(batches):
    """Streams cases and finds each text's surfaces, each from the end of the one before it."""
    for batch in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
        out = []
        for text, surfaces in zip(batch.column("text").to_pylist(), batch.column("surfaces").to_pylist()):
            cursor, found = 0 if text is not None else -1, []
            for surface in surfaces or ():
                at = text.find(surface, cursor) if cursor >= 0 and surface is not None else -1
                found.append(at if at >= 0 else None)
                cursor = at + len(surface) if at >= 0 else -1
            out.append(found if surfaces is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("surfaces"), pa.array(out, pa.list_(pa.int32()))], names=["id", "surfaces", "starts"])


def gold_tokens(cases: DataFrame) -> DataFrame:
    """case_id, token_ix, surface, start, end of cases(id, text, surfaces); start is null from the first surface out of order.

    Each search begins where the one before ended, in constant time, so a text is read once however many surfaces it has.
    """
    cases = cases.select("id", "text", "surfaces")
    schema = T.StructType([cases.schema["id"], cases.schema["surfaces"], T.StructField("starts", T.ArrayType(T.IntegerType()))])
    found = cases.mapInArrow(_starts, schema)
    rows = found.select(F.col("id").alias("case_id"), F.posexplode(F.arrays_zip(F.col("surfaces").alias("surface"), F.col("starts").alias("start"))).alias("token_ix", "t"))
    return rows.select("case_id", "token_ix", "t.surface", "t.start", (F.col("t.start") + F.char_length("t.surface")).alias("end"))
