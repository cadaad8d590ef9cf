"""Lexicons: authored seed rows, corpus-derived rows, merging, statistics and integrity.

The lexicon contract is a DataFrame with norm, locale, surface, lemma, pos, confidence, gloss, gloss_ref,
lexical_ref, dataset_id, tier; tier is verified or fallback.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as X
from ..functions import words as W

COLUMNS = ["norm", "locale", "surface", "lemma", "pos", "confidence", "gloss", "gloss_ref", "lexical_ref", "dataset_id", "tier"]

# A small authored seed lexicon: lemma, part of speech, gloss.
SEED = [
    ("book", "n", "bound pages to read"), ("book", "v", "to reserve"), ("child", "n", "a young person"), ("clear", "adj", "easy to see"),
    ("clear", "v", "to remove"), ("house", "n", "a building to live in"), ("house", "v", "to shelter"), ("important", "adj", "of weight"),
    ("learn", "v", "to gain knowledge"), ("meaning", "n", "what is meant"), ("read", "v", "to take in writing"), ("reading", "n", "the act of taking in writing"),
    ("sentence", "n", "words that make a statement"), ("show", "v", "to make seen"), ("show", "n", "a public display"), ("word", "n", "a unit of language"),
    ("write", "v", "to set down in signs"), ("work", "n", "effort"), ("work", "v", "to make an effort"), ("quickly", "adv", "with speed"),
    ("fast", "adj", "of high speed"), ("be", "aux", "to exist"), ("have", "aux", "to hold"), ("good", "adj", "of quality"),
]
# Irregular forms: form, lemma, part of speech.
IRREGULAR = [("children", "child", "n"), ("wrote", "write", "v"), ("written", "write", "v"), ("shown", "show", "v"), ("better", "good", "adj")]
# A Traditional Chinese seed lexicon: surface, simplified, part of speech, gloss.
SEED_ZH = [
    ("我", "我", "pron", "I"), ("正在", "正在", "adv", "in the course of"), ("學習", "学习", "v", "to learn"), ("中文", "中文", "n", "Chinese"),
    ("學", "学", "v", "to study"), ("卡拉OK", "卡拉OK", "n", "karaoke"), ("語言", "语言", "n", "language"), ("在", "在", "prep", "at"), ("文", "文", "n", "writing"),
]


def seed_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(s, "en", s, s, p, 1.0, g, f"seed-gloss:{s}:{p}", f"seed:{s}:{p}", "seed", "verified") for s, p, g in SEED]
    rows += [(t, "zh-Hant", t, t, p, 0.94, g, f"seed-gloss:{t}", f"seed:{t}:{p}", "seed", "verified") for t, _, p, g in SEED_ZH]
    rows += [(w, "en", w, w, p, c, None, None, f"rule:{w}", None, "fallback") for w, p, c in W.rule_words()]
    return spark.createDataFrame(rows, "norm string, locale string, surface string, lemma string, pos string, confidence double, gloss string, gloss_ref string, lexical_ref string, dataset_id string, tier string")


def seed_morphology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, "seed", f"exc:{r[0]}") for r in IRREGULAR], "inflected string, lemma string, pos string, dataset_id string, record_ref string")


def corpus_lexicon(types: DataFrame, least: int = 5) -> DataFrame:
    """Rows for types(norm, n) that occur at least so often; their part of speech follows from length, some have two."""
    types = types.where(F.col("n") >= least)
    size = F.char_length("norm")
    first = F.element_at(F.lit(["n", "v", "adj", "n"]), F.pmod(size, F.lit(4)) + 1)
    second = F.when(F.pmod(size, F.lit(3)) == 0, F.when(first == "n", F.lit("v")).otherwise("n"))
    senses = F.filter(F.array(F.struct(first.alias("pos"), F.lit(0.8).alias("confidence")), F.struct(second.alias("pos"), F.lit(0.6).alias("confidence"))), lambda s: s["pos"].isNotNull())
    rows = types.select("norm", F.explode(senses).alias("s")).select("norm", "s.*")
    return rows.select("norm", F.lit("en").alias("locale"), F.col("norm").alias("surface"), F.col("norm").alias("lemma"), "pos", "confidence", F.concat(F.lit("a form of "), F.col("norm")).alias("gloss"), F.concat_ws(":", F.lit("corpus-gloss"), "norm", "pos").alias("gloss_ref"), F.concat_ws(":", F.lit("corpus"), "norm", "pos").alias("lexical_ref"), F.lit("corpus").alias("dataset_id"), F.lit("verified").alias("tier"))


def normalize_rows(raw: DataFrame) -> DataFrame:
    """Defaults and clamps of lexicon rows; rows without surface and lemma go."""
    surface = F.coalesce("surface", "norm")
    lemma = F.coalesce("lemma", surface)
    named = raw.withColumns({"surface": surface, "lemma": lemma}).where("surface is not null and lemma is not null and surface <> '' and lemma <> ''")
    known = F.col("pos").isin(W.POS_ORDER)
    return named.withColumns({"pos": F.when(known, F.col("pos")).otherwise("x"), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), "norm": F.coalesce("norm", F.lower("surface"))})


def provider_chain(verified: DataFrame, fallback: DataFrame) -> DataFrame:
    """All rows of both, marked by tier."""
    return verified.withColumn("tier", F.lit("verified")).unionByName(fallback.withColumn("tier", F.lit("fallback")), allowMissingColumns=True)


def chain_morphology(verified: DataFrame, fallback: DataFrame) -> DataFrame:
    """Exceptions of the fallback only for forms without a verified one."""
    return verified.unionByName(fallback.join(verified.select("inflected").distinct(), "inflected", "left_anti"))


def registry(indexes: list[DataFrame], fallback: DataFrame | None = None) -> DataFrame:
    """Rows of the first index that holds their key; fallback last. Each index has norm and locale."""
    every = [*indexes, *([fallback] if fallback is not None else [])]
    union = None
    for order, df in enumerate(every):
        one = df.withColumn("index_order", F.lit(order))
        union = one if union is None else union.unionByName(one, allowMissingColumns=True)
    first = union.groupBy("norm", "locale").agg(F.min("index_order").alias("index_order"))
    return union.join(first, ["norm", "locale", "index_order"])


def max_surface_length(lexicon: DataFrame) -> DataFrame:
    """first_char, max_len of the surfaces that start with it."""
    return lexicon.groupBy(F.substring("norm", 1, 1).alias("first_char")).agg(F.max(F.char_length("norm")).alias("max_len"))


def statistics(lexicon: DataFrame, by: Column | str = "locale") -> DataFrame:
    """Rows, surfaces and sources by locale, or by another column."""
    return lexicon.groupBy(by).agg(F.count("*").alias("n_rows"), F.countDistinct("norm").alias("n_surfaces"), F.array_join(F.array_sort(F.collect_set("dataset_id")), ",").alias("datasets"))


def gloss_dictionary(lexicon: DataFrame, buckets: int = 16) -> DataFrame:
    """Distinct glosses with a dense index in byte order inside each bucket."""
    distinct = lexicon.where("gloss is not null").select("gloss").distinct().withColumn("bucket", F.pmod(X.fnv_bytes(F.col("gloss")), F.lit(buckets)))
    return distinct.withColumn("gloss_ix", F.row_number().over(Window.partitionBy("bucket").orderBy("gloss")) - 1)


def gloss_index(lexicon: DataFrame) -> DataFrame:
    """Distinct glosses with one dense index in byte order over the whole table."""
    return X.ranked(lexicon.where("gloss is not null").select("gloss").distinct(), ["gloss"], "gloss_ix")


def with_gloss_index(lexicon: DataFrame, glosses: DataFrame) -> DataFrame:
    """lexicon with gloss_ix, a reference into the gloss index, in place of the glosses themselves."""
    return lexicon.join(X.small(glosses), "gloss", "left").drop("gloss")


OPTIONAL = {"gloss": "string", "gloss_ref": "string", "gloss_ix": "bigint", "lexical_ref": "string", "dataset_id": "string", "simplified": "string", "pinyin": "string"}


def complete(lexicon: DataFrame) -> DataFrame:
    """lexicon with nulls for the optional columns that it lacks."""
    return lexicon.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in lexicon.columns})


def bucket_of(locale: Column, norm: Column, buckets: int) -> Column:
    """English routes on the surface, Chinese on its first code point."""
    key = F.when(locale == "zh-Hant", F.substring(norm, 1, 1)).otherwise(norm)
    return F.pmod(X.fnv_bytes(key), F.lit(buckets)).cast("int")


def bucketed(lexicon: DataFrame, buckets: int = 64) -> DataFrame:
    if not 1 <= buckets <= 4096:
        raise ValueError("buckets: 1 to 4096")
    return lexicon.withColumn("bucket", bucket_of(F.col("locale"), F.col("norm"), buckets))


def write_buckets(lexicon: DataFrame, path: str, buckets: int = 64) -> None:
    """Parquet by locale and bucket, in canonical order inside each."""
    dealt = bucketed(lexicon, buckets).repartition("locale", "bucket").sortWithinPartitions("locale", "bucket", "norm", "pos", "lexical_ref")
    dealt.write.mode("overwrite").partitionBy("locale", "bucket").parquet(path)


def needed_norms(types: DataFrame, exceptions: DataFrame) -> DataFrame:
    """norm of every English row that analyses of types(norm) may look up: their own, their exceptions' and their regular lemmas'."""
    own = types.select("norm")
    regular = own.select(F.explode(X.inflection_candidates(F.col("norm"))).alias("c")).select(F.col("c.lemma").alias("norm"))
    irregular = own.join(exceptions.select(F.col("inflected").alias("norm"), "lemma"), "norm").select(F.col("lemma").alias("norm"))
    return own.unionByName(regular).unionByName(irregular).distinct()


def stored_rows(spark: SparkSession, path: str, norms: DataFrame, buckets: int = 64, locale: str = "en", schema=None) -> DataFrame:
    """Rows of a stored lexicon (write_buckets) in the buckets that norms(norm) fall into, and in no others.

    The set of buckets, 4096 at most, is told to the reader as a list, so that partitions of other buckets aren't listed or
    read. schema, if given, is that of the stored rows; else a file is opened to ask for it.
    """
    if not 1 <= buckets <= 4096:
        raise ValueError("buckets: 1 to 4096")
    asked = norms.select(bucket_of(F.lit(locale), F.col("norm"), buckets).alias("bucket")).distinct().collect()
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(path).where(F.col("locale") == locale)
    return rows.where(F.col("bucket").isin(sorted(r["bucket"] for r in asked))) if asked else rows.limit(0)


HASHED = ["norm", "lemma", "pos", "confidence", "lexical_ref"]
PARTS = 4  # 60-bit parts of a row's hash that are summed


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def hash_sums(columns: list[str]) -> list[Column]:
    """Sums of a row's hash in four parts, h0 to h3: partial sums combine, and inserts and deletes add and subtract."""
    whole = row_hash(columns)
    part = lambda i: F.conv(F.substring(whole, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return [F.sum(part(i)).cast("decimal(38,0)").alias(f"h{i}") for i in range(PARTS)]


def content_hash() -> Column:
    """One hash of n_rows and the sums."""
    return F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), *(F.col(f"h{i}").cast("string") for i in range(PARTS))), 256)


def manifest(lexicon: DataFrame, buckets: int = 64) -> DataFrame:
    """locale, bucket, n_rows and an order-independent content hash of each bucket."""
    return content(bucketed(lexicon, buckets))


def content_sums(rows: DataFrame) -> DataFrame:
    """locale, bucket, n_rows and the sums h0 to h3 of rows that have their bucket."""
    return rows.groupBy("locale", "bucket").agg(F.count("*").alias("n_rows"), *hash_sums(HASHED))


def content(rows: DataFrame) -> DataFrame:
    """locale, bucket, n_rows, content_hash of rows that have their bucket."""
    return content_sums(rows).select("locale", "bucket", "n_rows", content_hash().alias("content_hash"))


def changed_sums(sums: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The content sums of a table after rows with their buckets were inserted and deleted, without reading the table.

    Buckets that are left without rows go.
    """
    names = ["n_rows", *(f"h{i}" for i in range(PARTS))]
    minus = content_sums(deleted).select("locale", "bucket", *((-F.col(c)).alias(c) for c in names))
    every = sums.unionByName(content_sums(inserted)).unionByName(minus).groupBy("locale", "bucket")
    kind = lambda c: "long" if c == "n_rows" else "decimal(38,0)"
    return every.agg(*(F.sum(c).cast(kind(c)).alias(c) for c in names)).where("n_rows > 0")


def index_hash(index: DataFrame) -> str:
    """One content hash of a whole index."""
    return index.agg(F.count("*").alias("n_rows"), *hash_sums(HASHED)).select(content_hash().alias("h")).first()["h"]


def unlike(indexes: list[DataFrame]) -> list[DataFrame]:
    """indexes without those whose content an earlier one has."""
    found: dict[str, DataFrame] = {}
    for index in indexes:
        found.setdefault(index_hash(complete(index)), index)
    return list(found.values())


def bucket_violations(stored: DataFrame, declared: DataFrame, buckets: int = 64) -> DataFrame:
    """locale, bucket, code where a stored table with its bucket column departs from its declared manifest.

    BUCKET_ID: rows that belong elsewhere; COUNT, HASH: rows other than declared; MISSING, UNDECLARED: on one side only.
    """
    routed = stored.withColumn("_own", bucket_of(F.col("locale"), F.col("norm"), buckets))
    wrong = routed.where(~F.col("_own").eqNullSafe(F.col("bucket"))).select("locale", "bucket", F.lit("BUCKET_ID").alias("code")).distinct()
    found = content(stored)
    names = lambda df, by: df.select("locale", "bucket", F.col("n_rows").alias(f"{by}_n"), F.col("content_hash").alias(f"{by}_h"))
    both = names(found, "f").join(names(declared, "d"), ["locale", "bucket"], "full_outer")
    code = F.when(F.col("f_n").isNull(), F.array(F.lit("MISSING"))).when(F.col("d_n").isNull(), F.array(F.lit("UNDECLARED"))).otherwise(F.array_compact(F.array(F.when(F.col("f_n") != F.col("d_n"), F.lit("COUNT")), F.when(~F.col("f_h").eqNullSafe(F.col("d_h")), F.lit("HASH")))))
    return both.select("locale", "bucket", F.explode(code).alias("code")).unionByName(wrong)


def root_hash(buckets: DataFrame) -> DataFrame:
    """One hash over all buckets' hashes; as many rows as there are buckets go into it, 8192 at most."""
    line = F.concat_ws(":", "locale", F.col("bucket").cast("string"), "content_hash")
    return buckets.agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("root_hash"))


def differences(rebuilt: DataFrame, published: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds; none: the published table verifies."""
    columns = rebuilt.columns
    missing = rebuilt.exceptAll(published.select(columns)).withColumn("side", F.lit("missing"))
    return missing.unionByName(published.select(columns).exceptAll(rebuilt).withColumn("side", F.lit("extra")))


def merge_entries(entries: DataFrame) -> DataFrame:
    """One row for each entry_id; conflict tells whether its rows differ in content."""
    hashed = entries.withColumn("h", row_hash([c for c in entries.columns if c != "entry_id"]))
    return hashed.groupBy("entry_id").agg(F.count("*").alias("n_rows"), (F.min("h") != F.max("h")).alias("conflict"))


def duplicate_records(records: DataFrame, content: list[str]) -> DataFrame:
    """Records whose content an earlier line holds, with that line's number."""
    first = records.groupBy(*content).agg(F.min("line_number").alias("first_line"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content]
    renamed = first.select(*(F.col(c).alias(f"_{c}") for c in content), "first_line")
    joined = records.join(renamed, same).drop(*(f"_{c}" for c in content))
    return joined.where("line_number > first_line").withColumn("code", F.lit("DUPLICATE_RECORD"))


def integrity_violations(lexicon: DataFrame, datasets: DataFrame) -> DataFrame:
    """code, n of lexicon rows that break a rule: part of speech, confidence, references, datasets."""
    codes = F.filter(F.array(F.when(~F.coalesce(F.col("pos").isin(W.POS_ORDER), F.lit(False)), F.lit("POS")), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), F.lit("CONFIDENCE")), F.when(F.col("lexical_ref").isNull(), F.lit("LEXICAL_REF")), F.when(F.coalesce("norm", F.lit("")) == "", F.lit("SURFACE"))), lambda c: c.isNotNull())
    own = lexicon.select(F.explode(codes).alias("code"))
    lost = lexicon.where("dataset_id is not null").join(datasets.select("dataset_id").distinct(), "dataset_id", "left_anti").select(F.lit("DATASET").alias("code"))
    return own.unionByName(lost).groupBy("code").agg(F.count("*").alias("n"))


def order_violations(rows: DataFrame, keys: list[str], partition: list[str]) -> DataFrame:
    """Rows that stand before their predecessor in a declared order (column ix)."""
    here, prior = F.struct(*keys), F.lag(F.struct(*keys)).over(Window.partitionBy(*partition).orderBy("ix"))
    return rows.withColumn("prior", prior).where(F.col("prior") > here).drop("prior")


def _edges(keys: list[str]):
    """Streams a scan: rows that stand before their predecessor in their file, and the first and last row of each stretch of a file."""
    def run(batches):
        path, row, key, out = None, None, None, []

        def close():
            return [(path, row, key, 2)] if path is not None else []

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in keys]
            for p, r, *k in zip(batch.column("_path").to_pylist(), batch.column("_row").to_pylist(), *columns):
                k = [[v is not None, str(v) if v is not None else ""] for v in k]
                if p != path or r != row + 1:
                    out += close() + [(p, r, k, 1)]
                elif key > k:
                    out.append((p, r, k, 0))
                path, row, key = p, r, k
            if out:
                yield _edge_batch(out)
                out = []
        if path is not None:
            yield _edge_batch(close())

    return run


def _edge_batch(rows: list) -> pa.RecordBatch:
    paths, numbers, keys, kinds = zip(*rows)
    texts = [[v if there else None for there, v in k] for k in keys]
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(numbers, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.int32())], names=["path", "row", "key", "kind"])


def file_order_violations(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """path, row, key of stored rows that stand before their predecessor: in their file, or in the file before by name.

    Files are scanned where they lie: order inside them follows the reader's own row numbers, and only the first and
    last row of each stretch of a file that a task has read meet, ordered by file and row, which are a few for each file. Keys are
    compared as strings of code points, nulls first; null files don't exist.
    """
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"), *(F.col(c).cast("string").alias(c) for c in keys))
    found = X.settled(rows.mapInArrow(_edges(keys), "path string, row long, key array<string>, kind int"))
    ends = found.where("kind > 0").select("path", "row", "key", "kind")
    order = Window.orderBy("path", "row", "kind")  # two rows for each stretch of a file
    marked = lambda k: F.transform(k, lambda v: F.struct(v.isNotNull().alias("there"), F.coalesce(v, F.lit("")).alias("v")))
    before = F.lag("key").over(order)
    borders = ends.withColumn("before", before).where((F.col("kind") == 1) & F.col("before").isNotNull() & (marked(F.col("before")) > marked(F.col("key"))))
    return found.where("kind = 0").unionByName(borders.drop("before")).select("path", "row", "key")


def synthetic(spark: SparkSession, n: int = 20_000) -> DataFrame:
    """n made-up rows, nouns and verbs in turn, to size a lexicon's storage."""
    ids = spark.range(n)
    name = F.concat(F.lit("term"), F.lpad(F.col("id").cast("string"), 6, "0"))
    pos = F.when(F.col("id") % 2 == 0, "n").otherwise("v")
    return ids.select(name.alias("norm"), F.lit("en").alias("locale"), name.alias("surface"), name.alias("lemma"), pos.alias("pos"), F.lit(1.0).alias("confidence"), F.concat(F.lit("gloss of "), name).alias("gloss"), F.concat(F.lit("synthetic-gloss:"), name).alias("gloss_ref"), F.concat(F.lit("synthetic:"), name).alias("lexical_ref"), F.lit("synthetic").alias("dataset_id"), F.lit("verified").alias("tier"))
