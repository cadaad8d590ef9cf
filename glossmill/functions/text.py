"""Column expressions over text: hashing, tokens, languages, rules for English forms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import words as W

TOKEN = r"[A-Za-z]+(?:['’][A-Za-z]+)*"
HAN = r"\p{IsHan}"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row even where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where unset, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """df computed once for the several uses that follow: written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with its place (from 0) in the order of by, without a window over the whole table.

    Rows are dealt by ranges and sorted in each partition, then written with the partition's number and their place in
    it; the partitions' counts, a row for each, are summed up and broadcast. Rows equal in by are in no order.
    """
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = settled(dealt.withColumns({"_block": F.spark_partition_id(), "_place": place}))
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("_block", before.alias("_before"))), "_block").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def by_key(df: DataFrame, key: str) -> DataFrame:
    """df exchanged by key into as many partitions as the session shuffles to; few bytes of text make many rows, so they aren't coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def small(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """table, marked for broadcast if it has so many rows at most; for settled tables, which are counted at no cost."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


_BASIS = 2166136261


def _fnv_step(h: Column, unit: Column) -> Column:
    return (h.bitwiseXOR(unit) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))


def _fnv(text: Column, charset: str, width: int) -> Column:
    """32-bit FNV-1a over units of so many bytes of text in a charset.

    ASCII texts, whose units are their signs, are split into them; of others the bytes are cut by place, which takes
    constant time in a binary.
    """
    def of(d):
        unit = lambda i: F.conv(F.hex(F.substring(d, width * i + 1, F.lit(width))), 16, 10).cast("long")
        n = (F.octet_length(d) / width).cast("int")
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(_BASIS).cast("long"), lambda h, i: _fnv_step(h, unit(i)))).otherwise(F.lit(_BASIS).cast("long"))

    signs = F.aggregate(F.split(text, ""), F.lit(_BASIS).cast("long"), lambda h, c: _fnv_step(h, F.ascii(c).cast("long")))
    return F.when(text == "", F.lit(_BASIS).cast("long")).when(F.octet_length(text) == F.char_length(text), signs).when(text.isNotNull(), let(F.encode(text, charset), of))


def fnv_bytes(text: Column) -> Column:
    """32-bit FNV-1a over UTF-8 bytes, as a long."""
    return _fnv(text, "UTF-8", 1)


def fnv_units(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a long."""
    return _fnv(text, "UTF-16BE", 2)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def normalize_english(surface: Column) -> Column:
    """Lower case; English tokens hold nothing that NFC would change."""
    return F.lower(surface)


def detect_language(text: Column, variant: str = "engine") -> Column:
    """counts: zh/en/both/unknown; sentence: zh-Hant for zh; engine: both where neither script occurs."""
    if variant not in ("counts", "sentence", "engine"):
        raise ValueError(f"no such variant: {variant}")
    en, zh = text.rlike("[A-Za-z]"), text.rlike(HAN)
    one = "zh" if variant == "counts" else "zh-Hant"
    none = "both" if variant == "engine" else "unknown"
    return F.when(en & zh, "both").when(zh, one).when(en, "en").otherwise(none)


def estimate_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HAN)) + F.regexp_count(text, F.lit("[A-Za-z]+(?:['’-][A-Za-z]+)*"))


def tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """English tokens with code-point offsets: key, ix, surface, norm, start, end, boundary, clause_break.

    Only the gap lengths and gap flags go through the explode, never the text. Texts are exchanged by key before it,
    so the offsets, and windows by key that follow, need no exchange of token rows. boundary and clause_break
    tell whether the gap before a token holds a terminator (ASCII ones, or with full-width ones).
    """
    docs = by_key(docs.select(key, "text"), key)
    text = F.coalesce("text", F.lit(""))
    found, gaps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
    spots = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda t, g: F.struct(t.alias("surface"), F.char_length(g).alias("gap"), g.rlike("[.!?]").alias("boundary"), g.rlike("[.!?。！？]").alias("clause_break")))
    rows = docs.select(key, F.posexplode(spots).alias("ix", "t")).select(key, "ix", "t.*")
    order = Window.partitionBy(key).orderBy("ix")
    end = F.sum(F.col("gap") + F.char_length("surface")).over(order).cast("int")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("surface"))
    later = F.col("ix") > 0
    return placed.select(key, "ix", "surface", normalize_english(F.col("surface")).alias("norm"), "start", "end", (later & F.col("boundary")).alias("boundary"), (later & F.col("clause_break")).alias("clause_break"))


def types(docs: DataFrame) -> DataFrame:
    """norm, n: how often each English token occurs; nothing but counts is exchanged."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))
    return docs.select(F.explode(found).alias("surface")).groupBy(normalize_english(F.col("surface")).alias("norm")).agg(F.count("*").alias("n"))


def append(state: Column, item: Column, block: int = 64) -> tuple[Column, Column]:
    """The fields last and full of a fold's state with one item more.

    A fold that appends to one array copies it at each step; blocks are copied only while they are short.
    """
    whole = F.size(state["last"]) >= block
    last = F.when(whole, F.array(item)).otherwise(F.concat(state["last"], F.array(item)))
    return last, F.when(whole, F.concat(state["full"], F.array(state["last"]))).otherwise(state["full"])


def appended(state: Column) -> Column:
    """All items of a fold's state, in order."""
    return F.concat(F.flatten(state["full"]), state["last"])


def rule_pos(norm: Column, listed_pos: Column, listed_confidence: Column) -> tuple[Column, Column]:
    """pos and confidence of a lower-cased word: its list's, else by the suffix rules."""
    pos, confidence = F.when(listed_pos.isNotNull(), listed_pos), F.when(listed_pos.isNotNull(), listed_confidence)
    for pattern, least, tag, sure in W.SUFFIX_RULES:
        fits = norm.rlike(pattern) & (F.char_length(norm) >= least)
        pos, confidence = pos.when(fits, F.lit(tag)), confidence.when(fits, F.lit(sure))
    return pos.otherwise("x"), confidence.otherwise(0.25)


def priority(pos: Column, version: int = 3) -> Column:
    if version == 1:
        return F.when(pos.isin(W.OPEN_CLASS), 0.85).when(pos.isin(W.CLOSED_CLASS), 0.65).otherwise(0.2)
    table = F.create_map(*(F.lit(x) for item in W.PRIORITY.items() for x in item))
    return F.coalesce(table[pos], F.lit(W.PRIORITY["x"]))


def pos_rank(pos: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(W.POS_ORDER), pos), F.lit(0)), F.lit(99)).cast("int")


def gloss_cue_pos(glosses: Column) -> tuple[Column, Column]:
    """v at .55 where all glosses start with `to`, else x at 0."""
    verbs = (F.size(glosses) > 0) & F.forall(glosses, lambda g: g.rlike(r"^to(\s|$)"))
    return F.when(verbs, "v").otherwise("x"), F.when(verbs, 0.55).otherwise(0.0)


def inflection_candidates(norm: Column) -> Column:
    """Distinct (lemma, kind) that a regularly inflected form may come from."""
    n = F.char_length(norm)
    cut = lambda k: F.substring(norm, F.lit(1), F.greatest(n - k, F.lit(0)))
    spot = lambda ok, lemma, kind: F.when(ok, F.struct(lemma.alias("lemma"), F.lit(kind).alias("kind")))
    double = r"([b-df-hj-np-tv-z])\1$"
    ing, ed = (n > 4) & norm.endswith("ing"), (n > 3) & norm.endswith("ed")
    all_of = F.array(
        spot((n > 3) & norm.endswith("ies"), F.concat(cut(3), F.lit("y")), "s"),
        spot((n > 3) & norm.rlike("(ches|shes|sses|xes|zes|oes)$"), cut(2), "s"),
        spot((n > 2) & norm.endswith("s") & ~norm.endswith("ss"), cut(1), "s"),
        spot(ing, cut(3), "ing"),
        spot(ing, F.concat(cut(3), F.lit("e")), "ing"),
        spot(ing & cut(3).rlike(double), cut(4), "ing"),
        spot(ed, cut(2), "ed"),
        spot(ed, F.concat(cut(2), F.lit("e")), "ed"),
        spot(ed & cut(2).rlike(double), cut(3), "ed"),
        spot(ed & norm.endswith("ied"), F.concat(cut(3), F.lit("y")), "ed"),
        spot((n > 4) & norm.endswith("est"), cut(3), "est"),
        spot((n > 3) & norm.endswith("er"), cut(2), "er"),
    )
    return F.array_distinct(F.filter(all_of, lambda c: c.isNotNull() & (c["lemma"] != norm) & c["lemma"].rlike("^[a-z]+(?:['’][a-z]+)*$")))


def morphology(kind: Column, pos: Column) -> Column:
    """The features of an inflection, or null where kind and part of speech don't go together."""
    def features(form, number=None, person=None, tense=None, degree=None):
        lit = lambda v, t: F.lit(v).cast(t)
        return F.struct(lit(form, "string").alias("form"), lit(number, "string").alias("number"), lit(person, "int").alias("person"), lit(tense, "string").alias("tense"), lit(degree, "string").alias("degree"))

    both = lambda k, p: (kind == k) & (pos == p)
    return (
        F.when(both("s", "n"), features("plural", "plural"))
        .when(both("s", "v"), features("third-person-singular", "singular", 3, "present"))
        .when(both("ing", "v"), features("present-participle"))
        .when(both("ed", "v"), features("past-or-participle"))
        .when(both("er", "adj"), features("comparative", degree="comparative"))
        .when(both("est", "adj"), features("superlative", degree="superlative"))
    )


CLOSERS = "\"'’”)\\]}〉》」』】〕〗〙〛"
SENTENCE = "[^\r\n.!?。！？]*[.!?。！？]+[" + CLOSERS + "]*|[^\r\n.!?。！？]+"


def mask_protected(text: Column, offsets: Column) -> Column:
    """text with the terminators at the given code-point offsets replaced, so that no sentence ends there."""
    return F.aggregate(F.coalesce(offsets, F.array().cast("array<int>")), text, lambda t, o: F.overlay(t, F.lit("_"), o + 1, F.lit(1)))


def sentences(docs: DataFrame, key: str = "doc_id", protected: str | None = None) -> DataFrame:
    """key, sent_ix, text, start, end, language of trimmed sentences, with code-point offsets.

    Each row carries its own sentence only. With protected offsets sentences are found in a masked text and
    cut from the original one, a second pass over the documents.
    """
    text = F.coalesce("text", F.lit(""))
    cut = mask_protected(text, F.col(protected)) if protected else text
    # As with tokens, texts are exchanged before the explode.
    rows = by_key(docs, key).select(key, F.regexp_extract_all(cut, F.lit(SENTENCE), F.lit(0)).alias("found"), F.split(cut, SENTENCE, -1).alias("gaps"))
    sizes = F.zip_with("found", F.slice("gaps", F.lit(1), F.size("found")), lambda s, g: F.struct(F.char_length(g).alias("gap"), F.char_length(s).alias("size"), F.char_length(F.regexp_extract(s, r"^(?U)\s*", 0)).alias("lead"), F.regexp_replace(s, r"^(?U)\s+|(?U)\s+$", "").alias("text")))
    spots = rows.select(key, F.posexplode(sizes).alias("i", "s")).select(key, "i", "s.*")
    order = Window.partitionBy(key).orderBy("i")
    placed = spots.withColumn("start", (F.sum(F.col("gap") + F.col("size")).over(order) - F.col("size") + F.col("lead")).cast("int")).where("text <> ''")
    out = placed.select(key, (F.row_number().over(order) - 1).alias("sent_ix"), "text", "start", (F.col("start") + F.char_length("text")).alias("end"))
    if protected:
        whole = docs.select(key, text.alias("whole"))
        out = out.join(whole, key).withColumn("text", F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))).drop("whole")
    return out.withColumn("language", detect_language(F.col("text"), "sentence"))
