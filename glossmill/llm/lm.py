"""Language-model scores by stupid backoff, computed relationally over the whole corpus.

Two count tables: words with their counts, and bigrams with their counts and whether two documents hold them. A
bigram scores count(first second) / count(first) if at least two documents hold it, so that no document vouches
for itself alone, else BACKOFF * count(second) / all words; the first word of a text scores count / all words.
Numerators and denominators are counts over the whole corpus.

A text's score is the sum of its backed-off scores plus, for each seen bigram, what seeing it adds. That addend
depends on the bigram only, so it is a column of the bigram table: exploded bigrams are partitioned by hash once, the
table is aggregated on that partitioning, gets its words' counts, and joins the exploded bigrams where they lie.

Words are 64-bit hashes. A bigram of two is one bigint: a word's id is the low 31 bits of its hash, or, where a
smaller hash has the same, bit 31 and the next 31 bits. Moved words are a counted broadcast; where they are more than
MOVED_ROWS, or two ids still meet, both whole hashes are the key instead. Either way no two words share a count.

Frequent bigrams are found first, by approx_top_k over a sixteenth of the documents. The pass that counts words counts
them too, exactly and over all documents; their addends are a broadcast of HOT_BIGRAMS rows at most, taken up where the
words' logarithms are summed. So they are never dealt, and no task gets all rows of one. The sketch only says which
bigrams go this way. Word counts join by broadcast behind a count of their rows, else by shuffle with words of a large share
(SHARES at most, by their exact counts) broadcast. Words that occur once need no row: their logarithm is 0.

Defined cases: null, empty and blank texts have no words, score 0 and a null mean; a text of one word has a unigram
score only; rows that repeat a doc_id are one document; rows with a null doc_id are one document under null; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut_words, stored

BACKOFF = 0.4
HOT_BIGRAMS = 2000
BROADCAST_ROWS = 3_000_000
MOVED_ROWS = 1_000_000
SHARES = 10_000
LOW = (1 << 31) - 1
NOBODY = -(1 << 63)  # stands for a null doc_id


def word_pairs(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns in carry, and the hashes first of every word and second of the word after it, null at a text's end.

    Texts are cut once and hashed after the explode, as compiled code. An outer explode, for a plain one lets the
    optimizer cut each text a second time, to filter empty arrays.
    """
    cut = docs.select(*carry, F.array_remove(cut_words(F.col("text")), "").alias("words"))
    pairs = F.arrays_zip("words", F.slice("words", F.lit(2), F.size("words")))
    rows = cut.select(*carry, F.inline_outer(pairs).alias("word", "after")).where("word IS NOT NULL")
    return rows.select(*carry, F.xxhash64("word").alias("first"), F.when(F.col("after").isNotNull(), F.xxhash64("after")).alias("second"))


def pair_hash(first: str = "first") -> Column:
    """One hash for a bigram, null where there is no second word."""
    return F.when(F.col("second").isNotNull(), F.xxhash64(first, "second"))


def hot_bigrams(docs: DataFrame) -> DataFrame:
    """hot: hashes of bigrams that are frequent in a sixteenth of the documents, HOT_BIGRAMS at most."""
    part = word_pairs(docs.where(F.pmod(F.xxhash64("doc", "text"), F.lit(16)) == 0)).where("second IS NOT NULL").select(pair_hash().alias("pair"))
    top = part.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(pair, {HOT_BIGRAMS}, {HOT_BIGRAMS * 20})").alias("top"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.greatest(F.col("n") * 1e-4, F.lit(100))).select(F.col("t.item").alias("hot"))


def word_counts(docs: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """word, f of every word; with hot bigrams a word's rows before one stand apart, with second (else 0) and the documents low and high."""
    rows = word_pairs(docs, *([] if hot is None else ["doc"]))
    if hot is None:
        return rows.groupBy(F.col("first").alias("word")).agg(F.count("*").alias("f"))
    met = rows.join(F.broadcast(hot), pair_hash() == F.col("hot"), "left")
    met = met.select(F.col("first").alias("word"), F.coalesce(F.when(F.col("hot").isNotNull(), F.col("second")), F.lit(0).cast("long")).alias("second"), F.when(F.col("hot").isNotNull(), F.col("doc")).alias("doc"))
    return met.groupBy("word", "second").agg(F.count("*").alias("f"), F.min("doc").alias("low"), F.max("doc").alias("high"))


def moved_words(counts: DataFrame) -> DataFrame | None:
    """word, id of words whose low bits belong to a smaller hash; None where ids don't tell all words apart."""
    place = F.row_number().over(Window.partitionBy(F.col("word").bitwiseAND(F.lit(LOW).cast("long"))).orderBy("word"))
    other = F.shiftrightunsigned("word", 31).bitwiseAND(F.lit((1 << 31) - 1).cast("long")).bitwiseOR(F.lit(1 << 31).cast("long"))
    moved = stored(counts.withColumn("place", place).where("place > 1").select("word", other.alias("id")), "moved-words")
    few, ids = moved.limit(MOVED_ROWS + 1).agg(F.count("*"), F.countDistinct("id")).first()
    return moved if few <= MOVED_ROWS and few == ids else None


def with_ids(rows: DataFrame, moved: DataFrame | None, column: str) -> DataFrame:
    """rows with a word's hash replaced by its id; without a table of moved words the hash is the id."""
    if moved is None:
        return rows
    own = F.broadcast(moved.select(F.col("word").alias("_word"), F.col("id").alias("_id")))
    return rows.join(own, F.col(column) == F.col("_word"), "left").withColumn(column, F.coalesce("_id", F.col(column).bitwiseAND(F.lit(LOW).cast("long")), F.lit(0).cast("long"))).drop("_word", "_id")


def hot_gains(parts: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """hot, gain: what seeing a hot bigram adds, null where one document holds all of it. A hash that two bigrams share is not hot."""
    same = parts.where("second <> 0").groupBy(pair_hash("word").alias("hot"))
    rows = same.agg(F.count("*").alias("pairs"), *[F.min(c).alias(name) for c, name in (("word", "first"), ("second", "second"), ("f", "c"), ("low", "low"), ("high", "high"))]).where("pairs = 1")
    few = counts.join(F.broadcast(rows.select(F.explode(F.array("first", "second")).alias("word"))), "word", "left_semi")
    for column in ("first", "second"):
        rows = rows.join(F.broadcast(few.select(F.col("word").alias(column), F.log("f").alias(f"log_{column}"))), column)
    return rows.select("hot", F.when(F.col("low") < F.col("high"), gain(n)).alias("gain"))


def gain(n: int) -> Column:
    return F.log("c") - F.col("log_first") - F.col("log_second") + math.log(max(n, 1)) - math.log(BACKOFF)


def dealt_bigrams(docs: DataFrame, hot: DataFrame, moved: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """doc and key of every bigram that is not hot, partitioned by key: gram where ids fit into one bigint, else first and second."""
    rows = word_pairs(docs, "doc").where("second IS NOT NULL").join(F.broadcast(hot), pair_hash() == F.col("hot"), "left_anti")
    rows = rows.withColumn("second", F.coalesce("second", F.lit(0).cast("long")))
    if moved is None:
        return rows.repartition("first", "second"), ["first", "second"]
    rows = with_ids(with_ids(rows, moved, "first"), moved, "second")
    return rows.select("doc", F.coalesce(F.shiftleft("first", 32).bitwiseOR(F.col("second")), F.lit(0).cast("long")).alias("gram")).repartition("gram"), ["gram"]


def add_logs(rows: DataFrame, counts: DataFrame, column: str, name: str, n: int, small: bool, spread: Column) -> DataFrame:
    """rows with name: the logarithm of the count of the word in a column, 0 where counts(word, f) has no row."""
    table = counts.select(F.col("word").alias("_w"), F.log("f").alias("_l"))
    if small:
        return rows.join(F.broadcast(table), F.col(column) == F.col("_w"), "left").withColumn(name, F.coalesce("_l", F.lit(0.0))).drop("_w", "_l")
    frequent = F.broadcast(counts.where(F.col("f") * SHARES > n).select(F.col("word").alias("_h"), F.log("f").alias("_hl")))
    met = rows.join(frequent, F.col(column) == F.col("_h"), "left")
    # A frequent word's rows need no partner: they spread by another value.
    met = met.withColumn("_k", F.when(F.col("_h").isNull(), F.col(column)).otherwise(F.xxhash64(spread)))
    met = met.join(table, (F.col("_k") == F.col("_w")) & F.col("_h").isNull(), "left")
    return met.withColumn(name, F.coalesce("_hl", "_l", F.lit(0.0))).drop("_w", "_l", "_h", "_hl", "_k")


def seen_sums(docs: DataFrame, counts: DataFrame, hot: DataFrame, n: int, small: bool) -> DataFrame:
    """doc, n_seen, gain: how many bigrams of a document, hot ones aside, are seen, and what they add to its score."""
    moved = moved_words(counts)
    rows, key = dealt_bigrams(docs, hot, moved)
    table = rows.groupBy(*key).agg(F.count("*").alias("c"), F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    if moved is not None:
        table = table.withColumns({"first": F.shiftrightunsigned("gram", 32), "second": F.col("gram").bitwiseAND(F.lit((1 << 32) - 1))})
    logs = with_ids(counts.where("f > 1"), moved, "word")
    for column in ("first", "second"):
        table = add_logs(table, logs, column, f"log_{column}", n, small, F.concat_ws(" ", *key))
    met = rows.join(table.select(*key, gain(n).alias("gain")).hint("shuffle_hash"), key)
    return met.groupBy("doc").agg(F.count("*").alias("n_seen"), F.sum("gain").alias("gain"))


def word_sums(docs: DataFrame, counts: DataFrame, hot: DataFrame, n: int, small: bool) -> DataFrame:
    """doc, n_words, n_pairs, logs, hot_seen, hot_gain of documents with words: sums over words and over hot bigrams."""
    rows = word_pairs(docs, "doc").join(F.broadcast(hot), pair_hash() == F.col("hot"), "left")
    rows = rows.select("doc", F.col("first").alias("word"), F.col("second").isNotNull().cast("int").alias("pair"), "gain")
    met = add_logs(rows, counts.where("f > 1"), "word", "log", n, small, F.col("doc"))
    return met.groupBy("doc").agg(F.count("*").alias("n_words"), F.sum("pair").alias("n_pairs"), F.sum("log").alias("logs"), F.count("gain").alias("hot_seen"), F.sum("gain").alias("hot_gain"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_seen, log_score, mean_log_score for docs(doc_id, text)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc"), "text")
    parts = stored(word_counts(docs, stored(hot_bigrams(docs), "hot-bigrams")), "word-parts")
    counts = stored(parts.groupBy("word").agg(F.sum("f").alias("f")), "word-counts")
    n = counts.agg(F.sum("f")).first()[0] or 0
    small = counts.where("f > 1").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hot = stored(hot_gains(parts, counts, n), "hot-gains")

    both = docs.select("doc").distinct().join(word_sums(docs, counts, hot, n, small), "doc", "left").join(seen_sums(docs, counts, hot, n, small), "doc", "left").na.fill(0)
    score = F.col("logs") - F.col("n_words") * math.log(max(n, 1)) + F.col("n_pairs") * math.log(BACKOFF) + F.col("gain") + F.col("hot_gain")
    return both.select(F.nullif(F.col("doc"), F.lit(NOBODY)).alias("doc_id"), "n_words", (F.col("n_seen") + F.col("hot_seen")).alias("n_seen"), F.round(score, 4).alias("log_score"), F.round(score / F.nullif(F.col("n_words"), F.lit(0)), 6).alias("mean_log_score"))


def query(spark, sf_dir):
    from .common import table

    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
  FROM documents
), t AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS w FROM w),
u AS (SELECT w, count(*) AS f FROM t GROUP BY w),
n AS (SELECT count(*) AS n FROM t),
b AS (SELECT doc_id, w1, w2, count(*) AS own FROM (
  SELECT doc_id, w AS w1, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM t) WHERE w2 IS NOT NULL GROUP BY ALL),
g AS (SELECT w1, w2, sum(own) AS c, count(*) > 1 AS seen FROM b GROUP BY ALL),
s AS (SELECT doc_id, sum(own * CASE WHEN seen THEN ln(c / u1.f) ELSE ln(0.4 * u2.f / n.n) END) AS s,
             sum(CASE WHEN seen THEN own ELSE 0 END) AS n_seen
      FROM b JOIN g USING (w1, w2) JOIN u u1 ON u1.w = w1 JOIN u u2 ON u2.w = w2 CROSS JOIN n GROUP BY doc_id),
h AS (SELECT doc_id, ln(u.f / n.n) AS first FROM t JOIN u USING (w) CROSS JOIN n WHERE i = 1),
r AS (SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen,
             coalesce(first, 0) + coalesce(s, 0) AS score
      FROM w LEFT JOIN s USING (doc_id) LEFT JOIN h USING (doc_id))
SELECT doc_id, n_words, n_seen, round(score, 4) AS log_score,
       round(score / CASE WHEN n_words > 0 THEN n_words END, 6) AS mean_log_score
FROM r
"""
