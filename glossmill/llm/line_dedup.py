"""Exact line deduplication over a corpus.

Lines become pairs of 64-bit hashes, which are range-partitioned and sorted by hash, document and
position. A running first value over that order marks each line whose key a smaller doc_id holds.
What comes back is a run-length-coded bitmap of kept lines for each document that loses any; text moves only
where a caller applies more bitmaps than can be broadcast.

A key that very many lines share would fill one range. approx_top_k finds the keys that hold over an eighth of a
partition's share of lines without a shuffle (fewer than eight for each partition can); their rows are dealt over
slices, each slice streams its own first document, and the least document of a hot key, one row for each of at most
HOT_KEYS keys, is broadcast to settle between slices. The sketch only steers the dealing: results don't depend on
what it finds.

Defined cases: a null or empty text is one empty line; rows with a null doc_id neither hold nor lose
lines; rows that repeat a doc_id are one document for the rule and keep their own texts; ties between
equal lines of a document all stay in its own text; extra columns are kept, but n_lines, n_dropped, keep_runs and
kept_text are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, ascii_lower, let, stored, text_key

HOT_KEYS = 20_000  # rows of the broadcast table at most
BROADCAST_ROWS, BROADCAST_RUNS = 500_000, 2_000_000  # bitmaps of so many documents and runs at most are broadcast


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_key, pos, h1, h2 of every line that takes part."""
    line = docs.where("doc_id is not null").select("doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    key = line.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return key.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_key, pos of every line whose key a document with a smaller doc_id holds."""
    lines = stored(line_hashes(docs, min_chars), "lines")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, slices = min(HOT_KEYS, 8 * max(partitions, 125)), 2 * partitions
    top = lines.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {keys}, {keys * 20})").alias("top"))
    hot = top.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.greatest(F.col("n") / keys, F.lit(100))).select(F.col("t.item").alias("h1"))
    hot = stored(hot, "hot-lines")  # at most HOT_KEYS rows
    of_hot = lines.join(F.broadcast(hot), "h1", "left_semi").groupBy("h1", "h2").agg(F.min("doc_id").alias("hot_first"))
    dealt = lines.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "h1", "left").withColumn("slice", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(slices))).otherwise(F.lit(0)))
    ranged = dealt.repartitionByRange("h1", "h2", "slice").sortWithinPartitions("h1", "h2", "slice", "doc_id", "pos")
    order = Window.partitionBy("h1", "h2", "slice").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = ranged.withColumn("first", F.first("doc_id").over(order))
    of_hot = F.broadcast(of_hot.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "hot_first"))  # a row for each hot key
    settled = firsts.join(of_hot, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("is_hot"), "left")
    return settled.where(F.col("doc_id") > F.least("first", "hot_first")).select("doc_id", "text_key", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, text_key, n_dropped, keep_runs of documents that lose lines: runs [start, stop) of kept ones.

    The last run has a null stop and goes to the end of the text, if there is more.
    """
    dropped = dropped_lines(docs, min_chars).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("pos"))
    first = F.filter("pos", lambda x, i: (i == 0) | (F.get("pos", i - 1) != x - 1))
    last = F.filter("pos", lambda x, i: (i == F.size("pos") - 1) | (F.get("pos", i + 1) != x + 1))
    starts = F.concat(F.array(F.lit(0)), F.transform(last, lambda x: x + 1))
    runs = F.zip_with(starts, F.concat(first, F.array(F.lit(None).cast("int"))), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    kept = F.filter(runs, lambda r: r["stop"].isNull() | (r["start"] < r["stop"]))
    return dropped.select("doc_id", "text_key", F.size("pos").cast("long").alias("n_dropped"), kept.alias("keep_runs"))


def kept_text(text: Column, keep_runs: Column) -> Column:
    """The lines of a text in keep_runs; null runs keep all."""
    cut = lambda lines: F.transform(keep_runs, lambda r: F.slice(lines, r["start"] + 1, F.greatest(F.coalesce(r["stop"], F.size(lines)) - r["start"], F.lit(0))))
    return F.when(keep_runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(text_lines(text), lambda lines: F.array_join(F.flatten(cut(lines)), "\n")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; docs need doc_id and text.

    Bitmaps are stored and counted: few are broadcast, so that no text moves; more are joined by document.
    """
    bitmaps = stored(bitmaps, "keep-bitmaps")
    rows, runs = bitmaps.agg(F.count("*"), F.coalesce(F.sum(F.size("keep_runs")), F.lit(0))).first()
    marks = bitmaps.select(F.col("doc_id").alias("bitmap_doc"), F.col("text_key").alias("bitmap_key"), "n_dropped", "keep_runs")
    marks = F.broadcast(marks) if rows <= BROADCAST_ROWS and runs <= BROADCAST_RUNS else marks
    own = docs.drop("n_lines", "n_dropped", "keep_runs", "kept_text", "bitmap_doc", "bitmap_key")
    both = own.join(marks, (F.col("doc_id") == F.col("bitmap_doc")) & (text_key(F.col("text")) == F.col("bitmap_key")), "left").drop("bitmap_doc", "bitmap_key")
    return both.withColumns({"n_lines": F.size(text_lines(F.col("text"))).cast("long"), "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long")), "kept_text": kept_text(F.col("text"), F.col("keep_runs"))}).drop("keep_runs")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))


def query(spark, sf_dir):
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key
), m AS (
  SELECT k.doc_id, k.pos, k.line, (length(k.key) >= 10 AND k.doc_id > f.first_doc) AS gone
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
