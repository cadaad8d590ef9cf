"""A bounded sample of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ROWS, LEAST_ROWS, MOST_CHARS = 12_000, 8, 100_000


def labelled_sample(rows: DataFrame, label: str, per_label: int, labels: DataFrame | None = None) -> list:
    """About per_label rows of each label, chosen by a hash of the key, as a list of Row.

    rows: key, text and label columns without nulls in the label; or without a label, which labels(key, label) then gives, a row
    a key at most. Rows with a null key are not drawn. Bounds: every label is in the sample; with many
    labels each has fewer rows, so that about MOST_ROWS come, but LEAST_ROWS at least; more labels than MOST_ROWS /
    LEAST_ROWS are an error. Texts of up to MOST_CHARS characters are drawn whole; only a label that has none of them
    gives a stretch of so many characters from the middle of its texts.

    Rows are drawn by their keys and sizes alone; texts are read again for the drawn keys, which are broadcast, so no text
    is exchanged.
    """
    most_labels = MOST_ROWS // LEAST_ROWS
    own = rows if labels is not None else rows.drop(label)
    sizes = rows.select("key", F.char_length("text").alias("_size"), *([label] if labels is None else []))
    sizes = sizes if labels is None else sizes.join(labels.select("key", label), "key")
    fits = F.col("_size") <= MOST_CHARS
    counts = sizes.groupBy(label).agg(F.count("*").alias("n"), F.count_if(fits).alias("n_fit")).limit(most_labels + 1).collect()
    if not counts:
        return []
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels can't be learned from {MOST_ROWS} rows")
    per = max(LEAST_ROWS, min(per_label, MOST_ROWS // len(counts)))
    shares = [(r[label], min(1 << 20, -(-per * (1 << 20) // (r["n_fit"] or r["n"]))), r["n_fit"] == 0) for r in counts]
    kind = sizes.schema[label].dataType
    schema = T.StructType([T.StructField("_label", kind), T.StructField("_share", T.LongType()), T.StructField("_cut", T.BooleanType())])
    table = F.broadcast(rows.sparkSession.createDataFrame(shares, schema))
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("draw")), F.lit(1 << 20))
    most = 2 * per * len(counts)
    drawn = sizes.join(table, F.col(label) == F.col("_label")).where((draw < F.col("_share")) & (fits | F.col("_cut"))).select("key", label, "_cut", "_size").limit(most)
    keys = rows.sparkSession.createDataFrame(drawn.collect(), drawn.schema).distinct()
    met = own.withColumn("_size", F.char_length("text")).join(F.broadcast(keys), ["key", "_size"])  # most rows at most
    middle = F.substring(F.col("text"), (F.char_length("text") / 2 - MOST_CHARS / 2).cast("int") + 1, F.lit(MOST_CHARS))
    met = met.withColumn("text", F.when(F.col("_cut"), middle).otherwise(F.col("text"))).drop("_cut", "_size")
    return sorted(met.limit(most).collect(), key=lambda r: (str(r["key"]), str(r["text"])))


def remainder(doc_id, base: int):
    """crc32(doc_id as text) mod base; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(base))
