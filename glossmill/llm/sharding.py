"""A uniform shuffle of rows into shards of exact size, by a hypergeometric communication matrix.

Each partition is permuted where it lies, by a sort within the partition on random keys, and written once with its number
(block) and every row's place and rank, so that nothing later depends on how the stored files are split or on how often a
lost task is computed again. The driver draws how many rows go from each block to each shard from the multivariate
hypergeometric law with the blocks' counts as row sums and the shard sizes as column sums, so shard sizes are exact and
every assignment is equally likely. A block's first rows go to shard 0, the next to shard 1 and so on. The one exchange of
rows brings a shard's rows together, dealt over bins by a second random key so that a shard is never one task, and they
are permuted again inside: a slot is the bin's offset plus the place in the bin.

Random keys are hashes of the seed and a row's place, never of its content, so equal rows are dealt like any other and
no key is hot. The same partitions give the same shards; another layout of the table gives another draw.

Only counts reach the driver: a number for each partition (MOST_BLOCKS at most; of more it asks to be given larger
ones) and the matrix it draws.

Defined cases: null columns are values like any other; null texts have 0 bytes; an empty table gives no rows; repeated
rows get places of their own; input columns called shard or slot are replaced, all others are kept.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

MOST_BLOCKS = 65_536
BIN_ROWS = 1_000_000
NUMPY_TOTAL = 1_000_000_000  # numpy draws from fewer items than this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` items without replacement are good.

    Probabilities are taken relative to the mode's, as running products of the ratios of neighbours, which stay exact at
    any size; beyond 12 standard deviations they are below 1e-30.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    reach = 50 + int(12 * math.sqrt(draws * (good / total) * (bad / total) * max(0.0, (total - draws) / max(total - 1, 1))))
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    rising = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    falling = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    cumulated = np.cumsum(np.concatenate([falling[::-1], [1.0], rising]))
    return mode - len(falling) + int(np.searchsorted(cumulated, rng.random() * cumulated[-1], "right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows to send from each source to each shard; row sums are counts, column sums are sizes."""
    rng, left = np.random.default_rng(seed), np.array(sizes, np.int64)
    out = []
    for count in counts:
        if left.sum() < NUMPY_TOTAL:
            row = rng.multivariate_hypergeometric(left, count, method="marginals")
        else:
            row, rest, open_ = np.zeros(len(left), np.int64), count, int(left.sum())
            for j, free in enumerate(left.tolist()):
                open_ -= free
                row[j] = hypergeometric(rng, free, open_, rest)
                rest -= int(row[j])
        left = left - row
        out.append(row.tolist())
    return out


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """df's columns with shard and slot."""
    spark, own = df.sparkSession, [c for c in df.columns if c not in ("shard", "slot")]
    # The number of a row in its partition: before the sort its place, after it its rank in the permutation.
    number = F.monotonically_increasing_id()
    numbered = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(own))).withColumn("row", number)
    permuted = numbered.sortWithinPartitions(F.xxhash64(F.lit(seed + 1), "row"), "row")
    rows = stored(permuted.withColumns({"rank": number.bitwiseAND(F.lit((1 << 33) - 1)), "block": F.spark_partition_id()}), "sharding-input")
    found = rows.groupBy("block").agg(F.count("*").alias("n"), F.max("rank").alias("last")).limit(MOST_BLOCKS + 1).collect()
    if len(found) > MOST_BLOCKS:
        raise ValueError(f"read the table in at most {MOST_BLOCKS} partitions: set spark.sql.files.maxPartitionBytes")
    if any(r["last"] + 1 != r["n"] for r in found):
        raise ValueError("the ranks of a stored block have gaps")
    counts = {r["block"]: r["n"] for r in sorted(found)}
    total = sum(counts.values())
    matrix = communication_matrix(list(counts.values()), shard_sizes(total, shards), seed)
    ends = [(b, list(accumulate(row))) for b, row in zip(counts, matrix)]
    table = F.broadcast(spark.createDataFrame(ends, "block int, ends array<bigint>"))  # MOST_BLOCKS rows at most; it has every block of rows
    sent = rows.join(table, "block").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int")).drop("ends", "rank", "block")

    bins = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards) * 4, total // (shards * BIN_ROWS), 1)
    again = F.xxhash64(F.lit(seed + 2), "row")
    dealt = sent.withColumn("bin", F.floor((F.shiftrightunsigned(again, 1) / F.lit(2.0**63)) * bins).cast("int"))
    sizes = dealt.groupBy("shard", "bin").count()
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))  # shards x bins rows
    in_bin = Window.partitionBy("shard", "bin").orderBy(again, "row")
    placed = dealt.withColumn("place", F.row_number().over(in_bin)).join(offsets, ["shard", "bin"])
    return placed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32: what the query shuffles in place of texts."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def query(spark, sf_dir):
    from .common import table

    rows = digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = shuffle_into_shards(rows, 40, seed=9)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
