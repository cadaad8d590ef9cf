"""SimHash near-duplicates: exact single-linkage groups of 64-bit fingerprints.

Fingerprints come from XXH64 hashes of word shingles (JVM) whose bit counts are summed in numpy lanes.
Equal fingerprints collapse first, so copies cost one row. The pivot table, written once, holds for every
distinct fingerprint its Hamming distances to PIVOTS reference fingerprints. Two fingerprints that differ in at
most 3 bits agree in at least 2 of 5 blocks, so 10 bucket keys bring all of them together and lose no pair;
coordinates of random bits lie too close together to do that alone (two unrelated fingerprints are within 3 at a
pivot nearly half the time). Inside a bucket the table decides: rows are sorted by their first coordinate, a pair
whose largest coordinate difference exceeds the radius is discarded unseen (triangle inequality), survivors are
verified by their own distance, and only the links that join two local groups leave the task.

A bucket of more than BUCKET members does not go to one task; an exact way of linear size takes its place. There
each member x stands for the points within 1 and within 2 bits of it on the free bits; two members within 3 bits
share a point that is within 2 of one and within 1 of the other, and all members within 2 of a point that has a
member within 1 are linked through it: a fixed number of rows for each member, whatever the group's size.

Groups over the links come from alternating large-star and small-star joins, with a checkpoint each round.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; texts with
fewer words than a shingle are one shingle; rows with a null doc_id get a fingerprint but take no part in
groups (component_id null); repeated rows return as often as they come; ties keep a bit at 0; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, shared_dir, stored, words

BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PIVOTS = 32
BUCKET = 2000  # members of a bucket that one task compares

LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42) of each space-joined shingle, repeats included."""

    def of(w):
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
        return F.when(F.size(w) > 0, many).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(text)), of)


def majority_bits(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes between offsets the 64-bit word of bits set in over half of them."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # Runs are cut into pieces of at most 255 hashes so that byte lanes can't overflow.
    pieces = -(-sizes[full] // 255)
    first = np.repeat(offsets[full], pieces)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = first + 255 * step
    order = np.concatenate([cuts, [offsets[full][-1] + sizes[full][-1]]])
    owners = np.cumsum(pieces) - pieces
    v = values[: order[-1]]
    for k in range(8):
        lane = np.add.reduceat((v >> np.uint64(k)) & LANES, order[:-1])
        counts = np.add.reduceat(lane.view(np.uint8).reshape(-1, 8).astype(np.int64), owners, axis=0)
        bits = counts * 2 > sizes[full][:, None]
        for byte in range(8):
            out[full] |= bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _bits(batches):
    for batch in batches:
        lists = batch.column("hashes")
        if lists.null_count:
            lists = lists.fill_null([])
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        fp = majority_bits(values[offsets[0] : offsets[-1]], offsets - offsets[0]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (bigint holding the 64 bits) of every row."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.col("text"), size).alias("hashes"))
    return hashed.mapInArrow(_bits, "doc_id long, fp long")


def block_keys(fp: Column) -> Column:
    """An array of (table, key): each pair of blocks and the bits that a fingerprint has there."""
    def at(b):
        lo, n = BLOCKS[b]
        return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << n) - 1).cast("long"))

    pairs = list(combinations(range(len(BLOCKS)), 2))
    return F.array(*(F.struct(F.lit(t).alias("t"), F.shiftleft(at(a), 13).bitwiseOR(at(b)).alias("key")) for t, (a, b) in enumerate(pairs)))


def free_bits(t: int) -> list[int]:
    a, b = list(combinations(range(len(BLOCKS)), 2))[t]
    return [bit for i, (lo, n) in enumerate(BLOCKS) if i not in (a, b) for bit in range(lo, lo + n)]


def _pivots() -> np.ndarray:
    return np.random.default_rng(8).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


COORDINATES = [f"c{i}" for i in range(PIVOTS // 8)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """fp and its distances to all pivots, a byte each, eight in a bigint."""
    pivots = _pivots().view(np.int64).tolist()
    distance = lambda k: F.bit_count(F.col("fp").bitwiseXOR(F.lit(pivots[k]))).cast("long")
    eight = lambda i: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(distance(8 * i + j), 8 * j) for j in range(8)])
    return fps.select("fp", *(eight(i).alias(c) for i, c in enumerate(COORDINATES)))


def local_links(fps: np.ndarray, dist: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the members of one bucket into their groups: a spanning forest of pairs within radius.

    dist: a row of coordinates for each of the distinct fingerprints.
    """
    # Sorted by the first coordinate: only a band of the table can hold partners of a row.
    fps, dist = fps.view(np.uint64), dist.astype(np.int8)
    order = np.argsort(dist[:, 0], kind="stable")
    fps, dist = fps[order], dist[order]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    ends = np.searchsorted(dist[:, 0], dist[:, 0].astype(np.int64) + radius, side="right")
    for i in range(len(fps) - 1):
        lo, hi = i + 1, int(ends[i])
        if lo >= hi:
            continue
        near = lo + np.flatnonzero(np.abs(dist[lo:hi] - dist[i]).max(axis=1) <= radius)
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))
    return links


def _linker(radius: int):
    """Streams a partition sorted by table and key: the links inside each bucket, of which one is held at a time."""
    def close(fps: list, dist: list) -> list:
        found = local_links(np.concatenate(fps), np.concatenate(dist), radius) if fps else []
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])] if found else []

    def run(batches):
        known, fps, dist = None, [], []
        for batch in batches:
            bucket = np.stack([batch.column("t").to_numpy().astype(np.int64), batch.column("key").to_numpy()], axis=1)
            own = batch.column("fp").to_numpy()
            table = np.stack([batch.column(c).to_numpy() for c in COORDINATES], axis=1).view(np.uint8)
            starts = [0, *(np.flatnonzero((bucket[1:] != bucket[:-1]).any(axis=1)) + 1).tolist()] if len(own) else []
            for lo, hi in zip(starts, [*starts[1:], len(own)]):
                if (at := tuple(bucket[lo])) != known:
                    yield from close(fps, dist)
                    known, fps, dist = at, [], []
                fps.append(own[lo:hi].copy())
                dist.append(table[lo:hi])
        yield from close(fps, dist)

    return run


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints whose groups are those of all pairs within radius (3 at most)."""
    if radius > 3:
        raise ValueError("two of five blocks agree only up to 3 differing bits")
    coordinates = stored(pivot_table(fps.select("fp").distinct()), "pivot-table")
    keyed = coordinates.select("fp", *COORDINATES, F.explode(block_keys(F.col("fp"))).alias("k")).select("fp", *COORDINATES, "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").count()
    # A bucket over the bound holds at least that many of the 10 n rows, so big keys are at most 10 n / bucket.
    big = stored(sizes.where(F.col("count") > bucket).select("t", "key"), "big-buckets")
    some = sizes.where(F.col("count").between(2, bucket)).select("t", "key")
    sorted_ = keyed.join(some, ["t", "key"]).select("t", "key", "fp", *COORDINATES).repartition("t", "key").sortWithinPartitions("t", "key")
    small = sorted_.mapInArrow(_linker(radius), "a long, b long")
    return small.unionByName(big_links(keyed.join(big, ["t", "key"], "left_semi"), radius)) if big.take(1) else small


def big_links(members: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets of any size, by shared points: see the module's text."""
    near, far = radius // 2, radius - radius // 2
    masks = [(t, int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64)), len(bits)) for t in range(10) for n in range(far + 1) for bits in combinations(free_bits(t), n)]
    table = F.broadcast(members.sparkSession.createDataFrame(masks, "t int, mask long, bits int"))  # 742 rows for each of ten tables
    points = members.join(table, "t").select("t", "fp", "bits", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    hubs = points.where(F.col("bits") <= near).groupBy("t", "point").agg(F.min("fp").alias("hub"))
    pairs = points.join(hubs, ["t", "point"]).where(F.col("fp") != F.col("hub"))
    return pairs.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: for every node but the least of its group that least node, over edges (a, b) of longs.

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones, until
    nothing changes. A node with very many neighbours is a key of joins that AQE splits and of sums that
    combine before the shuffle; no neighbour list is gathered.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = now
    raise RuntimeError("groups did not settle")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    distinct = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = classes.join(heads, "root").select("fp", "component_id")
    joined = prints.join(of_print, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir):
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
