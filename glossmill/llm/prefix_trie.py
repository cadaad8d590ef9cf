"""The trie of conversations' shared beginnings, with subtree totals by parallel tree contraction.

Names. A turn is two 64-bit hashes of its role and text. The name of a beginning of d turns is the pair of polynomials
of its turns' hashes (modulo 2^64, with an odd base), so it follows from running sums: turns are dealt by ranges
of (conv_id, turn), each partition sums its own rows in one stream, and a row for each partition carries the sums on. A
conversation of any length is spread over as many partitions as it fills; its texts never move.

Rebuilding. The name of a beginning that takes h turns of another conversation follows from three sums, of the other's
first h turns, of the own first h turns and of all own turns, so rebuilt conversations are never written out.

Nodes. Rows of equal name are one node, counted with partial sums; a node is told by its smallest conv_id and its depth.

Contraction. A phase rakes all leaves, adding their totals to their parents in one grouped join, and then compresses
every chain of nodes with one child by pointer doubling, a join a round that reaches twice as far; chains' lower ends take
their tops' places. No chain is left, so each phase halves the tree at least. Re-expansion goes through the phases
backward: a compressed node's total is what it had gathered plus the total of the node below its chain.

Lists of members that end at a node are hashed in pieces: sorted by ranges, joined to strings of PIECE ids where they lie,
and only the strings of a node meet, in order, since SHA-256 can't be split.

Defined cases: rows with a null conv_id take no part; turns are ordered null first, then ties by the turn's hashes;
repeated rows are turns of their own; c - c % 100 is cut toward zero for negative ids; an empty table gives no nodes, not
even a root; turnless conversations end at the root; extra columns are ignored. Two different beginnings of a depth count
as equal with a chance of about 2^-128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BASE = np.uint64(0x9E3779B97F4A7C15)
HEAD = 5  # turns that a conversation may take from another one
PIECE = 1024  # ids in a string
PHASES = 64


def _powers(n: np.ndarray) -> np.ndarray:
    """BASE to the power n, modulo 2^64; n may be negative."""
    exponent, base = n.astype(np.int64).astype(np.uint64), BASE
    out = np.ones(len(n), np.uint64)
    for bit in range(64):  # odd numbers to the power 2^62 are 1, so a negative power is one of the two's complement
        out = np.where((exponent >> np.uint64(bit)) & np.uint64(1), out * base, out)
        base = base * base
    return out


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _summer(batches):
    """Streams a partition sorted by conv_id and turn: rank, and the running sums s1 and s2 of each conversation here."""
    from pyspark import TaskContext

    block, conv, rank, sums = TaskContext.get().partitionId(), None, 0, np.zeros(2, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.concatenate([[ids[0] != conv], ids[1:] != ids[:-1]]))
        run = np.cumsum(np.bincount(starts, minlength=len(ids)))  # 0: goes on from the batch before
        begin = np.concatenate([[0], starts])[run] if len(starts) else np.zeros(len(ids), np.int64)
        ranks = np.arange(len(ids)) - begin + 1 + np.where(run == 0, rank, 0)
        powers = _powers(ranks)
        out = []
        for k, name in enumerate(("h1", "h2")):
            total = np.cumsum(_numbers(batch.column(name)) * powers)
            before = np.concatenate([np.zeros(1, np.uint64), total])[begin]
            out.append(total - before + np.where(run == 0, sums[k], np.uint64(0)))
        conv, rank, sums = ids[-1], int(ranks[-1]), np.array([s[-1] for s in out])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ranks, pa.int64()), _signed(out[0]), _signed(out[1]), batch.column("chars"), pa.array(np.full(len(ids), block, np.int64))], names=["conv_id", "rank", "s1", "s2", "chars", "block"])


def _carried(blocks: list) -> list[tuple]:
    """(block, conv_id, rank, s1, s2) to add to the rows of a block's first conversation. blocks: what each partition holds."""
    out, conv, rank, s1, s2, mask = [], None, 0, 0, 0, (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for b in sorted(blocks, key=lambda r: r["block"]):
        goes_on = b["first"] == conv
        if goes_on:
            out.append((b["block"], conv, rank, signed(s1), signed(s2)))
        power = pow(int(BASE), rank, 1 << 64) if goes_on and b["last"]["conv_id"] == conv else 0
        if power:  # the whole block is one conversation that goes on
            rank, s1, s2 = rank + b["last"]["rank"], s1 + power * b["last"]["s1"] & mask, s2 + power * b["last"]["s2"] & mask
        else:
            conv, rank, s1, s2 = b["last"]["conv_id"], b["last"]["rank"], b["last"]["s1"] & mask, b["last"]["s2"] & mask
    return out


def _carrier(batches):
    """Adds what a block's first conversation brought along: sums here were taken as if it began here."""
    for batch in batches:
        rank = batch.column("carried_rank").to_numpy()
        powers, sums = _powers(rank), []
        for name in ("s1", "s2"):
            sums.append(_signed(_numbers(batch.column(f"carried_{name}")) + powers * _numbers(batch.column(name))))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(batch.column("rank").to_numpy() + rank), *sums, batch.column("chars")], names=["conv_id", "rank", "s1", "s2", "chars"])


def beginnings(turns: DataFrame) -> DataFrame:
    """conv_id, rank, s1, s2, chars: a row for each turn, with the name of the beginning that ends there."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role, F.char_length(role)).alias("h2"), F.char_length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "h1", "h2"]
    schema = "conv_id long, rank long, s1 long, s2 long, chars long"
    summed = stored(hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_summer, f"{schema}, block long"), "trie-turns")
    last = F.max(F.struct("conv_id", "rank", "s1", "s2")).alias("last")
    carried = _carried(summed.groupBy("block").agg(F.min("conv_id").alias("first"), last).collect())  # a row for each partition
    table = turns.sparkSession.createDataFrame(carried, "block long, conv_id long, carried_rank long, carried_s1 long, carried_s2 long")
    met = summed.join(F.broadcast(table), ["block", "conv_id"], "left").na.fill(0, ["carried_rank", "carried_s1", "carried_s2"])
    return met.mapInArrow(_carrier, schema)


def _renamer(batches):
    """Names of beginnings in rebuilt conversations: the head's sums, plus the own sums after its first h turns, moved."""
    for batch in batches:
        powers, sums = _powers(batch.column("shift").to_numpy()), []
        for name in ("s1", "s2"):
            own, skipped, head = (_numbers(batch.column(f"{kind}{name}")) for kind in ("", "skipped_", "head_"))
            sums.append(_signed(head + powers * (own - skipped)))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), *sums, batch.column("chars"), batch.column("ends")], names=["conv_id", "depth", "s1", "s2", "chars", "ends"])


def rebuilt(turns: DataFrame, group: int = 100, heads: int = HEAD + 1) -> tuple[DataFrame, DataFrame]:
    """conv_id and depth of every rebuilt conversation; and its beginnings: conv_id, depth, s1, s2, chars, ends (whether the whole)."""
    rows = stored(beginnings(turns), "trie-beginnings")
    of = F.collect_list(F.when(F.col("rank") < heads, F.struct("rank", "s1", "s2", "chars")))  # heads - 1 of a conversation at most
    convs = rows.groupBy("conv_id").agg(F.array_sort(of).alias("head"), F.max("rank").alias("n"))
    convs = convs.withColumn("h", (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).cast("int"))
    bases = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("from"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(bases, "base", "left").drop("base")
    convs = convs.withColumn("from", F.slice(F.coalesce("from", F.array()), 1, F.col("h"))).withColumn("taken", F.size("from"))
    at = lambda column, i, field: F.coalesce(F.get(column, i - 1)[field], F.lit(0).cast("long"))
    convs = convs.withColumn("depth", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    skipped = [at("head", F.col("h"), s).alias(f"skipped_{s}") for s in ("s1", "s2")]
    taken = [at("from", F.col("taken"), s).alias(f"head_{s}") for s in ("s1", "s2")]
    convs = stored(convs.select("conv_id", "h", "from", "taken", F.col("depth").cast("long").alias("depth"), *skipped, *taken), "trie-conversations")

    head = convs.select("conv_id", F.explode("from").alias("x"), F.col("depth").alias("whole")).select("conv_id", F.col("x.rank").alias("depth"), "x.s1", "x.s2", "x.chars", (F.col("x.rank") == F.col("whole")).alias("ends"))
    met = rows.join(convs.drop("from").withColumnRenamed("depth", "whole"), "conv_id").where("rank > h")
    moved = met.withColumn("shift", (F.col("taken") - F.col("h")).cast("long")).withColumn("depth", F.col("rank") + F.col("shift"))
    own = moved.select("conv_id", "depth", "s1", "s2", "chars", "shift", "skipped_s1", "skipped_s2", "head_s1", "head_s2", (F.col("depth") == F.col("whole")).alias("ends"))
    return convs.select("conv_id", "depth"), head.unionByName(own.mapInArrow(_renamer, "conv_id long, depth long, s1 long, s2 long, chars long, ends boolean"))


def _joiner(batches):
    """Streams a partition sorted by name and conv_id: strings of up to PIECE ids of a name, and the first of them."""
    key, ids = None, []
    for batch in batches:
        out = []
        for name in zip(*(batch.column(c).to_pylist() for c in ("depth", "s1", "s2", "conv_id"))):
            if name[:3] != key or len(ids) == PIECE:
                out += [(*key, ids[0], ",".join(map(str, ids)))] if ids else []
                key, ids = name[:3], []
            ids.append(name[3])
        if out:
            yield _named(out)
    if ids:
        yield _named([(*key, ids[0], ",".join(map(str, ids)))])


def _named(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["depth", "s1", "s2", "first", "ids"])


def _hasher(batches):
    """Streams a partition sorted by name and first id: the digest of each name's strings."""
    key, digest = None, None
    row = lambda: _digests([(*key, digest.hexdigest())])
    for batch in batches:
        for depth, s1, s2, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "s1", "s2", "ids"))):
            if (depth, s1, s2) == key:
                digest.update(b"," + ids.encode())
            else:
                if key:
                    yield row()
                key, digest = (depth, s1, s2), hashlib.sha256(ids.encode())
    if key:
        yield row()


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])], names=["depth", "s1", "s2", "ends_sha256"])


NAME = ["depth", "s1", "s2"]


def nodes(turns: DataFrame) -> DataFrame:
    """node and parent (structs of conv_id and depth), n_convs, own saved tokens and ends_sha256 of each beginning."""
    convs, rows = rebuilt(turns)
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), zero.alias("chars"), (F.col("depth") == 0).alias("ends"))
    rows = stored(rows.unionByName(root), "trie-rows")
    ending = rows.where("ends").select(*NAME, "conv_id")
    strings = ending.repartitionByRange(*NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id").mapInArrow(_joiner, "depth long, s1 long, s2 long, first long, ids string")
    ends = strings.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInArrow(_hasher, "depth long, s1 long, s2 long, ends_sha256 string")
    named = rows.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    named = named.join(ends, NAME, "left").withColumn("node", F.struct("conv_id", "depth"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    named = stored(named.select("node", "n_convs", saved.alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), *NAME), "trie-nodes")
    # A node's parent is on the path of the node's smallest member, one turn up: that row's name, and the node of this name.
    up = named.where("depth > 0").select(F.col("node.conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "node").join(rows.select("conv_id", *NAME), ["conv_id", "depth"])
    parents = up.select("node", *NAME).join(named.select(F.col("node").alias("parent"), *NAME), NAME).select("node", "parent")
    return named.drop(*NAME).join(parents, "node", "left")


def _total(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """node and, for each of the values, its sum over the node's subtree. tree: node, parent (null: a root) and values.

    A tree in the making has for each node its gathered values, what its chain adds on the way up (over_), and its kids.
    """
    over = [f"over_{v}" for v in values]
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    now = stored(tree.select("node", "parent", *values, *(F.lit(0).cast("long").alias(o) for o in over)).join(kids, "node", "left").na.fill(0, ["kids"]), "contraction")
    known, chains = [], []
    for _ in range(PHASES):
        # Rake: leaves have gathered all; their parents take it.
        leaves = now.where("kids = 0").select("node", *values)
        known.append(leaves)
        inner = F.col("kids") > 0
        brought = [F.sum(F.when(~inner, F.col(v) + F.col(o))).alias(f"more_{v}") for v, o in zip(values, over)]
        below = F.min(F.when(inner, F.struct("node", *over))).alias("below")
        gathered = now.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(*brought, F.count(F.when(inner, 1)).alias("left"), below)
        raked = now.where(inner).join(gathered, F.col("node") == F.col("at"))
        raked = stored(raked.select("node", "parent", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values), *over, F.col("left").alias("kids"), "below"), "contraction")
        if raked.isEmpty():
            break
        # Compress: each node with one child points down its chain, twice as far with every join.
        alone = raked.where("kids = 1").select("node", "parent", F.col("below.node").alias("to"), *((F.col(v) + F.col(f"below.{o}")).alias(v) for v, o in zip(values, over)), *over)
        jumps, moving = stored(alone.withColumn("moved", F.lit(True)), "contraction"), True
        while moving:
            far = jumps.select(F.col("node").alias("to"), F.col("to").alias("next"), *(F.col(v).alias(f"next_{v}") for v in values))
            further = jumps.join(far, "to", "left").withColumn("moved", F.col("next").isNotNull())
            jumps = stored(further.select("node", "parent", F.coalesce("next", "to").alias("to"), *((F.col(v) + F.coalesce(f"next_{v}", F.lit(0))).alias(v) for v in values), *over, "moved"), "contraction")
            moving = not jumps.where("moved").isEmpty()
        chains.append(jumps)
        # The lower end of a chain takes the place of the chain's top, which is its highest node.
        top = F.min(F.struct("node.depth", "parent", *((F.col(v) + F.col(o)).alias(o) for v, o in zip(values, over)))).alias("top")
        tops = jumps.groupBy(F.col("to").alias("node")).agg(top)
        rest = raked.where("kids != 1").drop("below").join(tops, "node", "left")
        placed = F.when(F.col("top").isNull(), F.col("parent")).otherwise(F.col("top.parent"))
        now = stored(rest.select("node", placed.alias("parent"), *values, *(F.coalesce(f"top.{o}", F.col(o)).alias(o) for o in over), "kids"), "contraction")
    else:
        raise ValueError("the parents of this tree make a ring")
    for jumps in reversed(chains):
        found = known[0]
        for more in known[1:]:
            found = found.unionByName(more)
        ends = found.select(F.col("node").alias("to"), *(F.col(v).alias(f"end_{v}") for v in values))
        known.append(stored(jumps.join(ends, "to").select("node", *((F.col(v) + F.col(f"end_{v}")).alias(v) for v in values)), "contraction"))
    found = known[0]
    for more in known[1:]:
        found = found.unionByName(more)
    return found


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations of turns(conv_id, turn, role, text)."""
    found = stored(nodes(turns), "trie-tree")
    kids = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    found = stored(found.join(kids, "node", "left").withColumn("n_children", _total("n_children")), "trie-counted")
    tree = found.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    ids = [F.col("node.conv_id").alias("conv_id"), F.col("node.depth").alias("depth"), F.col("parent.conv_id").alias("parent_conv_id")]
    return found.join(totals, "node").select(*ids, "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark, sf_dir):
    from .common import table

    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: query() for DuckDB: names are chained SHA-256, subtree sums run over the ancestors of every node, CRC-32 over its eight steps a byte.
ORACLE_SQL = r"""WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS r, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, s: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END), 4294967295::BIGINT), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, 0 AS own, o.r, role, text FROM c JOIN o ON o.conv_id = c.base AND o.r <= h UNION ALL SELECT c.conv_id, 1, o.r, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.r > h),
l AS (SELECT conv_id, list({'name': sha256(role || chr(31) || text), 'all': []::VARCHAR[]} ORDER BY own, r) AS l, list(length(text) ORDER BY own, r) AS chars FROM b GROUP BY conv_id),
k AS (SELECT c.conv_id, list_prepend('', coalesce(list_reduce(l, lambda t, x: {'name': sha256(t.name || x.name), 'all': list_append(t.all, sha256(t.name || x.name))}, {'name': '', 'all': []::VARCHAR[]}).all, [])) AS names, list_prepend(0, coalesce(chars, [])) AS chars FROM c LEFT JOIN l USING (conv_id)),
p AS (SELECT conv_id, unnest(range(len(names))) AS depth, unnest(names) AS name, unnest(chars) AS chars, len(names) - 1 AS whole FROM k),
n AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = whole), '')) AS ends_sha256 FROM p GROUP BY ALL),
u AS (SELECT n.*, up.name AS up FROM n LEFT JOIN p up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
q AS (SELECT up AS name, depth - 1 AS depth, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY ALL),
s AS (SELECT p.depth, p.name, count(*) FILTER (q.name IS NULL) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM n LEFT JOIN q ON q.depth = n.depth AND q.name = n.name JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL)
SELECT u.conv_id, u.depth, par.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, u.ends_sha256
FROM u JOIN s USING (depth, name) LEFT JOIN q USING (depth, name) LEFT JOIN n par ON par.depth = u.depth - 1 AND par.name = u.up"""
