"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of letters and digits. Fixed masks lay over every window of
documents and benchmark items; the hash of the tokens under a mask's marks ignores the positions between,
so a hit survives substitutions there. The masks together hit every overlap that verification accepts. Hits name a document, an item and a diagonal. Each diagonal is
verified: over the aligned tokens of item and document, the best stretch of STRETCH tokens (the item's
length, if shorter) must agree in at least MATCH of its places.

Exploded windows carry hashes and positions only. The benchmark's windows are broadcast behind a count of
their rows, else both sides are shuffled by hash; texts move only where verified documents are too many
to broadcast.

Items with fewer words than SPAN but LEAST_WORDS or more have masks of their own and must agree in short_match of
their words: all by default, MATCH (one word may differ) in the query and in the pipeline. Still shorter items, which
common phrases are full of, must be the whole of one of the document's lines.

Defined cases: null and short texts have no windows; items without a word, and rows with a null doc_id or item_id
take no part; repeated documents and items report once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, text_key

#: With any MATCH of STRETCH places agreeing, or of an item of SPAN or more, one of these lies on agreeing places only
#: (a test enumerates all patterns).
MASKS = ("11111", "111011", "11010011")
#: The same for items of LEAST_WORDS to SPAN - 1 words of which one differs.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
SPAN = 10
LEAST_WORDS = 5
STRETCH = 20
MATCH = 0.8
BROADCAST_ROWS = 1_000_000  # of 24 bytes each
DIAGONALS = 1000  # of a document in one row


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def windows(tokens: Column, mask: str, number: int) -> Column:
    """Hashes of the marked tokens of every window; entry i is the window that starts at token i."""
    marks = [k for k, m in enumerate(mask) if m == "1"]
    count = F.size(tokens) - len(mask) + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(F.lit(number), *(F.get(tokens, i + k) for k in marks)))).otherwise(F.array().cast("array<bigint>"))


def seeds(rows: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keys, at, seed of every window of rows(keys, tokens) under every mask; a mask has the same number in every call."""
    number = {m: n for n, m in enumerate(MASKS + SHORT_MASKS)}
    spots = F.concat(*(F.transform(windows(F.col("tokens"), m, number[m]), lambda h, i: F.struct(i.alias("at"), h.alias("seed"))) for m in masks))
    return rows.select(*keys, F.explode(spots).alias("s")).select(*keys, "s.at", "s.seed")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, words, shift: each diagonal that holds a seed hit.

    docs(doc_id, text_key, tokens), items(item_id, words, tokens). Documents take the masks of short items only where there are any.
    """
    short = items.where(F.col("words") < SPAN)
    masks, of_items = MASKS, seeds(items.where(F.col("words") >= SPAN), ["item_id", "words"], MASKS)
    if short.take(1):
        masks, of_items = MASKS + SHORT_MASKS, of_items.unionByName(seeds(short, ["item_id", "words"], SHORT_MASKS))
    of_items = stored(of_items.withColumnRenamed("at", "item_at"), "benchmark-seeds")
    small = of_items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = seeds(docs, ["doc_id", "text_key"], masks).join(F.broadcast(of_items) if small else of_items, "seed")
    return met.select("doc_id", "text_key", "item_id", "words", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def best_stretch(aligned: Column, item: Column, width: Column) -> Column:
    """Most agreeing tokens in a stretch of width places of two aligned arrays."""
    same = F.zip_with(aligned, item, lambda a, b: F.when(a == b, 1).otherwise(0))
    return let(same, lambda s: F.array_max(F.transform(F.sequence(F.lit(1), F.size(s) - width + 1), lambda i: F.aggregate(F.slice(s, i, width), F.lit(0), lambda n, x: n + x))))


def overlaps(docs: DataFrame, benchmark: DataFrame, short_match: float = 1.0) -> DataFrame:
    """doc_id, item_id, matched, stretch: verified overlaps, the best for each pair.

    short_match: the share of words in which items of fewer than SPAN words must agree, MATCH or more.
    """
    if not MATCH <= short_match <= 1:
        raise ValueError(f"short_match must lie between {MATCH} and 1")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("tokens")).distinct()
    items = stored(items.withColumn("words", F.size("tokens")), "benchmark-items")
    few_words = items.where(F.col("words").between(1, LEAST_WORDS - 1))
    items = items.where(F.col("words") >= LEAST_WORDS)
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    found = hits(own.select("doc_id", "text_key", token_hashes(F.col("text")).alias("tokens")), items)
    # A document's diagonals are gathered in rows of about DIAGONALS, so one with very many is several rows.
    found, text = stored(found, "diagonals"), ["doc_id", "text_key"]
    rows = F.ceil(F.col("n") / DIAGONALS)
    dealt = found.join(found.groupBy(*text).agg(F.count("*").alias("n")), text).withColumn("part", F.pmod(F.xxhash64("item_id", "shift"), rows))
    found = stored(dealt.groupBy(*text, "part").agg(F.collect_list(F.struct("item_id", "words", "shift")).alias("diagonals")).drop("part"), "diagonal-lists")
    few = found.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10
    marked = own.join(F.broadcast(found) if few else found, ["doc_id", "text_key"])
    # A document's tokens are cut to the item's place before items are joined, so texts move no further.
    place = lambda t, d: F.transform(F.sequence(F.lit(0), d["words"] - 1), lambda i: F.when(i + d["shift"] >= 0, F.get(t, F.greatest(i + d["shift"], F.lit(0)))))
    cut = let(F.struct(token_hashes(F.col("text")).alias("t"), F.col("diagonals").alias("d")), lambda s: F.transform(s["d"], lambda d: F.struct(d["item_id"].alias("item_id"), place(s["t"], d).alias("aligned"))))
    near = marked.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.item_id", "c.aligned")
    width = F.least(F.col("words"), F.lit(STRETCH))
    same_length = F.size("aligned") == F.col("words")
    scored = near.join(items, "item_id").where(same_length).select("doc_id", "item_id", best_stretch(F.col("aligned"), F.col("tokens"), width).alias("matched"), width.alias("stretch"), "words")
    need = F.when(F.col("words") < SPAN, F.lit(float(short_match))).otherwise(F.lit(MATCH)) * F.col("stretch")
    out = scored.where(F.col("matched") >= need - 1e-9).groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("stretch").cast("long").alias("stretch"))
    return out.unionByName(whole_lines(own, few_words)) if few_words.take(1) else out


def whole_lines(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, stretch: items that are the whole of a document's line."""
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), token_hashes))).alias("tokens"))
    lines = lines.where(F.size("tokens").between(1, LEAST_WORDS - 1))
    small = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = F.col("words").cast("long")
    return lines.join(F.broadcast(items) if small else items, "tokens").select("doc_id", "item_id", words.alias("matched"), words.alias("stretch")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, short_match: float = 1.0) -> DataFrame:
    """The rows of docs whose doc_id has no verified overlap; rows with a null doc_id stay."""
    bad = overlaps(docs, benchmark, short_match).select(F.col("doc_id").alias("leaked_doc")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["leaked_doc"], "left_anti")


def query(spark, sf_dir):
    from .common import table

    return overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), short_match=MATCH)


#: query() for DuckDB, without seeds: equal words of documents and items are joined and counted on every diagonal.
ORACLE_SQL = r"""WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT *, row_number() OVER () AS k, len(t) AS words, least(len(t), 20) AS stretch FROM (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM benchmark WHERE item_id IS NOT NULL)),
w AS (SELECT doc_id, r, unnest(t) AS word, generate_subscripts(t, 1) AS p FROM (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT doc_id, t FROM d))),
v AS (SELECT item_id, k, stretch, unnest(t) AS word, generate_subscripts(t, 1) AS q FROM i WHERE words >= 5),
m AS (SELECT doc_id, r, item_id, k, stretch, p - q AS shift, list(q) AS places FROM w JOIN v USING (word) GROUP BY ALL HAVING count(*) >= 0.8 * stretch - 1e-9),
n AS (SELECT *, count(*) OVER (PARTITION BY r, k, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM (SELECT * EXCLUDE (places), unnest(places) AS q FROM m)),
l AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(line), '[\p{L}\p{N}]+') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d))
SELECT doc_id, item_id, max(n)::BIGINT AS matched, max(stretch)::BIGINT AS stretch FROM n WHERE n >= 0.8 * stretch - 1e-9 GROUP BY ALL
UNION ALL SELECT DISTINCT doc_id, item_id, words::BIGINT, words::BIGINT FROM l JOIN i USING (t) WHERE words BETWEEN 1 AND 4"""
