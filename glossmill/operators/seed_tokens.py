"""Tokens by the small seed lexicon alone: rule-classified English words and the longest seed surfaces of Han text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from . import chinese, lexicon

# Confidence of a seed surface and of a Han character without one.
KNOWN, UNKNOWN = 0.94, 0.2
MODES = ("auto", "both", "en", "zh")


def tokenize(docs: DataFrame, seed: DataFrame | None = None, mode: str = "auto", key: str = "doc_id") -> DataFrame:
    """key, surface, start, end, language, pos, confidence, priority of docs(key, text); order by start and end to export.

    English and Chinese tokens are united and may overlap: a seed surface may hold Latin letters. mode auto goes by the
    scripts of each text, the others hold for all. Of a surface's senses in seed (by default the authored one) the
    surest counts, then the first part of speech. Null, empty and scriptless texts have no token; other columns go.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    seed = lexicon.seed_lexicon(docs.sparkSession) if seed is None else seed
    docs = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    scripts = X.detect_language(F.col("text"), "counts") if mode == "auto" else F.lit(mode)
    listed = docs.sparkSession.createDataFrame(W.rule_words(), "norm string, p string, c double")
    words = X.tokens(docs.where(scripts.isin("en", "both")), key).join(F.broadcast(listed), "norm", "left")
    pos, sure = X.rule_pos(F.col("norm"), F.col("p"), F.col("c"))
    english = words.select(key, "surface", "start", "end", F.lit("en").alias("language"), pos.alias("pos"), sure.alias("confidence"))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), X.pos_rank(F.col("pos")).alias("r"), "pos"))
    senses = X.settled(seed.where("locale = 'zh-Hant'").groupBy(F.col("norm").alias("surface")).agg(best.alias("b")).select("surface", F.col("b.pos").alias("pos")))
    found = chinese.segment(docs.where(scripts.isin("zh", "both")), seed, key).join(X.small(senses), "surface", "left")
    han = found.select(key, "surface", "start", "end", F.lit("zh").alias("language"), F.coalesce("pos", F.lit("x")).alias("pos"), F.when(F.col("known"), KNOWN).otherwise(UNKNOWN).alias("confidence"))
    return english.unionByName(han).withColumn("priority", X.priority(F.col("pos"), 1))
