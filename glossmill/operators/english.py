"""English analyses: lookups at type level, and left-to-right choice of one analysis for each token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as X
from ..functions import words as W
from .lexicon import complete

NO_FEATURES = "struct<form:string,number:string,person:int,tense:string,degree:string>"


#: What an analysis takes over from its lexicon row.
ENTRY = ["lemma", "pos", "confidence", "lexical_ref", "tier", "gloss_ref", "gloss_ix", "dataset_id"]


def _rows(lexicon: DataFrame, name: str = "norm") -> DataFrame:
    return complete(lexicon).where("locale = 'en'").select(F.col("norm").alias(name), *ENTRY)


def direct(types: DataFrame, lexicon: DataFrame) -> DataFrame:
    """norm with each of its own lexicon rows."""
    source = F.when(F.col("tier") == "fallback", "bootstrap-lexicon").otherwise("verified-lexical-index")
    none = F.lit(None)
    return types.select("norm").join(_rows(lexicon), "norm").select("*", source.alias("source"), none.cast(NO_FEATURES).alias("morph"), none.cast("string").alias("morph_dataset"))


def irregular(types: DataFrame, lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """norm with rows of its exception lemmas whose part of speech agrees."""
    dataset = F.col("dataset_id") if "dataset_id" in exceptions.columns else F.lit(None).cast("string")
    forms = exceptions.groupBy(F.col("inflected").alias("norm"), F.col("lemma").alias("base"), F.col("pos").alias("base_pos")).agg(F.min(dataset).alias("morph_dataset"))
    both = types.select("norm").join(forms, "norm").join(_rows(lexicon, "base"), "base").where("pos = base_pos")
    morph = F.struct(F.lit("irregular").alias("form"), F.when(F.col("pos") == "n", "plural").alias("number"), F.lit(None).cast("int").alias("person"), F.lit(None).cast("string").alias("tense"), F.lit(None).cast("string").alias("degree"))
    return both.withColumn("confidence", F.least("confidence", F.lit(0.96))).select("norm", *ENTRY, F.lit("exception-morphology").alias("source"), morph.cast(NO_FEATURES).alias("morph"), "morph_dataset")


def regular(types: DataFrame, lexicon: DataFrame) -> DataFrame:
    """norm with rows of the lemmas that a regular inflection may come from."""
    spread = types.select("norm", F.explode(X.inflection_candidates(F.col("norm"))).alias("c")).select("norm", F.col("c.lemma").alias("base"), "c.kind")
    both = spread.join(_rows(lexicon, "base"), "base").withColumn("morph", X.morphology(F.col("kind"), F.col("pos")).cast(NO_FEATURES)).where("morph is not null")
    return both.withColumn("confidence", F.least("confidence", F.lit(0.9))).select("norm", *ENTRY, F.lit("verified-regular-morphology").alias("source"), "morph", F.col("dataset_id").alias("morph_dataset"))


def analyses(types: DataFrame, lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """norm, options: all analyses of each distinct type, best first where context says nothing; hot words cost one row.

    An option holds its evidence: references to its lexicon row, its gloss and the data sets behind them.
    """
    every = direct(types, lexicon).unionByName(irregular(types, lexicon, exceptions)).unionByName(regular(types, lexicon))
    closed = (F.col("tier") == "fallback") & F.col("pos").isin(W.CLOSED_CLASS)
    option = F.struct((-F.col("confidence")).alias("neg_confidence"), X.pos_rank(F.col("pos")).alias("rank"), F.coalesce("lexical_ref", F.lit("")).alias("ref"), "pos", "confidence", "lemma", "source", "morph", closed.alias("closed"), "gloss_ref", "gloss_ix", "dataset_id", "morph_dataset")
    return every.groupBy("norm").agg(F.array_sort(F.collect_set(option)).alias("options"))


def contextual_score(option: Column, prior: Column, seen: Column, next_noun: Column) -> Column:
    """How well an analysis fits after the chosen one before it; prior is a part of speech or null."""
    pos, form = option["pos"], option["morph"]["form"]
    # The weights of each piece of context.
    on = lambda test, value: F.when(test, value).otherwise(0)
    prior = F.coalesce(prior, F.lit(""))
    score = option["confidence"] * 10 + on(option["closed"], 100)
    score += F.when(prior == "det", F.when(pos == "n", 12).when(pos == "adj", 10).otherwise(-4)).otherwise(0)
    score += on((prior == "adj") & (pos == "n"), 12)
    score += on(prior.isin("aux", "modal") & (pos == "v"), 24) + on(prior.isin("aux", "modal") & (form == "present-participle"), 6)
    score += on(~seen & prior.isin("n", "pron") & (pos == "v"), 12)
    score += on(seen & (pos == "n") & (form == "plural"), 20) - on(seen & (pos == "v") & (form == "third-person-singular"), 20)
    score += on((prior == "det") & (pos == "adj") & next_noun, 8) + on(seen & (pos == "adj") & next_noun, 12)
    return score


def choose(tokens: DataFrame, options: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every token with its chosen analysis, folded left to right inside each sentence.

    The look-ahead for a noun crosses sentences, so it is taken over the document first; the fold's state (the
    part of speech before, whether a predicate was seen) ends with a sentence, so sentences are independent. The fold
    sees of each option only what its score needs and gives the option's number; the option itself, with its evidence,
    is looked up once more at the end. Options of few types are broadcast, so tokens stay partitioned by document;
    many are joined by shuffle.
    """
    options = X.settled(options)
    brief = F.transform("options", lambda o: F.struct(o["pos"].alias("pos"), o["confidence"].alias("confidence"), F.struct(o["morph"]["form"].alias("form")).alias("morph"), o["closed"].alias("closed")))
    met = tokens.join(X.small(options.select("norm", brief.alias("brief"))), "norm", "left")
    order = Window.partitionBy(key).orderBy("ix")
    noun = F.exists(F.coalesce("brief", F.array()), lambda o: o["pos"] == "n")
    ready = met.withColumn("sentence", F.sum(F.col("boundary").cast("int")).over(order)).withColumn("next_noun", F.coalesce(F.lead(noun).over(order), F.lit(False)))
    step = F.struct("ix", "surface", "norm", "start", "end", "clause_break", "brief", "next_noun")
    groups = ready.groupBy(key, "sentence").agg(F.sort_array(F.collect_list(step)).alias("steps"))

    state = F.struct(F.lit(None).cast("string").alias("prior"), F.lit(False).alias("seen"), F.array().cast("array<int>").alias("last"), F.array().cast("array<array<int>>").alias("full"))

    def fold(s, t):
        # Options are in the order that breaks ties, so of equal scores the smallest number wins.
        scored = F.transform(t["brief"], lambda o, i: F.struct((-contextual_score(o, s["prior"], s["seen"], t["next_noun"])).alias("cost"), i.alias("i")))
        best = F.when(F.size(t["brief"]) == 1, 0).otherwise(F.array_min(scored)["i"])
        pos = F.get(t["brief"], best)["pos"]
        last, full = X.append(s, best)
        return F.struct(pos.alias("prior"), (s["seen"] | F.coalesce(pos == "v", F.lit(False))).alias("seen"), last.alias("last"), full.alias("full"))

    chosen = groups.select(key, "sentence", "steps", F.aggregate("steps", state, fold, X.appended).alias("out"))
    rows = chosen.select(key, "sentence", F.explode(F.arrays_zip("steps", "out")).alias("z"))
    rows = rows.select(key, "sentence", *(f"z.steps.{c}" for c in ("ix", "surface", "norm", "start", "end", "clause_break")), F.col("z.out").alias("pick"))
    # Tokens without an analysis have none in the table either.
    one = rows.join(X.small(options), "norm", "left").withColumn("z", F.get("options", F.col("pick")))
    known = F.col("pick").isNotNull()
    return one.select(
        key, "ix", "surface", "norm", "start", "end", "clause_break", "sentence",
        F.lit("en").alias("language"), F.when(known, F.col("z.pos")).otherwise("x").alias("pos"), F.when(known, F.col("z.confidence")).otherwise(0.15).alias("confidence"),
        "z.lemma", F.coalesce("z.source", F.lit("unknown-handler")).alias("source"), F.col("z.ref").alias("lexical_ref"), F.col("z.morph").alias("morphology"),
        "z.gloss_ref", "z.gloss_ix", "z.dataset_id", "z.morph_dataset",
    ).withColumn("priority", X.priority(F.col("pos")))


def best_direct(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with the best of their own lexicon rows, by confidence, part-of-speech order and reference.

    The best row of each form is found in the lexicon first, so no pass over the tokens is needed for their types.
    """
    order = F.struct((-F.col("confidence")).alias("a"), X.pos_rank(F.col("pos")).alias("b"), F.coalesce("lexical_ref", F.lit("")).alias("c"))
    best = lexicon.where("locale = 'en'").groupBy("norm").agg(F.min(F.struct(order.alias("o"), "pos", "confidence", "lemma", "lexical_ref")).alias("best"))
    out = tokens.join(X.small(X.settled(best), 1_000_000), "norm", "left")
    return out.select(*tokens.columns, F.coalesce("best.pos", F.lit("x")).alias("pos"), F.coalesce("best.confidence", F.lit(0.15)).alias("confidence"), F.col("best.lemma").alias("lemma"), F.col("best.lexical_ref").alias("lexical_ref"))


#: A piece of evidence for what a token shows.
ANNOTATION = "struct<annotation_id:string,type:string,value:string,confidence:double,source:string,dataset_id:string>"


def note(kind: str, value: Column, confidence: Column, source: Column, dataset: Column) -> Column:
    """A piece of evidence without its id; null where there is no value."""
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), confidence.cast("double").alias("confidence"), source.alias("source"), dataset.alias("dataset_id")))


def numbered(notes: Column, head: str, tail: str = "") -> Column:
    """notes in order, with ids of head, place, type and number."""
    whole = F.array_compact(notes)
    return F.transform(whole, lambda a, i: F.struct(F.concat_ws(":", F.lit(head), "start", "end", a["type"], F.concat(F.lit(tail), i.cast("string"))).alias("annotation_id"), *(a[c].alias(c) for c in ("type", "value", "confidence", "source", "dataset_id")))).cast(f"array<{ANNOTATION}>")


def evidence() -> Column:
    """What speaks for each thing that a chosen token with its gloss shows."""
    known, dataset = F.col("source") != "unknown-handler", F.col("dataset_id")
    one = lambda kind, value, of=dataset: note(kind, value, F.col("confidence"), F.col("source"), of)
    notes = F.array(
        one("lemma", F.when(known, F.col("lemma"))), one("simplified-pos", F.col("pos")), one("lexical-reference", F.when(known & (F.col("lexical_ref") != ""), F.col("lexical_ref"))),
        one("gloss-reference", F.when(known, F.col("gloss_ref"))), one("gloss", F.when(known & (F.col("gloss") != ""), F.col("gloss"))), one("morphology", F.to_json("morphology"), F.col("morph_dataset")), one("unknown", F.when(~known, F.lit("true"))),
    )
    return numbered(notes, "ann:en")


def annotations(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each piece of evidence of tokens with annotations."""
    return tokens.select(key, "start", "end", "language", F.explode("annotations").alias("a")).select(key, "start", "end", "language", "a.*")
