"""Quality metrics, gates, audits and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text as X
from ..functions import words as W


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def align(gold: DataFrame, predicted: DataFrame, key: str = "case_id") -> DataFrame:
    """key, start, end, expected, actual of exact spans; __missing__ and __extra__ where one side has none."""
    g = gold.select(key, "start", "end", F.col("pos").alias("g"))
    p = predicted.select(key, "start", "end", F.col("pos").alias("p"))
    both = g.join(p, [key, "start", "end"], "full_outer")
    return both.select(key, "start", "end", F.coalesce("g", F.lit("__extra__")).alias("expected"), F.coalesce("p", F.lit("__missing__")).alias("actual"))


def label_scores(observations: DataFrame) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 for observations(expected, actual); labels are the expected ones."""
    sides = observations.select(F.explode(F.array(
        F.struct(F.col("expected").alias("label"), (F.col("expected") == F.col("actual")).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("expected") != F.col("actual")).cast("long").alias("fn"), F.lit(1).cast("long").alias("support")),
        F.struct(F.col("actual").alias("label"), F.lit(0).cast("long").alias("tp"), (F.col("expected") != F.col("actual")).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("support")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support"))).where("support > 0 and not startswith(label, '__')")
    scored = sums.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro_f1(observations: DataFrame) -> DataFrame:
    return label_scores(observations).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.count("*").alias("n_labels"))


def span_scores(gold: DataFrame, predicted: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: matched, expected and predicted spans over all cases, precision, recall, f1."""
    g, p = gold.select(key, "start", "end").distinct(), predicted.select(key, "start", "end").distinct()
    both = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), [key, "start", "end"], "full_outer")
    sums = both.agg(F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("matched"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_expected"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_predicted"))
    scored = sums.withColumn("precision", ratio(F.col("matched"), F.col("n_predicted"))).withColumn("recall", ratio(F.col("matched"), F.col("n_expected")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def evaluate(gold: DataFrame, predicted: DataFrame, key: str = "case_id") -> DataFrame:
    """By locale: tokens, and how many expectations of lemma, form, simplified form and unknown there are and hold.

    gold(key, locale, start, end, lemma, form, unknown, and if at hand simplified): null expects nothing. An unknown token
    has no part of speech, lemma or reference, and a confidence under a half where predicted has that column.
    """
    of = lambda c, kind: F.col(c) if c in predicted.columns else F.lit(None).cast(kind)
    p = predicted.select(key, "start", "end", F.col("pos").alias("p_pos"), F.col("lemma").alias("p_lemma"), F.col("form").alias("p_form"), of("simplified", "string").alias("p_simplified"), of("lexical_ref", "string").alias("p_ref"), of("confidence", "double").alias("p_sure"), F.lit(True).alias("hit"))
    met = gold.withColumn("_simplified", F.col("simplified") if "simplified" in gold.columns else F.lit(None).cast("string")).join(p, [key, "start", "end"], "left")
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    asked = {"lemma": ("lemma", "p_lemma"), "form": ("form", "p_form"), "simplified": ("_simplified", "p_simplified")}
    sums = [c for name, (want, got) in asked.items() for c in (F.count(want).alias(f"{name}_asked"), count(F.col(want) == F.col(got)).alias(f"{name}_passed"))]
    unknown_ok = F.col("hit") & (F.col("p_pos") == "x") & F.col("p_lemma").isNull() & (F.coalesce("p_ref", F.lit("")) == "") & (F.coalesce("p_sure", F.lit(0.0)) < 0.5)
    return met.groupBy("locale").agg(F.count("*").alias("n_tokens"), *sums, count(F.col("unknown")).alias("unknown_asked"), count(F.col("unknown") & unknown_ok).alias("unknown_passed"))


def evaluate_corpus(cases: DataFrame, gold: DataFrame, predicted: DataFrame, key: str = "case_id") -> DataFrame:
    """The whole evaluation by locale: cases(key, locale) and exact ones, predicted tokens with references and sound confidences,
    spans, macro F1 of parts of speech, and the expectations of evaluate().

    gold carries locale and pos; a case is exact where its spans are those predicted. One exchange by case serves spans and
    labels; what follows are sums.
    """
    at = [key, "start", "end"]
    locale = cases.select(key, F.col("locale").alias("_locale"))
    g = gold.select(*at, F.col("pos").alias("g_pos"), F.lit(True).alias("g"))
    p = predicted.select(*at, F.col("pos").alias("p_pos"), (F.coalesce("lexical_ref", F.lit("")) != "").alias("p_ref"), F.coalesce(F.col("confidence").between(0, 1), F.lit(False)).alias("p_sure"), F.lit(True).alias("p"))
    both = X.settled(g.join(p, at, "full_outer").join(locale, key))
    one = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    hit = F.col("g") & F.col("p")
    per_case = both.groupBy("_locale", key).agg(one(~F.coalesce(hit, F.lit(False))).alias("off"), one(F.col("g")).alias("e"), one(F.col("p")).alias("q"), one(hit).alias("m"), one(F.col("p") & F.col("p_ref")).alias("r"), one(F.col("p") & F.col("p_sure")).alias("s"))
    spans = cases.select(key, F.col("locale").alias("_locale")).join(per_case, [key, "_locale"], "left").groupBy(F.col("_locale").alias("locale")).agg(
        F.count("*").alias("n_cases"), one(F.coalesce("off", F.lit(0)) == 0).alias("n_exact"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("e", "n_expected"), ("q", "n_predicted"), ("m", "matched"), ("r", "n_with_refs"), ("s", "n_sound"))),
    )
    spans = spans.withColumn("precision", ratio(F.col("matched"), F.col("n_predicted"))).withColumn("recall", ratio(F.col("matched"), F.col("n_expected"))).withColumn("span_f1", f1(F.col("precision"), F.col("recall")))
    seen = both.select(F.col("_locale").alias("locale"), F.coalesce("g_pos", F.lit("__extra__")).alias("expected"), F.coalesce("p_pos", F.lit("__missing__")).alias("actual")).groupBy("locale", "expected", "actual").agg(F.count("*").alias("n"))
    sides = seen.select("locale", "n", F.explode(F.array(F.struct(F.col("expected").alias("label"), F.lit(True).alias("e")), F.struct(F.col("actual").alias("label"), F.lit(False).alias("e")))).alias("x"), (F.col("expected") == F.col("actual")).alias("same"))
    by_label = sides.groupBy("locale", "x.label").agg(F.sum(F.when(F.col("x.e"), F.col("n"))).alias("support"), F.sum(F.when(F.col("x.e") & F.col("same"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("x.e"), F.col("n")).otherwise(0)).alias("said"))
    scored = by_label.where("support > 0 and not startswith(label, '__')").select("locale", f1(ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))).alias("f"))
    macro = scored.groupBy("locale").agg(F.avg("f").alias("pos_macro_f1"))
    return spans.join(macro, "locale", "left").join(evaluate(gold, predicted, key).drop("n_tokens"), "locale", "left").withColumn("pos_macro_f1", F.coalesce("pos_macro_f1", F.lit(0.0)))


def corpus_gate(evaluated: DataFrame, least: float = 0.9) -> DataFrame:
    """locale, name, passed: scores that reach the least one, and expectations, cases, references and confidences that hold throughout."""
    rows = [("pos_macro_f1", F.col("pos_macro_f1") >= least), ("span_f1", F.col("span_f1") >= least), ("exact_cases", F.col("n_exact") == F.col("n_cases")), ("confidence", F.col("n_sound") == F.col("n_predicted"))]
    rows += [(name, F.coalesce(F.col(f"{name}_passed") == F.col(f"{name}_asked"), F.lit(True))) for name in ("lemma", "form", "simplified", "unknown")]
    return evaluated.select("locale", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), test.alias("passed")) for name, test in rows))).alias("x")).select("locale", "x.name", "x.passed")


CUTS = 64  # parts that a range of values is cut into in each pass
PASSES = 64


def nearest_ranks(samples: DataFrame, fractions=(0.5, 0.95)) -> DataFrame:
    """metric, fraction, value by nearest rank for samples(metric, value): selection by counts, in bounded memory.

    A pass cuts the range that holds a rank at CUTS values, found by a sketch of bounded size, counts the parts with partial
    sums, and keeps the least and greatest value of the part that holds the rank; the next pass looks at that part only. It
    ends where both are one value. So a task holds sketches and counts of parts, never a metric's values. Infinite values and
    NaN, which is greatest, stand outside the ranges and are counted apart.
    """
    value = F.col("value").cast("double")
    kind = F.when(F.isnan(value), 3).when(value == float("inf"), 2).when(value == float("-inf"), 0).otherwise(1)
    rows = samples.where("value is not null").select("metric", value.alias("value"), kind.alias("kind"))
    finite = F.col("kind") == 1
    seen = rows.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == 0).alias("below"), F.count_if(finite).alias("inside"), F.count_if(F.col("kind") == 2).alias("above"), F.min(F.when(finite, F.col("value"))).alias("low"), F.max(F.when(finite, F.col("value"))).alias("high"))
    asked = seen.select("*", F.explode(F.array(*(F.lit(float(f)) for f in fractions))).alias("fraction"))
    asked = asked.withColumn("rank", F.greatest(F.ceil(F.col("n") * F.col("fraction")), F.lit(1)) - F.col("below"))
    outside = F.when(F.col("rank") <= 0, float("-inf")).when(F.col("rank") > F.col("inside") + F.col("above"), float("nan")).when(F.col("rank") > F.col("inside"), float("inf"))
    now = X.settled(asked.withColumn("outside", outside).select("metric", "fraction", "rank", "low", "high", "outside"))
    done = now.where("outside is not null or low = high").select("metric", "fraction", F.coalesce("outside", "low").alias("value"))
    for _ in range(PASSES):
        open_ = now.where("outside is null and low < high")
        if open_.isEmpty():
            return done
        met = rows.where(finite).join(X.small(open_.select("metric", "fraction", "low", "high")), "metric").where("value between low and high")
        # The greatest value is a cut as well, so that every pass tells it from the least.
        marks = met.groupBy("metric", "fraction").agg(F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], 10 * CUTS).alias("marks"), F.max("high").alias("top"))
        cuts = X.settled(marks.select("metric", "fraction", F.array_append("marks", F.col("top")).alias("marks")))
        part = F.size(F.filter("marks", lambda m: m <= F.col("value")))
        counts = met.join(X.small(cuts), ["metric", "fraction"]).groupBy("metric", "fraction", part.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        order = Window.partitionBy("metric", "fraction").orderBy("part")  # CUTS + 1 rows at most
        upto = counts.withColumn("upto", F.sum("n").over(order)).join(open_.select("metric", "fraction", "rank"), ["metric", "fraction"])
        held = upto.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        now = X.settled(held.select("metric", "fraction", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high", F.lit(None).cast("double").alias("outside")))
        done = done.unionByName(now.where("low = high").select("metric", "fraction", F.col("low").alias("value")))
    raise ValueError("ranges of values don't narrow")


def percentiles(samples: DataFrame, fractions=(0.5, 0.95), least: int = 1) -> DataFrame:
    """metric, n, p.. and max by nearest rank, for metrics with at least so many samples(metric, value)."""
    sums = samples.where("value is not null").groupBy("metric").agg(F.count("*").alias("n"), F.max("value").alias("max")).where(F.col("n") >= least)
    kept = samples.join(X.small(X.settled(sums.select("metric"))), "metric", "left_semi")
    kind = dict(samples.dtypes)["value"]
    wide = nearest_ranks(kept, fractions).groupBy("metric").agg(*(F.max(F.when(F.col("fraction") == float(p), F.col("value"))).cast(kind).alias(f"p{round(p * 100)}") for p in fractions))
    return sums.join(wide, "metric").select("metric", "n", *(f"p{round(p * 100)}" for p in fractions), "max")


def budget_gate(summary: DataFrame, budgets: DataFrame) -> DataFrame:
    """metric, statistic, measured, budget, passed; a budget without a measurement fails."""
    stats = [c for c in summary.columns if c not in ("metric", "n")]
    long = summary.select("metric", F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("measured")) for c in stats))).alias("s")).select("metric", "s.*")
    return budgets.join(long, ["metric", "statistic"], "left").withColumn("passed", F.coalesce(F.col("measured") <= F.col("budget"), F.lit(False)))


def first_passing(candidates: DataFrame, gates: DataFrame) -> DataFrame:
    """The first candidate(candidate, priority) that passes all of its gates(candidate, passed); none: no row."""
    ok = gates.groupBy("candidate").agg(F.bool_and("passed").alias("passed")).where("passed")
    return candidates.join(ok, "candidate", "left_semi").agg(F.min_by("candidate", "priority").alias("candidate")).where("candidate is not null")


def quality_gate(scores: DataFrame, least: float = 0.9) -> DataFrame:
    """scores(name, value, expected, passed_count) with passed."""
    return scores.withColumn("passed", (F.col("value") >= least) & (F.col("passed_count") == F.col("expected")))


# Rules of the line audit: code and pattern; any table of rules in this shape will do.
AUDIT_RULES = [
    ("TRAILING_SPACE", r"[ \t]+$"), ("CONFLICT_MARKER", r"^(<<<<<<<|=======|>>>>>>>)"), ("REMOTE_URL", r"https?://"),
    ("LICENSE_WORD", r"(?i)licen[sc]e"), ("TOKEN_ASSIGNMENT", r"token\s*="),
]


def line_audit(docs: DataFrame, rules=AUDIT_RULES, key: str = "doc_id") -> DataFrame:
    """key, line, code of every line that a rule hits; lines count from 1."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "content"))
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(pattern), F.lit(code)) for code, pattern in rules)))
    return lines.select(key, (F.col("pos") + 1).alias("line"), F.explode(hits).alias("code"))


def token_violations(tokens: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """code, n of tokens that break the contract: span, length, order, part of speech, confidence."""
    sizes = docs.select(key, F.char_length(F.coalesce("text", F.lit(""))).alias("size"))
    prior = F.max("end").over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    rows = tokens.withColumn("prior", prior).join(sizes, key, "left")
    codes = F.array_compact(F.array(
        F.when(F.col("size").isNull() | (F.col("start") < 0) | (F.col("end") > F.col("size")), F.lit("SPAN")), F.when(F.col("end") - F.col("start") != F.char_length("surface"), F.lit("LENGTH")),
        F.when(F.col("start") < F.col("prior"), F.lit("ORDER")), F.when(~F.col("pos").isin(W.POS_ORDER), F.lit("POS")), F.when(~F.col("confidence").between(0, 1), F.lit("CONFIDENCE")),
    ))
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# Capabilities that lexical providers lack, and those of them that the grammar of English tokens brings.
LEXICAL_LACKS = ["chunk", "grammar-role", "learning-state", "tense-aspect"]
ENGLISH_CAPABILITIES = ["chunk", "grammar-role", "tense-aspect"]


def diagnostics(docs: DataFrame, tokens: DataFrame, key: str = "doc_id", unavailable: list[str] = LEXICAL_LACKS) -> DataFrame:
    """key, text_length, n_tokens, n_unknown, fallback_used, unavailable for every document.

    unavailable lists in order what the providers lack; English tokens take their own capabilities off the list.
    """
    own = tokens.groupBy(key).agg(F.count("*").alias("n_tokens"), F.sum((F.col("pos") == "x").cast("long")).alias("n_unknown"), F.bool_or(F.col("source") == "bootstrap-lexicon").alias("fallback_used"), F.bool_or(F.col("language") == "en").alias("english"))
    base = docs.select(key, F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("text_length"))
    zero, every = F.lit(0).cast("long"), sorted(set(unavailable))
    names = lambda found: F.lit(found) if found else F.array().cast("array<string>")
    lacks = F.when(F.col("english"), names([c for c in every if c not in ENGLISH_CAPABILITIES])).otherwise(names(every))
    return base.join(own, key, "left").select(key, "text_length", F.coalesce("n_tokens", zero).alias("n_tokens"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), lacks.alias("unavailable"))


def source_gate(sources: DataFrame) -> DataFrame:
    """code, subject of licence-gate violations: fields, rights, addresses, hashes, one selected source a locale."""
    per_row = F.array_compact(F.array(
        F.when(F.coalesce("sourceId", F.lit("")) == "", F.lit("SOURCE_ID")), F.when(~F.coalesce(F.col("officialUrl").startswith("https://"), F.lit(False)), F.lit("URL")),
        F.when(F.col("selected") & ~(F.col("commercialUseAllowed") & F.col("redistributionAllowed")), F.lit("RIGHTS")), F.when(F.col("selected") & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("SHA256")),
        F.when(~F.col("selected") & (F.coalesce("rejectionReason", F.lit("")) == ""), F.lit("REJECTION_REASON")),
    ))
    rows = sources.select(F.explode(per_row).alias("code"), F.col("sourceId").alias("subject"))
    selected = sources.groupBy("locale").agg(F.sum(F.col("selected").cast("int")).alias("n")).where("n <> 1")
    return rows.unionByName(selected.select(F.lit("SELECTED_COUNT").alias("code"), F.col("locale").alias("subject")))


def reconcile(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """item_id, code of responses that don't answer a request exactly: missing, unexpected, repeated, another key or text."""
    r = responses.groupBy("item_id").agg(F.count("*").alias("n"), F.first("analysis_key").alias("r_key"), F.first("text").alias("r_text"))
    both = requests.select("item_id", "analysis_key", "text", F.lit(True).alias("asked")).join(r, "item_id", "full_outer")
    code = F.when(F.col("n").isNull(), "MISSING").when(F.col("asked").isNull(), "UNEXPECTED").when(F.col("n") > 1, "REPEATED").when(~F.col("r_key").eqNullSafe(F.col("analysis_key")), "KEY").when(~F.col("r_text").eqNullSafe(F.col("text")), "TEXT")
    return both.select("item_id", code.alias("code")).where("code is not null")
