"""Queries over the whole annotation, with SQL twins that fold analyses and walk matches by lists."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..operators import english, lexicon, projection, quality
from ..sources import pages as P
from .annotate import annotate, annotation_sets
from .catalog import CANDIDATES_SQL, FNV_SQL, HAN_FROM, HAN_TO, LEXICON_SQL, MATCHES_SQL, ORACLE_SQL, RANK_SQL, ROW_HASH_SQL, SENTENCES_SQL, HASH_SUMS_SQL, CONTENT_HASH_SQL, _BUCKET_SQL, table, TOKENS_SQL, _values, corpus, documents, han_documents, register

_CLOSED_SQL = ", ".join(f"'{p}'" for p in W.CLOSED_CLASS)
#: Every lexicon row of the main path: corpus rows, and listed words behind them.
EVERY_SQL = f"""wl AS (SELECT * FROM (VALUES {_values(W.rule_words())}) v(norm, p, c)),
ex AS (SELECT * FROM (VALUES {_values(lexicon.IRREGULAR)}) v(inflected, lemma, pos)),
lv AS (SELECT norm, pos, confidence, 'corpus:' || norm || ':' || pos AS ref, 'a form of ' || norm AS gloss, false AS closed FROM lx UNION ALL SELECT norm, p, c::DOUBLE, 'rule:' || norm, NULL, p IN ({_CLOSED_SQL}) FROM wl)"""

_SCORE_SQL = """c.confidence * 10 + (CASE WHEN c.closed THEN 100 ELSE 0 END)
  + (CASE WHEN t.prior = 'det' THEN CASE c.pos WHEN 'n' THEN 12 WHEN 'adj' THEN 10 ELSE -4 END ELSE 0 END) + (CASE WHEN t.prior = 'adj' AND c.pos = 'n' THEN 12 ELSE 0 END)
  + (CASE WHEN t.prior IN ('aux', 'modal') THEN (CASE WHEN c.pos = 'v' THEN 24 ELSE 0 END) + (CASE WHEN c.form = 'present-participle' THEN 6 ELSE 0 END) ELSE 0 END)
  + (CASE WHEN NOT t.seen AND t.prior IN ('n', 'pron') AND c.pos = 'v' THEN 12 ELSE 0 END)
  + (CASE WHEN t.seen AND c.pos = 'n' AND c.form = 'plural' THEN 20 WHEN t.seen AND c.pos = 'v' AND c.form = 'third-person-singular' THEN -20 ELSE 0 END)
  + (CASE WHEN c.pos = 'adj' AND x.next_noun THEN (CASE WHEN t.prior = 'det' THEN 8 ELSE 0 END) + (CASE WHEN t.seen THEN 12 ELSE 0 END) ELSE 0 END)"""
_BRIEF = "STRUCT(pos VARCHAR, confidence DOUBLE, form VARCHAR, closed BOOLEAN)[]"


def chosen_sql(tokens: str) -> str:
    """CTEs from a table of tokens to ch, the tokens with their chosen analyses: a fold over each sentence's list."""
    return f"""ty_ AS (SELECT DISTINCT norm FROM {tokens}), {CANDIDATES_SQL.replace("FROM ty ", "FROM ty_ ")},
an AS (SELECT t.norm, l.norm AS lemma, pos, confidence, ref, gloss, closed, '' AS form FROM ty_ t JOIN lv l USING (norm)
  UNION SELECT t.norm, l.norm, l.pos, least(confidence, 0.96)::DOUBLE, ref, gloss, closed, 'irregular' FROM ty_ t JOIN ex ON ex.inflected = t.norm JOIN lv l ON l.norm = ex.lemma AND l.pos = ex.pos
  UNION SELECT ca.norm, l.norm, pos, least(confidence, 0.9)::DOUBLE, ref, gloss, closed, CASE kind || pos WHEN 'sn' THEN 'plural' WHEN 'sv' THEN 'third-person-singular' WHEN 'ingv' THEN 'present-participle' WHEN 'edv' THEN 'past-or-participle' WHEN 'eradj' THEN 'comparative' ELSE 'superlative' END
    FROM ca JOIN lv l ON l.norm = ca.lemma WHERE kind || pos IN ('sn', 'sv', 'ingv', 'edv', 'eradj', 'estadj')),
op AS (SELECT norm, list({{'pos': pos, 'confidence': confidence, 'form': form, 'closed': closed}} ORDER BY confidence DESC, {RANK_SQL}, ref) AS o, list({{'lemma': lemma, 'gloss': gloss}} ORDER BY confidence DESC, {RANK_SQL}, ref) AS e FROM an GROUP BY norm),
me AS (SELECT t.*, coalesce(o, []) AS o, e, sum(boundary::INT) OVER w AS sentence, coalesce(lead(coalesce(len(list_filter(o, lambda c: c.pos = 'n')), 0) > 0) OVER w, false) AS next_noun FROM {tokens} t LEFT JOIN op USING (norm) WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
st AS (SELECT doc_id, list(ix ORDER BY ix) AS ixs, list({{'prior': '', 'seen': false, 'picks': []::INT[], 'o': o, 'next_noun': next_noun}} ORDER BY ix) AS l FROM me GROUP BY doc_id, sentence),
fo AS (SELECT doc_id, ixs, list_reduce(l, lambda t, x: list_transform([list_transform([list_transform(x.o, lambda c: ({_SCORE_SQL})::DOUBLE)], lambda s: coalesce(list_position(s, list_max(s)), 0)::INT)[1]],
    lambda k: {{'prior': coalesce(x.o[k].pos, ''), 'seen': t.seen OR coalesce(x.o[k].pos = 'v', false), 'picks': list_append(t.picks, k), 'o': x.o, 'next_noun': x.next_noun}})[1],
  {{'prior': '', 'seen': false, 'picks': []::INT[], 'o': []::{_BRIEF}, 'next_noun': false}}).picks AS picks FROM st),
pk AS (SELECT doc_id, unnest(ixs) AS ix, unnest(picks) AS k FROM fo),
ch AS (SELECT me.* EXCLUDE (o, e), coalesce(o[k].pos, 'x') AS pos, coalesce(o[k].confidence, 0.15) AS confidence, o[k].form AS form, e[k].lemma AS lemma, e[k].gloss AS gloss FROM me JOIN pk USING (doc_id, ix))"""


def roles_sql(rows: str) -> str:
    """CTEs from tokens in order, with cut where a clause begins, to ro: English tokens with role, tense and chunk."""
    return f"""r0 AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY ix) AS clause FROM {rows}),
r1 AS (SELECT *, min(ix) FILTER (pos = 'v') OVER w AS verb, min(ix) OVER w AS first FROM r0 WHERE language = 'en' WINDOW w AS (PARTITION BY doc_id, clause)),
r2 AS (SELECT *, max(ix) FILTER (pos IN ('n', 'pron') AND ix < verb) OVER w AS subj, min(ix) FILTER (pos IN ('n', 'pron') AND ix > verb) OVER w AS obj FROM r1 WINDOW w AS (PARTITION BY doc_id, clause)),
r3 AS (SELECT *, coalesce(pos IN ('aux', 'modal') AND ix < verb AND (subj IS NULL OR ix > subj), false) AS helps, max(ix) FILTER (ix < subj AND pos NOT IN ('det', 'adj')) OVER (PARTITION BY doc_id, clause) AS other FROM r2),
r4 AS (SELECT *, min(ix) FILTER (helps) OVER w AS help0, max(ix) FILTER (helps) OVER w AS help1, arg_max(norm, ix) FILTER (helps) OVER w AS word, arg_max(coalesce(lemma, ''), ix) FILTER (helps) OVER w AS base FROM r3 WINDOW w AS (PARTITION BY doc_id, clause)),
ro AS (SELECT *, CASE WHEN ix = subj THEN 'subject' WHEN helps THEN 'predicate-auxiliary' WHEN ix = verb THEN 'predicate' WHEN ix = obj THEN 'object' END AS role,
  CASE WHEN ix <> verb THEN NULL WHEN form = 'present-participle' AND (base = 'be' OR word IN ('am', 'is', 'are', 'was', 'were')) THEN 'progressive' WHEN form IN ('past-or-participle', 'irregular') AND (base = 'have' OR word IN ('have', 'has', 'had')) THEN 'perfect' WHEN form = 'third-person-singular' THEN 'simple-present' END AS tense,
  CASE WHEN ix BETWEEN coalesce(other + 1, first) AND subj THEN 'noun-phrase' WHEN ix BETWEEN coalesce(help0, verb) AND coalesce(obj, verb) THEN 'verb-phrase' END AS chunk FROM r4)"""


ORACLE_SQL["english_analysis"] = f"""WITH {TOKENS_SQL}, {LEXICON_SQL}, {EVERY_SQL}, {chosen_sql("tk")}, en AS (SELECT *, 'en' AS language, clause_break AS cut FROM ch), {roles_sql("en")}
SELECT doc_id, pos, count(*) AS n, count(role) AS n_roles, count(tense) AS n_tenses, count(lemma) AS n_lemmas FROM ro GROUP BY ALL"""


#: Documents of which a third is followed by Han text, their English and Chinese tokens, in one order.
MIXED_SQL = f"""mx AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', text, chr(10), translate(text, '{HAN_FROM}', '{HAN_TO}')) ELSE text END AS text FROM documents),
{TOKENS_SQL}, {LEXICON_SQL}, {EVERY_SQL}, {re.sub(r"\btk(\d?)\b", r"mk\1", TOKENS_SQL).replace("FROM documents", "FROM mx")}, {chosen_sql("mk")}, {MATCHES_SQL.replace("FROM d WHERE t <> ''", "FROM (SELECT doc_id, text AS t FROM mx) WHERE t <> ''")},
z0 AS (SELECT doc_id, list({{'c': start, 'n': coalesce(len, 0), 'at': []::INT[], 'ns': []::INT[]}} ORDER BY start) AS l FROM lm GROUP BY doc_id),
z1 AS (SELECT doc_id, list_reduce(l, lambda t, m: CASE WHEN m.c < t.c THEN t ELSE {{'c': m.c + greatest(m.n, 1), 'n': 0, 'at': list_append(t.at, m.c), 'ns': list_append(t.ns, m.n)}} END, {{'c': 0, 'n': 0, 'at': []::INT[], 'ns': []::INT[]}}) AS t FROM z0),
z2 AS (SELECT doc_id, unnest(t.at) AS start, unnest(t.ns) AS size FROM z1),
al0 AS (SELECT doc_id, 'en' AS language, norm, start, "end", clause_break, pos, confidence, form, lemma, gloss FROM ch
  UNION ALL SELECT doc_id, 'zh-Hant', NULL, start, start + greatest(size, 1), false, CASE size WHEN 2 THEN 'n' WHEN 3 THEN 'v' ELSE 'x' END, CASE WHEN size > 0 THEN 0.98 ELSE 0.15 END, '', CASE WHEN size > 0 THEN 'run' END, CASE WHEN size > 0 THEN repeat('~', size) END FROM z2),
al AS (SELECT *, language = 'en' AND (clause_break OR coalesce(lag(language) OVER w <> 'en', false)) AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end") AS ix FROM al0) WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
{roles_sql("al")},
ev AS (SELECT doc_id, language, pos, confidence, form, lemma, gloss, role, tense, chunk FROM ro UNION ALL SELECT doc_id, language, pos, confidence, form, lemma, gloss, NULL, NULL, NULL FROM al WHERE language <> 'en')"""

ORACLE_SQL["annotated"] = f"WITH {MIXED_SQL} SELECT doc_id, language, pos, count(*) AS n, count(role) AS n_roles, count(tense) AS n_tenses, count(lemma) AS n_lemmas FROM ev GROUP BY ALL"


def mixed_documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents of which a third is followed by its Han form, and a lexicon of corpus rows, listed words and Han runs with glosses."""
    docs, han = han_documents(spark, sf_dir)
    plain = documents(spark, sf_dir)
    mixed = F.when(plain.doc_id % 3 == 0, F.concat_ws(" ", plain.text, F.lit("\n"), docs.text)).otherwise(plain.text)
    rows = lexicon.provider_chain(corpus(spark, sf_dir)[1], lexicon.seed_lexicon(spark).where("tier = 'fallback'"))
    every = rows.unionByName(han.withColumn("gloss", F.repeat(F.lit("~"), F.char_length("norm"))), allowMissingColumns=True)
    return plain.join(docs, "doc_id").select("doc_id", mixed.alias("text")), every


@register("annotation_glosses", f"""WITH {MIXED_SQL}, sh AS (SELECT doc_id, language, gloss IS NOT NULL AND confidence >= 0.7 AS g, form <> '' AND confidence >= 0.7 AS f, pos <> 'x' AND CASE language WHEN 'en' THEN confidence ELSE 0.8 END >= 0.7 AS p, length(gloss) AS size,
  CASE WHEN pos = 'x' THEN 2 WHEN language = 'en' THEN 3 + 2 * (gloss IS NOT NULL)::INT + (form <> '')::INT + (role IS NOT NULL)::INT + (tense IS NOT NULL)::INT + (chunk IS NOT NULL)::INT ELSE 6 END + CASE WHEN pos = 'x' AND language = 'en' THEN (chunk IS NOT NULL)::INT ELSE 0 END AS notes FROM ev)
SELECT doc_id, language, count(*) AS n_tokens, count(*) FILTER (g) AS n_glosses, coalesce(sum(size) FILTER (g), 0)::BIGINT AS gloss_chars, count(*) FILTER (f) AS n_forms, count(*) FILTER (p) AS n_labels, count(*) FILTER (g OR f OR p) AS n_eligible, sum(notes)::BIGINT AS n_annotations FROM sh GROUP BY ALL""")
def annotation_glosses(spark, sf_dir):
    """From texts to shown glosses: annotated tokens with their evidence, through a profile that shows glosses, forms and labels."""
    docs, every = mixed_documents(spark, sf_dir)
    tokens = annotate(docs, every, lexicon.seed_morphology(spark), "both", evidence=True)
    raw = spark.createDataFrame([("glosses", "auto", 1.0, 0.7, "top")], "profile_id string, language_mode string, density double, min_confidence double, label_position string").withColumns({c: F.lit(c in ("posLabel", "morphology", "glossHint")) for c in projection.CHANNELS})
    shown = projection.decorations(tokens, projection.normalize_profiles(raw))
    size = F.sum(F.char_length("shown_gloss"))
    return shown.groupBy("doc_id", "language").agg(F.count("*").alias("n_tokens"), F.count("shown_gloss").alias("n_glosses"), F.coalesce(size, F.lit(0)).alias("gloss_chars"), F.count("shown_form").alias("n_forms"), F.count("label").alias("n_labels"), F.count_if("eligible").alias("n_eligible"), F.sum(F.size("annotations")).alias("n_annotations"))


_MODE_SQL = "CASE WHEN e = z THEN 'both' WHEN z THEN 'zh-Hant' ELSE 'en' END"


@register("annotation_sets", f"""WITH {MIXED_SQL}, n AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (pos = 'x') AS n_unknown, bool_or(language = 'en') AS en FROM ev GROUP BY doc_id),
h AS (SELECT doc_id, text, {_MODE_SQL} AS mode FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_matches(text, '[A-Za-z]') AS e, regexp_matches(text, '\\p{{Han}}') AS z FROM mx))
SELECT h.doc_id, 'annotation-set:' || format('{{:08x}}', {FNV_SQL.format("mode || chr(0) || text || chr(0) || 'lexicon' || chr(0) || '1'")}) AS set_id, mode AS language_mode, length(text)::BIGINT AS text_length, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_unknown, 0) AS n_unknown,
  CASE WHEN en THEN 'learning-state' ELSE 'chunk,grammar-role,learning-state,tense-aspect' END AS unavailable FROM h LEFT JOIN n USING (doc_id)""")
def sets_of_annotations(spark, sf_dir):
    """The annotation set of each mixed document: its id, resolved mode, sizes and what its tokens can't tell."""
    docs, every = mixed_documents(spark, sf_dir)
    tokens = annotate(docs, every, lexicon.seed_morphology(spark), "auto", evidence=True)
    found = annotation_sets(docs, tokens, "2026-01-01T00:00:00+00:00", "auto")
    return found.select("doc_id", "set_id", "language_mode", "text_length", "n_tokens", "n_unknown", F.array_join("unavailable_capabilities", ",").alias("unavailable"))


@register("gloss_index", f"WITH {TOKENS_SQL}, {LEXICON_SQL}, g AS (SELECT DISTINCT 'a form of ' || norm AS gloss FROM lx) SELECT gloss, row_number() OVER (ORDER BY gloss) - 1 AS gloss_ix FROM g")
def gloss_index(spark, sf_dir):
    return lexicon.gloss_index(corpus(spark, sf_dir)[1])


@register("manifest_update", f"""WITH {TOKENS_SQL}, {LEXICON_SQL}, n AS (SELECT norm, pos, confidence FROM lx WHERE length(norm) % 5 <> 0 UNION ALL SELECT norm, pos, 0.25::DOUBLE FROM lx WHERE length(norm) % 7 = 0),
h AS (SELECT ({_BUCKET_SQL})::INT AS bucket, {ROW_HASH_SQL} AS h FROM n) SELECT 'en' AS locale, bucket, n_rows, {CONTENT_HASH_SQL} AS content_hash FROM (SELECT bucket, {HASH_SUMS_SQL} FROM h GROUP BY bucket)""")
def manifest_update(spark, sf_dir):
    """The manifest after rows of some lengths were deleted and others inserted, from the sums alone; the twin hashes the changed table."""
    rows = lexicon.bucketed(corpus(spark, sf_dir)[1], 64)
    size = F.char_length("norm")
    after = lexicon.changed_sums(lexicon.content_sums(rows), rows.where(size % 7 == 0).withColumn("confidence", F.lit(0.25)), rows.where(size % 5 == 0))
    return after.select("locale", "bucket", "n_rows", lexicon.content_hash().alias("content_hash"))


@register("registry_once", f"""WITH {TOKENS_SQL}, {LEXICON_SQL}, u AS (SELECT norm, pos, 0 AS o FROM lx WHERE length(norm) % 2 = 0 UNION ALL SELECT norm, pos, 1 FROM lx WHERE length(norm) % 5 < 3 UNION ALL SELECT norm, 'x', 2 FROM ty)
SELECT norm, pos, o AS index_order FROM u QUALIFY o = min(o) OVER (PARTITION BY norm)""")
def registry_once(spark, sf_dir):
    """Precedence among indexes of which two come twice, the second time in another order: equal content is registered once."""
    found, lex = corpus(spark, sf_dir)
    even, low = lex.where(F.char_length("norm") % 2 == 0), lex.where(F.char_length("norm") % 5 < 3)
    types = found.select("norm").distinct().select("norm", F.lit("en").alias("locale"), F.lit("x").alias("pos"))
    return lexicon.registry(lexicon.unlike([even, even.orderBy("pos"), low, even, low.orderBy("norm")]), types).select("norm", "pos", "index_order")


@register("stored_lookup", f"""WITH {TOKENS_SQL}, {LEXICON_SQL}, b0 AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:[''’][A-Za-z]+)*')) AS s FROM benchmark), ty_ AS (SELECT DISTINCT lower(s) AS norm FROM b0), {CANDIDATES_SQL.replace("FROM ty ", "FROM ty_ ")}
SELECT ty_.norm, lx.norm AS lemma, pos, confidence, 'verified-lexical-index' AS source FROM ty_ JOIN lx USING (norm) UNION ALL
SELECT ca.norm, ca.lemma, pos, least(confidence, 0.9)::DOUBLE, 'verified-regular-morphology' FROM ca JOIN lx ON lx.norm = ca.lemma WHERE kind || pos IN ('sn', 'sv', 'ingv', 'edv', 'eradj', 'estadj')""")
def stored_lookup(spark, sf_dir):
    """Analyses of the benchmark's words by a stored lexicon of the corpus, of which only the buckets they need are read."""
    path = f"{X.shared_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    lexicon.write_buckets(corpus(spark, sf_dir)[1], path, STORED_BUCKETS)
    types = X.settled(X.types(table(spark, sf_dir, "benchmark")).select("norm"))
    exceptions = lexicon.seed_morphology(spark).limit(0)
    rows = lexicon.stored_rows(spark, path, lexicon.needed_norms(types, exceptions), STORED_BUCKETS)
    found = english.direct(types, rows).unionByName(english.regular(types, rows))
    return found.select("norm", "lemma", "pos", "confidence", "source")


STORED_BUCKETS = 64


@register("exact_ranks", """WITH v AS (SELECT l_returnflag AS metric, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'events', value FROM events)
SELECT metric, f AS fraction, v[ceil(len(v) * f)::INT] AS value FROM (SELECT metric, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v FROM v GROUP BY metric), (VALUES (0.001::DOUBLE), (0.25), (0.5), (0.95), (1.0)) t(f)""")
def exact_ranks(spark, sf_dir):
    """Five exact ranks of prices by return flag and of events' values, selected by counts."""
    prices = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_extendedprice").cast("double").alias("value"))
    values = table(spark, sf_dir, "events").select(F.lit("events").alias("metric"), F.col("value").cast("double").alias("value"))
    return quality.nearest_ranks(prices.unionByName(values), (0.001, 0.25, 0.5, 0.95, 1.0))


#: Visible text runs by regular expressions: markup is cut out, what hides text and what breaks lines are sums over the marks before.
_HIDES, _BREAKS = "|".join(sorted(P.FILTERED - {"script", "style"})), "|".join(sorted(P.BLOCKS | {"br"}))
_MARK = "<!--.*?-->|<![^>]*>|<script[^>]*>|<style[^>]*>|</?[A-Za-z][^>]*>"
RUNS_SQL = f"""pg AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(<(script|style)[^>]*>)[^<]*(<[^/<][^<]*|</[^s<][^<]*)*', '\\1~', 'g') AS html FROM pages),
p0 AS (SELECT page_id, regexp_extract_all(html, '{_MARK}', 0, 's') AS marks, regexp_split_to_array(html, '{_MARK}', 's') AS texts FROM pg),
p1 AS (SELECT page_id, unnest(range(len(texts))) AS i, unnest(texts) AS raw, unnest(list_prepend('', marks)) AS mark FROM p0),
p2 AS (SELECT *, sum(CASE WHEN regexp_matches(mark, '^<({_HIDES}|script|style)[ >]', 'i') THEN 1 WHEN regexp_matches(mark, '^</({_HIDES}|script|style)>', 'i') THEN -1 ELSE 0 END) OVER w AS hidden, sum(regexp_matches(mark, '^</?({_BREAKS})[ />]', 'i')::INT) OVER w AS breaks, sum((raw <> '')::INT) OVER w AS node FROM p1 WINDOW w AS (PARTITION BY page_id ORDER BY i)),
p3 AS (SELECT page_id, i, node, breaks, replace(replace(replace(replace(raw, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM p2 WHERE hidden = 0 AND regexp_matches(raw, '[^\\s]')),
p4 AS (SELECT *, row_number() OVER w - 1 AS run_ix, CASE WHEN breaks > lag(breaks) OVER w THEN chr(10) ELSE '' END AS boundary FROM p3 WINDOW w AS (PARTITION BY page_id ORDER BY i)),
pr AS (SELECT page_id, run_ix::INT AS run_ix, 'n' || node AS node_id, text, ("end" - length(text))::INT AS start, "end", boundary AS boundary_before FROM (SELECT *, (sum(length(boundary) + length(text)) OVER (PARTITION BY page_id ORDER BY i))::INT AS "end" FROM p4))"""

ORACLE_SQL["page_runs"] = f"WITH {RUNS_SQL} SELECT * FROM pr"
ORACLE_SQL["page_sentences"] = f"""WITH {RUNS_SQL}, pt AS (SELECT page_id AS doc_id, string_agg(boundary_before || text, '' ORDER BY run_ix) AS text FROM pr GROUP BY page_id), {SENTENCES_SQL.replace("FROM documents", "FROM pt")}
SELECT doc_id AS page_id, (doc_id % 3) || ':' || s.start || ':' || s."end" AS record_id, sent_ix, s.start, s."end", CASE WHEN regexp_matches(s.text, '[A-Za-z]') THEN CASE WHEN regexp_matches(s.text, '\\p{{Han}}') THEN 'both' ELSE 'en' END WHEN regexp_matches(s.text, '\\p{{Han}}') THEN 'zh-Hant' ELSE 'unknown' END AS language,
  (SELECT count(*) FROM pr WHERE pr.page_id = s.doc_id AND pr.start < s."end" AND pr."end" > s.start)::INT AS n_fragments FROM s3 s"""


#: Markup that the ids of pages add to them, and what an inspection of forms finds in it.
_PLANTED = [
    ("<p>no form</p>", "", None), ('<input type="PassWord ">', "PASSWORD_TYPE", None), ('<select autocomplete="shipping cc-number"></select>', "PAYMENT_AUTOCOMPLETE", None), ('<textarea name="API Key"></textarea>', "SENSITIVE_NAME", None),
    ("<div data-private>x</div>", "PRIVATE_PRESENCE", None), ('<input type="hidden" name="password" autocomplete="one-time-code">', "", None), ("<input>" * 129 + '<input name="cvv">', "SENSITIVE_NAME", "DOM_SCAN_BUDGET_EXCEEDED"),
    ('<input name="' + "x" * 129 + '" type="password"><form role="form" name="otp" autocomplete="one-time-code">', "ONE_TIME_CODE_AUTOCOMPLETE,SENSITIVE_NAME", "DOM_SCAN_ERROR"),
    ('<input type="password" autocomplete="new-password" name="pass_word">', "PASSWORD_AUTOCOMPLETE,PASSWORD_TYPE", None), ('<div role="search" data-bwignore></div><input name="passwords">', "PRIVATE_PRESENCE", None), ('<input name="card__number!" autocomplete="cc-csc cc-exp">', "PAYMENT_AUTOCOMPLETE,SENSITIVE_NAME", None),
]


@register("planted_signals", f"WITH f AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{s}{chr(39)}, ' + ('NULL' if x is None else chr(39) + x + chr(39)) + ')' for i, (_, s, x) in enumerate(_PLANTED))}) v(i, signals, scan_failure)) SELECT page_id, signals, scan_failure FROM pages JOIN f ON page_id % {len(_PLANTED)} = i")
def planted_signals(spark, sf_dir):
    """Form signals of every page with markup planted by its id: types, autocompletion, names, private marks, budgets and faults."""
    planted = F.get(F.lit([m for m, *_ in _PLANTED]), (F.col("page_id") % len(_PLANTED)).cast("int"))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat(planted, F.coalesce("html", F.lit(""))))
    return P.form_signals(pages).select("page_id", F.array_join("signals", ",").alias("signals"), "scan_failure")


#: The pages' own addresses through the SQL of url_policy, whose denylist they have none of.
_POLICY_HEAD, _POLICY_REST = ORACLE_SQL["url_policy"].split("\np0 AS (", 1)
ORACLE_SQL["page_signals"] = f"""{_POLICY_HEAD}
p0 AS (SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)), '[^a-z0-9-]+'), lambda w: w <> ''), ' ') AS words, false AS ambiguous, false AS other, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, false AS slash, false AS userinfo FROM pages),
p1 AS {_POLICY_REST.split(chr(10) + "p1 AS ", 1)[1].replace("WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'USER_DENYLIST' ", "")}"""
