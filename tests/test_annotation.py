"""Golden cases of tokens, sentences, analyses, grammar, Chinese segmentation and projection."""

from pyspark.sql import functions as F

from glossmill.functions import text as X
from glossmill.operators import chinese, english, grammar, lexicon, projection
from glossmill.plans.annotate import annotate


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def analysed(spark, text):
    rows = lexicon.seed_lexicon(spark).where("tier = 'verified' or confidence = 0.99")  # closed-class rules only
    out = annotate(docs(spark, text), rows, lexicon.seed_morphology(spark), "en")
    return out.orderBy("start").collect()


def test_offsets_and_boundaries(spark):
    rows = X.tokens(docs(spark, "The child's book. It reads", None, "")).orderBy("start").collect()
    assert [(r.surface, r.start, r.end, r.boundary) for r in rows] == [("The", 0, 3, False), ("child's", 4, 11, False), ("book", 12, 16, False), ("It", 18, 20, True), ("reads", 21, 26, False)]


def test_third_person_reading(spark):
    rows = analysed(spark, "The child reads books.")
    assert [r.pos for r in rows] == ["det", "n", "v", "n"]
    assert [r.lemma for r in rows] == ["the", "child", "read", "book"]
    assert rows[2].confidence == 0.9 and rows[2].morphology.form == "third-person-singular"
    assert [r.grammar_role for r in rows] == [None, "subject", "predicate", "object"]
    assert rows[2].tense_aspect == "simple-present"
    assert [r.chunk for r in rows] == ["noun-phrase", "noun-phrase", "verb-phrase", "verb-phrase"]


def test_progressive_after_a_sentence(spark):
    rows = analysed(spark, "A child reads books. She is reading.")
    assert [r.pos for r in rows] == ["det", "n", "v", "n", "pron", "aux", "v"]
    assert rows[-1].tense_aspect == "present-progressive" and rows[-2].grammar_role == "predicate-auxiliary"


def test_adjectives_before_nouns(spark):
    assert [r.pos for r in analysed(spark, "An important word shows meaning.")] == ["det", "adj", "n", "v", "n"]
    assert [r.pos for r in analysed(spark, "We write clear sentences.")] == ["pron", "v", "adj", "n"]


def test_unknown_word(spark):
    (row,) = analysed(spark, "Zorbled.")
    assert row.pos == "x" and row.lemma is None and row.confidence < 0.5


def test_irregular_forms(spark):
    row = analysed(spark, "children")[0]
    assert (row.lemma, row.pos, row.confidence, row.morphology.form, row.morphology.number) == ("child", "n", 0.96, "irregular", "plural")


def test_regular_candidates(spark):
    got = spark.createDataFrame([("studies",), ("stopped",), ("making",), ("glass",)], "norm string").select("norm", X.inflection_candidates(F.col("norm")).alias("c"))
    found = {r.norm: {(c.lemma, c.kind) for c in r.c} for r in got.collect()}
    assert found == {"studies": {("study", "s"), ("studie", "s")}, "stopped": {("stopp", "ed"), ("stoppe", "ed"), ("stop", "ed")}, "making": {("mak", "ing"), ("make", "ing")}, "glass": set()}


def test_longest_match(spark):
    rows = chinese.tokens(docs(spark, "我正在學習中文。"), lexicon.seed_lexicon(spark)).orderBy("start").collect()
    assert [r.surface for r in rows] == ["我", "正在", "學習", "中文"]


def test_mixed_script_overlap(spark):
    out = annotate(docs(spark, "卡拉OK works"), lexicon.seed_lexicon(spark), lexicon.seed_morphology(spark)).orderBy("start").collect()
    assert [(r.surface, r.start, r.end, r.language) for r in out] == [("卡拉OK", 0, 4, "zh-Hant"), ("works", 5, 10, "en")]


def test_unknown_han(spark):
    (row,) = chinese.tokens(docs(spark, "龘"), lexicon.seed_lexicon(spark)).collect()
    assert (row.pos, row.confidence, row.lemma) == ("x", 0.15, None)


def test_sentences(spark):
    rows = X.sentences(docs(spark, "She said “Ready?” 下一句！Last one.")).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 17), (18, 22), (22, 31)]


def test_protected_terminator(spark):
    d = docs(spark, "See v1.2 now. Done.").withColumn("keep", F.array(F.lit(6)))
    assert [r.text for r in X.sentences(d, protected="keep").orderBy("start").collect()] == ["See v1.2 now.", "Done."]


def test_hashes(spark):
    row = spark.createDataFrame([("abc", "", "學")], "a string, b string, c string").select(X.fnv_bytes(F.col("a")).alias("a"), X.fnv_units(F.col("a")).alias("u"), X.fnv_bytes(F.col("b")).alias("b"), X.utf16_length(F.lit("𠮷a")).alias("n")).first()
    assert (row.a, row.u, row.b, row.n) == (0x1A47E90B, 0x1A47E90B, 2166136261, 3)


def test_fragments(spark):
    runs = spark.createDataFrame([(1, "a", 0, 4), (1, "b", 4, 9), (1, "c", 9, 17)], "page_id long, node_id string, start int, end int")
    spans = spark.createDataFrame([(1, 7, 4, 15)], "page_id long, span_id int, start int, end int")
    rows = projection.fragments(runs, spans).orderBy("node_id").collect()
    assert [(r.node_id, r.node_start, r.node_end) for r in rows] == [("b", 0, 5), ("c", 0, 6)]


def test_density_marks_two_of_four(spark):
    rows = [(1, "en", "a", 0, 1, 0.65), (1, "en", "b", 2, 3, 0.85), (1, "en", "c", 4, 5, 0.85), (1, "en", "d", 6, 7, 0.85), (1, "en", "e", 8, 9, 0.2)]
    t = spark.createDataFrame(rows, "doc_id long, language string, surface string, start int, end int, priority double")
    marked = projection.mark(t, ["doc_id"], F.lit(0.5), F.col("priority") > 0.5).where("marked").collect()
    assert len(marked) == 2 and all(r.priority == 0.85 for r in marked)


def test_channels_ask_for_their_own_evidence(spark):
    note = "array<struct<type:string,value:string,confidence:double>>"
    rows = [
        (1, "n", 0.8, [("gloss", "a book", 0.9)], 2), (2, "n", 0.8, [("gloss", "a book", 0.3), ("simplified-pos", "n", 0.6)], 2), (3, "n", 0.8, [("simplified-pos", "v", 1.0)], 2),
        (4, "n", 0.8, None, 1), (5, "n", None, [], 2), (6, "x", 0.9, [("gloss", "", 0.9)], 2), (7, "v", 7.0, [("gloss", "to run", float("nan"))], None),
    ]
    t = spark.createDataFrame(rows, f"ix long, pos string, confidence double, annotations {note}, schema_version int").selectExpr("*", "'en' as language", "cast(null as string) as lemma", "named_struct('form', cast(null as string)) as morphology", "cast(null as string) as grammar_role", "cast(null as string) as tense_aspect", "cast(null as string) as chunk_type")
    raw = spark.createDataFrame([("p", "auto", 1.0, 0.5, "top")], "profile_id string, language_mode string, density double, min_confidence double, label_position string").withColumns({c: F.lit(c in ("posLabel", "glossHint")) for c in projection.CHANNELS})
    out = projection.decorations(t, projection.normalize_profiles(raw)).orderBy("ix").collect()
    got = [(r.label, r.shown_gloss, r.eligible, r.row_confidence) for r in out]
    assert got == [("n", "a book", True, 0.8), ("n", None, True, 0.6), (None, None, False, 0.0), (None, None, False, 0.0), (None, None, False, 0.0), (None, None, False, 0.0), ("v", None, True, 1.0)]


def test_marks_follow_priority_then_hash_of_the_token(spark):
    """The order among equal priorities is that of FNV-1a over language, surface, start and end, in UTF-16 units."""
    def fnv(text):
        h = 2166136261
        for unit in text:
            h = (h ^ ord(unit)) * 16777619 % 2**32
        return h

    words = ["The", "quick", "the", "fox’s", "quick", "語言", "The"]
    rows = [(1, "zh-Hant" if w == "語言" else "en", w, 10 * i, 10 * i + len(w), 0.85) for i, w in enumerate(words)]
    t = spark.createDataFrame(rows, "doc_id long, language string, surface string, start int, end int, priority double")
    order = sorted(rows, key=lambda r: fnv(f"{r[1]}|{r[2]}|{r[3]}|{r[4]}"))
    for n in range(1, 8):
        marked = projection.mark(t, ["doc_id"], F.lit(n / 7 - 0.01)).where("marked").collect()
        assert {r.start for r in marked} == {r[3] for r in order[:n]}


def test_large_lexicons_match_alike(spark, monkeypatch):
    lex = spark.createDataFrame([("學習", "zh-Hant"), ("習語言", "zh-Hant"), ("語言", "zh-Hant"), ("習", "zh-Hant"), ("word", "en")], "norm string, locale string")
    d = docs(spark, "學習語言x學 習語言習", None, "", "none")
    small = sorted(map(tuple, chinese.longest_matches(d, lex).collect()))
    monkeypatch.setattr(chinese, "BROADCAST_ROWS", 0)
    assert small == sorted(map(tuple, chinese.longest_matches(d, lex).collect())) and small[0] == (0, 0, 2, "學習") and len(small) == 9
    assert chinese.longest_matches(d, lex.limit(0)).where("len is not null").count() == 0


def test_long_texts_without_terminators(spark):
    """Folds and walks stay linear: 80,000 Han characters and 20,000 words in one run."""
    lex = spark.createDataFrame([("學習", "zh-Hant"), ("習語言", "zh-Hant"), ("語言", "zh-Hant")], "norm string, locale string")
    text = "學習語言x𠀀" * 16_000
    got = chinese.segment(docs(spark, text), lex)
    assert [tuple(r) for r in got.groupBy("surface", "known").count().orderBy("surface").collect()] == [("學習", True, 16_000), ("語言", True, 16_000), ("𠀀", False, 16_000)]
    assert [(r.start, r.end) for r in got.orderBy("start").limit(4).collect()] == [(0, 2), (2, 4), (5, 6), (6, 8)]
    many = spark.createDataFrame([(0, i, 1, 1000, 1) for i in range(20_000)], "doc_id long, sent_ix int, n_nodes long, n_chars long, n_tokens long")
    assert [r.chunk for r in projection.pack_chunks(many, "doc_id").orderBy("sent_ix").collect()] == [i // 4 for i in range(20_000)]


def test_segments_restore_text(spark):
    d = docs(spark, "one two three", "", None)
    spans = spark.createDataFrame([(0, 4, 7), (0, 5, 9)], "doc_id long, start int, end int")
    rows = projection.segments(d, spans).orderBy("doc_id", "seg_ix").collect()
    assert [(r.text, r.marked) for r in rows] == [("one ", False), ("two", True), (" three", False)]


def test_pack_chunks(spark):
    s = spark.createDataFrame([(1, i, 1, n, 1) for i, n in enumerate([5000, 10, 3990, 5])], "doc_id long, sent_ix int, n_nodes long, n_chars long, n_tokens long")
    assert [r.chunk for r in projection.pack_chunks(s, "doc_id").orderBy("sent_ix").collect()] == [0, 1, 1, 2]


def test_profiles(spark):
    raw = spark.createDataFrame([("p", "zh", 3.0, None, "left")], "profile_id string, language_mode string, density double, min_confidence double, label_position string").withColumns({c: F.lit(None).cast("boolean") for c in projection.CHANNELS})
    row = projection.normalize_profiles(raw).first()
    assert (row.language_mode, row.density, row.min_confidence, row.label_position, row.learningState) == ("zh-Hant", 1.0, 0.0, "top", False)
    assert projection.profile_violations(raw).first().codes == ["MODE", "DENSITY", "CONFIDENCE"]


def test_roles_stop_at_clauses(spark):
    rows = [(1, 0, "en", "n", False), (1, 1, "en", "v", False), (1, 2, "en", "n", True)]
    t = spark.createDataFrame(rows, "doc_id long, ix int, language string, pos string, clause_break boolean").withColumns({"norm": F.lit("w"), "lemma": F.lit("w"), "morphology": F.lit(None).cast(english.NO_FEATURES)})
    assert [r.grammar_role for r in grammar.roles(grammar.clauses(t)).orderBy("ix").collect()] == ["subject", "predicate", None]


def test_table_function(spark):
    from glossmill.functions import table

    table.register(spark)
    docs(spark, "It's here", None).createOrReplaceTempView("two_texts")
    rows = spark.sql("SELECT doc_id, t.surface, t.start, t.end FROM two_texts, LATERAL tokenize(text) t ORDER BY start").collect()
    assert [tuple(r) for r in rows] == [(0, "It's", 0, 4), (0, "here", 5, 9)]


def test_annotator_hook(spark):
    only_nouns = lambda tokens: tokens.where("pos = 'n'")
    out = annotate(docs(spark, "The child reads books."), lexicon.seed_lexicon(spark), lexicon.seed_morphology(spark), "en", only_nouns)
    assert sorted(r.norm for r in out.collect()) == ["books", "child"]


def test_each_language_is_analysed_once(spark):
    """Overlaps and roles are told in one pass over the tokens of both languages."""
    from glossmill.plans.annotate import annotate

    docs = spark.createDataFrame([(1, "the dog 卡拉OK runs OKs x卡拉"), (2, "OK 卡拉OK卡拉OK a"), (3, None)], "doc_id long, text string")
    han = spark.createDataFrame([("卡拉OK", "zh-Hant", "n", 0.8, "k", "verified")], "norm string, locale string, pos string, confidence double, lexical_ref string, tier string")
    lex = lexicon.seed_lexicon(spark).where("locale = 'en'").unionByName(han, allowMissingColumns=True)
    for evidence in (False, True):
        found = annotate(docs, lex, lexicon.seed_morphology(spark), "both", evidence=evidence)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
        rows = found.orderBy("doc_id", "start").collect()
        assert [(r.doc_id, r.surface, r.start, r.end, r.language) for r in rows] == [
            (1, "the", 0, 3, "en"), (1, "dog", 4, 7, "en"), (1, "卡拉OK", 8, 12, "zh-Hant"), (1, "runs", 13, 17, "en"), (1, "OKs", 18, 21, "en"), (1, "x", 22, 23, "en"), (1, "卡", 23, 24, "zh-Hant"), (1, "拉", 24, 25, "zh-Hant"),
            (2, "OK", 0, 2, "en"), (2, "卡拉OK", 3, 7, "zh-Hant"), (2, "卡拉OK", 7, 11, "zh-Hant"), (2, "a", 12, 13, "en"),
        ]
        assert all(r.grammar_role is None and r.chunk is None for r in rows if r.language != "en")
