"""Golden cases of dictionary files, lexicon tables, URL policy, pages and metrics."""

import pytest
from pyspark.sql import functions as F

from glossmill.operators import lexicon, policy, quality
from glossmill.sources import dictionaries as D
from glossmill.sources import pages as P

SYNSETS = """  1 header
00001740 02 r 01 a_cappella 0 000 | without accompaniment
00002621 02 a 02 able(p) 0 fit 0 001 ! 00002621 a 0101 | having means
00000001 02 q 01 bad 0 000 | unsupported type
00000002 02 n 02 short 0 000 | a word is missing
"""
CEDICT = """# comment
#! version=1
#! subversion=0
#! format=ts
#! charset=UTF-8
#! entries=3
#! date=2026-01-01T00:00:00Z
學習 学习 [xue2 xi2] /to learn/to study/
中文 中文 [Zhong1 wen2] /Chinese language/
中文 中文 [Zhong1 wen2] /Chinese language/
broken line
"""


def lines(spark, tmp_path, text, name="f.txt"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return D.read_lines(spark, str(tmp_path / name))


def test_synsets(spark, tmp_path):
    entries, rejected = D.synsets(lines(spark, tmp_path, SYNSETS))
    assert sorted((r.norm, r.pos) for r in entries.collect()) == [("a cappella", "adv"), ("able", "adj"), ("fit", "adj")]
    assert sorted((r.line_number, r.code) for r in rejected.collect()) == [(4, "HEADER"), (5, "FIELDS")]


def test_exceptions(spark, tmp_path):
    rows, rejected = D.exceptions(lines(spark, tmp_path, "axes axis ax\nlone\nwent_up go_up\n"), "n")
    assert sorted((r.inflected, r.lemma) for r in rows.collect()) == [("axes", "ax"), ("axes", "axis"), ("went up", "go up")]
    assert [r.record_ref for r in rejected.collect()] == ["lone"]


def test_cedict(spark, tmp_path):
    entries, rejected = D.cedict(lines(spark, tmp_path, CEDICT))
    assert sorted((r.surface, r.simplified, r.pos, r.confidence) for r in entries.collect()) == [("中文", "中文", "x", 0.0), ("學習", "学习", "v", 0.55)]
    assert sorted(r.code for r in rejected.collect()) == ["DUPLICATE_RECORD", "RECORD"]
    assert D.cedict_header_violations(lines(spark, tmp_path, CEDICT)).count() == 0
    bad = CEDICT.replace("charset=UTF-8", "charset=BIG5").replace("entries=3", "entries=0")
    assert sorted(r.code for r in D.cedict_header_violations(lines(spark, tmp_path, bad, "g.txt"), "2026-01-02").collect()) == ["CHARSET", "ENTRIES", "MANIFEST_DATE"]


def test_file_integrity(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    found = D.fingerprints(spark, str(tmp_path / "a.txt"))
    good = found.select(F.lit("data").alias("role"), "path", "bytes", "sha256")
    assert D.file_violations(found, good).count() == 0
    lost = good.withColumn("bytes", F.lit(4).cast("long")).unionByName(spark.createDataFrame([("x", "b.txt", 1, "0")], good.schema))
    assert sorted((r.path, r.code) for r in D.file_violations(found, lost).collect()) == [("a.txt", "BYTES"), ("b.txt", "MISSING")]


def test_gold_offsets(spark):
    cases = spark.createDataFrame([("c", "read a read", ["read", "read", "a"])], "id string, text string, surfaces array<string>")
    assert [(r.start, r.end) for r in D.gold_tokens(cases).orderBy("token_ix").collect()] == [(0, 4), (7, 11), (None, None)]


def test_gold_tokens_of_a_long_text(spark):
    import time

    words = [f"wörd{i % 7}" for i in range(60_000)]
    cases = spark.createDataFrame([(1, " ".join(words), words), (2, "a b", ["b", "a", "b"]), (3, "a b", ["", "b", None, "b"]), (4, None, ["a"]), (5, "a", None)], "id long, text string, surfaces array<string>")
    began = time.time()
    found = {(r.case_id, r.token_ix): (r.start, r.end) for r in D.gold_tokens(cases).collect()}
    assert time.time() - began < 30
    assert all(found[1, i] == (6 * i, 6 * i + 5) for i in range(60_000)) and len(found) == 60_008
    assert [found[2, i] for i in range(3)] == [(2, 3), (None, None), (None, None)]
    assert [found[3, i] for i in range(4)] == [(0, 0), (2, 3), (None, None), (None, None)] and found[4, 0] == (None, None)


def test_buckets_write_and_verify(spark, tmp_path):
    lex = lexicon.seed_lexicon(spark)
    lexicon.write_buckets(lex, str(tmp_path / "lex"), 8)
    back = spark.read.parquet(str(tmp_path / "lex"))
    own = lexicon.bucketed(lex, 8)
    assert lexicon.differences(own, back.select(own.columns).withColumn("bucket", F.col("bucket").cast("int"))).count() == 0
    a, b = lexicon.root_hash(lexicon.manifest(lex, 8)).first(), lexicon.root_hash(lexicon.manifest(lex.repartition(5), 8)).first()
    assert a == b and a.n_rows == lex.count()
    with pytest.raises(ValueError):
        lexicon.bucketed(lex, 0)


def test_integrity_and_morphology_chain(spark):
    lex = lexicon.seed_lexicon(spark)
    datasets = spark.createDataFrame([("seed",)], "dataset_id string")
    assert lexicon.integrity_violations(lex, datasets).count() == 0
    bad = lex.withColumn("pos", F.lit("noun")).withColumn("dataset_id", F.lit("gone"))
    assert {r.code for r in lexicon.integrity_violations(bad, datasets).collect()} == {"POS", "DATASET"}
    v = spark.createDataFrame([("a", "b", "n")], "inflected string, lemma string, pos string")
    f = spark.createDataFrame([("a", "c", "n"), ("d", "e", "v")], "inflected string, lemma string, pos string")
    assert sorted(tuple(r) for r in lexicon.chain_morphology(v, f).collect()) == [("a", "b", "n"), ("d", "e", "v")]


CASES = [
    ("https://www.chase.com/", False, "banking", "SENSITIVE_URL_CATEGORY"),
    ("https://chase.com.attacker.test/", True, "public", "ALLOW"),
    ("https://example.org/login", False, "authentication", "SENSITIVE_URL_CATEGORY"),
    ("https://discord.com/channels/1", False, "private-messaging", "SENSITIVE_URL_CATEGORY"),
    ("https://discord.com/blog", True, "public", "ALLOW"),
    ("https://tax.service.gov/account", False, "government-personal-data", "SENSITIVE_URL_CATEGORY"),
    ("https://sub.denied.test/", False, "user-denylist", "USER_DENYLIST"),
    ("ftp://example.org/a", False, "unsupported", "UNSUPPORTED_PROTOCOL"),
    ("https://example.org/a%2fb", False, "policy-error", "AMBIGUOUS_URL"),
    ("https://user@example.org/", False, "policy-error", "AMBIGUOUS_URL"),
    ("not a url", False, "policy-error", "INVALID_URL"),
    (None, False, "policy-error", "INVALID_URL"),
]


def test_url_matrix(spark):
    urls = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, url string")
    rows = policy.classify(urls, ["denied.test"]).orderBy("i").collect()
    assert [(r.url, r.allow, r.category, r.reason_code) for r in rows] == CASES


def test_denylist(spark):
    rows = policy.normalize_denylist(spark.createDataFrame([("B.test.",), ("b.test",), ("bad_host",), ("a.test",)], "host string"))
    assert [r.host for r in rows.collect()] == ["a.test", "b.test"]
    full = spark.createDataFrame([(f"h{i}.test",) for i in range(129)], "host string")
    assert policy.normalize_denylist(full.limit(128)).count() == 128
    with pytest.raises(ValueError):
        policy.normalize_denylist(full)


def test_topmost(spark):
    p = spark.createDataFrame([(1, "/a"), (1, "/a/b"), (1, "/c/d"), (2, "/a/b")], "batch int, path string")
    assert sorted(tuple(r) for r in policy.topmost(p).collect()) == [(1, "/a"), (1, "/c/d"), (2, "/a/b")]


HTML = "<p>One <b>two</b></p><script>x</script><nav>menu</nav><div hidden>no</div><p>three<br>four</p><input type=password name='card number'>"


#: Titles that were cut within a reference, and ampersands that begin none.
CUT = "<title>a&amp;b&amp</title><p>x &copy 2 &copy; &#38; &#38 &amp;quot; &ampx; &middot;&quot;& &</p>"


def cut_pages(spark, folder) -> str:
    spark.createDataFrame([(1, CUT), (2, "<p>&amp</p><p>&amp;amp</p>")], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_page_runs_keep_bare_references(spark, tmp_path):
    from glossmill.plans import catalog

    rows = catalog.page_runs(spark, cut_pages(spark, tmp_path)).orderBy("page_id", "run_ix").collect()
    assert [(r.text, r.start, r.end) for r in rows] == [("a&b&amp", 0, 7), ("x &copy 2 © & &#38 &quot; &ampx; ·\"& &", 8, 46), ("&amp", 0, 4), ("&amp", 5, 9)]
    assert P.parse(CUT).runs[0][1] == "a&b&"


def test_page_sentences_keep_bare_references(spark, tmp_path):
    from glossmill.plans import catalog

    rows = catalog.page_sentences(spark, cut_pages(spark, tmp_path)).orderBy("page_id", "sent_ix").collect()
    assert [(r.record_id, r.language, r.n_fragments) for r in rows] == [("1:0:7", "en", 1), ("1:8:46", "en", 1), ("2:0:4", "en", 1), ("2:5:9", "en", 1)]


def test_text_runs_and_signals(spark):
    pages = spark.createDataFrame([(1, "https://a.test/", HTML), (2, "https://a.test/", None)], "page_id long, url string, html string")
    rows = P.text_runs(pages).orderBy("run_ix").collect()
    assert [(r.text, r.start, r.boundary_before) for r in rows] == [("One ", 0, ""), ("two", 4, ""), ("three", 8, "\n"), ("four", 14, "\n")]
    found = policy.classify(P.form_signals(pages)).orderBy("page_id").collect()
    assert [r.reason_code for r in found] == ["SENSITIVE_FORM_ATTRIBUTE", "ALLOW"]


def test_macro_f1(spark):
    o = spark.createDataFrame([("n", "n"), ("v", "n"), ("n", "n")], "expected string, actual string")
    assert abs(quality.macro_f1(o).first().macro_f1 - 0.4) < 1e-12


def test_span_f1(spark):
    g = spark.createDataFrame([("c", 0, 1), ("c", 1, 3)], "case_id string, start int, end int")
    p = spark.createDataFrame([("c", 0, 1), ("c", 1, 2), ("c", 2, 3)], "case_id string, start int, end int")
    assert abs(quality.span_scores(g, p).first().f1 - 0.4) < 1e-12


def test_nearest_rank(spark):
    s = spark.createDataFrame([("m", float(v)) for v in range(1, 20)], "metric string, value double")
    row = quality.percentiles(s).first()
    assert (row.p50, row.p95, row.max) == (10.0, 19.0, 19.0)
    assert quality.percentiles(s, least=20).count() == 0


def test_source_gate(spark):
    cols = "sourceId string, locale string, officialUrl string, commercialUseAllowed boolean, redistributionAllowed boolean, selected boolean, sha256 string, rejectionReason string"
    good = [("w", "en", "https://a", True, True, True, "0" * 64, None), ("o", "en", "https://b", False, True, False, None, "licence")]
    assert quality.source_gate(spark.createDataFrame(good, cols)).count() == 0
    bad = [("w", "en", "http://a", True, False, True, "0", None), ("x", "en", "https://c", True, True, True, "0" * 64, None)]
    assert sorted(r.code for r in quality.source_gate(spark.createDataFrame(bad, cols)).collect()) == ["RIGHTS", "SELECTED_COUNT", "SHA256", "URL"]


def test_reconcile(spark):
    q = spark.createDataFrame([(1, "k1", "a"), (2, "k2", "b"), (3, "k3", "c")], "item_id int, analysis_key string, text string")
    r = spark.createDataFrame([(1, "k1", "a"), (2, "kx", "b"), (4, "k4", "d")], "item_id int, analysis_key string, text string")
    assert sorted(tuple(x) for x in quality.reconcile(q, r).collect()) == [(2, "KEY"), (3, "MISSING"), (4, "UNEXPECTED")]
