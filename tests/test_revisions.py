"""The revision stream against its batch form, and the gates one by one."""

from pyspark.sql import functions as F

from glossmill.streaming import revisions as R

COLUMNS = "seq long, request_id string, page_epoch int, root_id string, root_revision int, phase string, text string, language_mode string, semantic_version string, grammar_version string, profile_revision string, lexical_version string"


def requests(spark, rows):
    full = [(i, f"r{i}", e, root, rev, phase, text, "en", "1", "1", "1", "1") for i, (e, root, rev, phase, text) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS).withColumn("analysis_key", R.analysis_key())


ROWS = [
    (0, "a", 1, "bootstrap", "x"), (0, "a", 1, "lexical", "x"), (0, "a", 1, "lexical", "x"), (0, "a", 1, "bootstrap", "x2"), (0, "a", 2, "lexical", "y"),
    (0, "a", 1, "lexical", "z"), (1, "a", 0, "bootstrap", "w"), (0, "a", 9, "lexical", "v"), (0, "b", 5, "lexical", "x"),
]
STATUSES = ["ok", "ok", "duplicate", "stale", "ok", "stale", "ok", "stale", "ok"]


def test_gate(spark):
    assert [r.status for r in R.gate(requests(spark, ROWS)).orderBy("seq").collect()] == STATUSES


def test_invalid_and_cancelled(spark):
    rows = requests(spark, ROWS).withColumn("analysis_key", F.when(F.col("seq") == 4, "ak1:forged").otherwise(F.col("analysis_key")))
    cancelled = spark.createDataFrame([("r0",)], "request_id string")
    got = [r.status for r in R.gate(rows, cancelled).orderBy("seq").collect()]
    assert got[0] == "cancelled" and got[4] == "invalid" and got[5] == "ok"


def test_stream_equals_batch(spark, tmp_path):
    rows = requests(spark, ROWS)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = R.stream_gate(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert [r.status for r in spark.read.parquet(out).orderBy("seq").collect()] == STATUSES


def run(query):
    assert query.awaitTermination(60)
    assert query.exception() is None


def test_stream_cancels(spark, tmp_path):
    """A control row reaches its own micro-batch and later ones, of its root and epoch alone; it gets no answer."""
    first = requests(spark, [(0, "a", 1, "bootstrap", "x"), (0, "a", 1, "lexical", "x"), (0, "b", 1, "lexical", "x")])
    first = first.withColumn("request_id", F.lit("gone")).withColumn("phase", F.when(F.col("seq") == 1, "cancel").otherwise(F.col("phase")))
    later = requests(spark, [(0, "a", 1, "lexical", "y"), (1, "a", 1, "lexical", "y"), (0, "a", 1, "lexical", "y"), (0, "a", 1, "cancel", "z"), (0, "b", 1, "lexical", "y")])
    later = later.withColumn("request_id", F.when(F.col("seq") < 2, "gone")).withColumn("seq", F.col("seq") + 10)
    out, ck, source = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "in")
    for rows in (first, later):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run(R.stream_gate(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    got = {r.seq: r.status for r in spark.read.parquet(out).collect()}
    assert got == {0: "cancelled", 2: "ok", 10: "cancelled", 11: "ok", 12: "stale", 14: "ok"}


def test_silent_roots_are_forgotten(spark, tmp_path):
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(empty, "false")
    try:
        forgets(spark, tmp_path)
    finally:
        spark.conf.unset(empty)


def forgets(spark, tmp_path):
    rows = requests(spark, [(0, "a", 5, "lexical", "x")])
    out, ck, source = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "in")
    for batch in (rows, requests(spark, [(0, "b", 1, "lexical", "x")]), rows.withColumn("seq", F.lit(2).cast("long"))):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        run(R.stream_gate(stream, keep_ms=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    assert [r.status for r in spark.read.parquet(out).where("root_id = 'a'").collect()] == ["ok", "ok"]


def test_changes_coalesce_in_each_batch(spark, tmp_path):
    source, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    batches = [[("root", "/a/b"), ("root", "/a"), ("root", "/ab"), ("removed", "/a/b"), ("root", "/a"), (None, "/z"), ("root", None)], [("root", "/a/b")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "kind string, path string")
        df.coalesce(1).write.mode("append").parquet(source)
        run(R.coalesce_batches(spark.readStream.schema(df.schema).parquet(source), out, ck).start())
    got = sorted((r.batch, r.kind, r.path) for r in spark.read.parquet(out).collect())
    assert got == [(0, "removed", "/a/b"), (0, "root", "/a"), (0, "root", "/ab"), (1, "root", "/a/b")]


def test_degraded_lexicon(spark):
    good, bad = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(2,)], "n int")
    found = spark.createDataFrame([("HASH",)], "code string")
    assert R.lexicon_for(good, bad, found) == (bad, "degraded")
    assert R.lexicon_for(good, bad, found.limit(0)) == (good, "ready")


def test_new_work(spark):
    gated = R.gate(requests(spark, ROWS))
    done = gated.where("seq = 0").select("analysis_key")
    assert {r.text for r in R.new_work(gated, done).collect()} == {"y", "w"}


def test_incremental_annotation(spark, tmp_path):
    gated = R.gate(requests(spark, ROWS))
    gated.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(gated.schema).parquet(str(tmp_path / "in"))
    work = lambda df: df.select("analysis_key", F.length("text").alias("n"))
    for n in (1, 2):  # the second run meets stored keys only
        q = R.annotate_batches(stream, work, str(tmp_path / "out"), str(tmp_path / f"ck{n}")).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_admission(spark):
    items = spark.createDataFrame([("a", 10, 1, [1, 2]), ("a", 20, 1, [2]), ("b", 99_999, 1, [1])], "request_id string, n_chars int, n_tokens int, buckets array<int>")
    rows = {r.request_id: (r.n_items, r.n_buckets, r.admitted) for r in R.admit(items).collect()}
    assert rows == {"a": (2, 2, True), "b": (1, 1, False)}
