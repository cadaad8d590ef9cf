"""Pruned stores of results and lexicons, content hashes that follow changes, and exact ranks by counts."""

import io
import math
import random
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glossmill.functions import text as X
from glossmill.operators import english, lexicon, quality
from glossmill.streaming import revisions as R
from tests.test_revisions import requests, run


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def spoil(paths):
    for p in paths:
        p.write_bytes(b"this is no parquet file")


# ---------------------------------------------------------------- results by key


def annotated_in_batches(spark, tmp_path, batches, name="ck"):
    work = lambda df: df.select("analysis_key", F.length("text").alias("n"))
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        run(R.annotate_batches(stream, work, str(tmp_path / "out"), str(tmp_path / name)).start())


def gated(spark, texts, first):
    rows = requests(spark, [(0, f"r{first + i}", 0, "lexical", t) for i, t in enumerate(texts)])
    return R.gate(rows.withColumn("seq", F.col("seq") + first))


def test_batches_read_their_own_partitions_only(spark, tmp_path):
    annotated_in_batches(spark, tmp_path, [gated(spark, [f"text {i}" for i in range(300)], 0)])
    out = tmp_path / "out" / "batch=0"
    assert len(list(out.glob("prefix=*"))) > 100
    batch = gated(spark, ["text 7", "new text", "another new text"], 300)
    asked = {r.p for r in batch.select(R.key_prefix().alias("p")).collect()}
    keys = R.stored_keys(spark, str(tmp_path / "out"), batch, 1)
    assert "PartitionFilters: [isnotnull(batch" in plan(keys) and "prefix#" in plan(keys).split("PartitionFilters")[1].split("\n")[0] and "PushedFilters: [IsNotNull(analysis_key), GreaterThanOrEqual" in plan(keys)
    spoil([p for d in out.glob("prefix=*") if d.name.removeprefix("prefix=") not in asked for p in d.glob("*.parquet")])
    annotated_in_batches(spark, tmp_path, [batch])  # would fail on any other partition
    new = spark.read.parquet(*[str(p) for p in (tmp_path / "out").glob("batch=1/prefix=*")])
    assert sorted(r.n for r in new.collect()) == [8, 16]


def test_compacted_results_answer_alike(spark, tmp_path):
    annotated_in_batches(spark, tmp_path, [gated(spark, [f"text {i}" for i in range(k, k + 40)], k) for k in (0, 40)])
    R.compact_results(spark, str(tmp_path / "out"), str(tmp_path / "compact"))
    rows = lambda p: sorted((r.analysis_key, r.n) for r in spark.read.parquet(str(tmp_path / p)).collect())
    assert rows("out") == rows("compact") and len(rows("out")) == 80
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "compact" / "batch=-1").glob("prefix=*"))
    batch = gated(spark, ["text 3", "text 99"], 500)
    found = R.stored_keys(spark, str(tmp_path / "compact"), batch, 7)
    assert R.new_work(batch, found).select("text").collect() == [("text 99",)]


# ---------------------------------------------------------------- lexicon by bucket


def test_lookups_read_needed_buckets_only(spark, tmp_path):
    lex = lexicon.corpus_lexicon(spark.createDataFrame([(w, 9) for w in ["read", "reads", "glass", "child", "walk", *(f"word{i}" for i in range(200))]], "norm string, n long"))
    path = str(tmp_path / "lexicon")
    lexicon.write_buckets(lex, path, 64)
    types = spark.createDataFrame([("reads",), ("children",), ("walks",)], "norm string")
    exceptions = spark.createDataFrame([("children", "child", "v")], "inflected string, lemma string, pos string")
    needed = lexicon.needed_norms(types, exceptions)
    assert {"read", "reads", "child", "children", "walk", "walks"} <= {r.norm for r in needed.collect()}
    rows = lexicon.stored_rows(spark, path, needed, 64, schema=lexicon.bucketed(lex, 64).schema)
    assert "PartitionFilters: [isnotnull(locale" in plan(rows) and "bucket#" in plan(rows).split("PartitionFilters")[1].split("\n")[0]
    kept = {r.bucket for r in rows.select("bucket").distinct().collect()}
    spoil([p for d in (Path(path) / "locale=en").glob("bucket=*") if int(d.name.removeprefix("bucket=")) not in kept for p in d.glob("*.parquet")])
    whole = english.analyses(types, lex, exceptions)
    few = english.analyses(types, rows, exceptions)
    norms = lambda df: {(r.norm, tuple((o.lemma, o.pos, o.source) for o in r.options)) for r in df.collect()}
    assert len(kept) < 10 and norms(few) == norms(whole) and len(norms(whole)) == 3
    assert lexicon.stored_rows(spark, path, types.limit(0), 64, schema=rows.schema).count() == 0


# ---------------------------------------------------------------- content hashes


def test_sums_follow_inserts_and_deletes(spark):
    rng = random.Random(1)
    row = lambda i: (f"w{i}", "en", f"w{i}", "n", i / 7, f"ref{i}" if i % 3 else None)
    kind = "norm string, locale string, lemma string, pos string, confidence double, lexical_ref string"
    table = lambda ids: lexicon.bucketed(spark.createDataFrame([row(i) for i in ids], kind), 16)
    held = list(range(60)) + [5, 5]
    gone, new = rng.sample(range(60), 25) + [5], list(range(100, 130)) + [7]
    rest = list(held)
    for i in gone:
        rest.remove(i)
    after = lexicon.changed_sums(lexicon.content_sums(table(held)), table(new), table(gone))
    got = sorted(map(tuple, after.collect()))
    assert got == sorted(map(tuple, lexicon.content_sums(table(rest + new)).select(after.columns).collect()))
    emptied = lexicon.changed_sums(lexicon.content_sums(table([1])), table([]), table([1]))
    assert emptied.count() == 0


def test_equal_indexes_are_registered_once(spark):
    row = lambda w: (w, "en", w, "n", 0.5, f"r:{w}")
    kind = "norm string, locale string, lemma string, pos string, confidence double, lexical_ref string"
    a, b, c = (spark.createDataFrame([row(w) for w in words], kind) for words in ("ab", "ba", "abb"))
    assert lexicon.unlike([a, b, c, a.orderBy("norm")]) == [a, c]


# ---------------------------------------------------------------- ranks


@pytest.mark.parametrize("cuts", [2, 64])
def test_nearest_ranks(spark, monkeypatch, cuts):
    monkeypatch.setattr(quality, "CUTS", cuts)
    rng = random.Random(2)
    inf = float("inf")
    tables = {
        "ties": [1.0] * 900 + [2.0] * 100, "one": [5.5], "spread": [rng.gauss(0, 1) for _ in range(700)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(200)],
        "ends": [-inf] * 3 + [1.0, 2.0] + [inf] * 3 + [float("nan")] * 2, "huge": [-1.7e308, 1.7e308, 1.7e308], "near": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)], "nan": [float("nan")],
    }
    rows = [(m, v) for m, values in tables.items() for v in values] + [("none", None), ("one", None)]
    fractions = (0.01, 0.3, 0.5, 0.95, 1.0)
    got = {(r.metric, r.fraction): r.value for r in quality.nearest_ranks(spark.createDataFrame(rows, "metric string, value double"), fractions).collect()}
    want = {(m, f): sorted(values, key=lambda v: (math.isnan(v), v))[max(1, math.ceil(len(values) * f)) - 1] for m, values in tables.items() for f in fractions}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


def test_ranks_hold_counts_not_values(spark):
    """No plan collects values of a metric: the widest thing that a task groups is a part of a range."""
    samples = spark.range(50_000).select(F.lit("m").alias("metric"), (F.col("id") * 0.5).alias("value"))
    out = quality.percentiles(samples)
    assert "percentile" not in plan(out) and "collect_" not in plan(out)
    assert tuple(out.first()) == ("m", 50_000, 12499.5, 23749.5, 24999.5)
    assert quality.percentiles(samples.limit(0)).count() == 0 and quality.percentiles(samples, least=60_000).count() == 0


def test_settled_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        X.shared_dir(Session())
