"""Each stage of the pipeline on its own input, and the whole run."""

import itertools
import random

import corpus_pipeline
from glossmill.llm import decontamination, pieces


SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        n = out.count()
        assert 0 < n <= docs.count(), name


def test_near_duplicates_keep_the_first(spark):
    rows = [(3, "one two three four"), (1, "one two three four"), (1, "one two three four"), (5, None), (6, ""), (None, "one two three four"), (9, "some other words here now")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == ["1", "5", "9", "None"]


def test_lines_keep_nulls(spark):
    docs = spark.createDataFrame([(1, "a line of some length\nx", None, None, None), (2, "a line of some length", None, None, None), (3, None, None, None, None)], DOCS)
    rows = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert rows == {1: ("a line of some length\nx", 23), 2: ("", 0), 3: (None, 0)}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    surface = pieces.load()["surface"]
    assert out and all(r.n_pieces == len(r.ids) for r in out)
    assert all(isinstance(pieces.join_pieces(r.ids, surface), str) for r in out)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def tokens(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def leaked(text, items):
    """Whether a seed hit on some diagonal has a stretch of enough agreement, tried at every place."""
    t = tokens(text)
    spots = {}
    for mask in decontamination.MASKS:
        for i in range(len(t) - len(mask) + 1):
            spots.setdefault((mask, tuple(t[i + k] for k, m in enumerate(mask) if m == "1")), []).append(i)
    for item in items:
        shifts = set()
        for mask in decontamination.MASKS:
            for j in range(len(item) - len(mask) + 1):
                shifts |= {i - j for i in spots.get((mask, tuple(item[j + k] for k, m in enumerate(mask) if m == "1")), ())}
        width = min(20, len(item))
        for s in shifts:
            same = [0 <= i + s < len(t) and t[i + s] == w for i, w in enumerate(item)]
            if max(sum(same[i : i + width]) for i in range(len(same) - width + 1)) >= 0.8 * width:
                return True
    return False


def near_groups(texts):
    """The least doc_id of each text's group: five-word shingles, Jaccard similarity of 0.8 or more, every pair compared."""
    sets = {}
    for i, t in texts.items():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for w in words if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(texts, 2):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in texts}


def with_near_copies(spark, tmp_path):
    """The small tables with copies of long texts, of which some words are changed: near ones, and ones that are too far."""
    rng = random.Random(12)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long_ = [r for r in docs.collect() if 60 < len((r.text or "").split(" ")) < 400]
    copies = []
    for n, r in enumerate(rng.sample(long_, 30)):
        words = r.text.split()  # one line, so that line dedup leaves it
        for k in rng.sample(range(len(words)), max(1, len(words) * (n % 6) // 100)):
            words[k] = f"changed{n}"
        copies.append((10_000 + n, " ".join(words), r.lang, r.source, len(" ".join(words))))
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(copies, DOCS)).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_run_against_brute_force(spark, tmp_path):
    """Every stage after the trained one is done again in plain Python on what the stage before kept."""
    folder = with_near_copies(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, folder).collect()
    first, key = {}, lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for d in kept:
        for line in d.text.split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), d.doc_id), d.doc_id)
    texts = {d.doc_id: "\n".join(x for x in d.text.split("\n") if len(key(x)) < 10 or first[key(x)] == d.doc_id) for d in kept}
    least = near_groups(texts)
    assert sum(i >= 10_000 and least[i] != i for i in texts) >= 5
    texts = {i: t for i, t in texts.items() if least[i] == i}
    items = [tokens(b.text) for b in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert all(len(x) >= decontamination.SPAN for x in items)
    texts = {i: t for i, t in texts.items() if not leaked(t, items)}
    surface = pieces.load()["surface"]
    assert {r.doc_id: pieces.join_pieces(r.ids, surface) for r in corpus_pipeline.run(spark, folder).collect()} == texts
