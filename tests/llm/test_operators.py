"""The ten operators against brute force, exact round trips and held-out accuracy, with their defined edge cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossmill.llm import decontamination, language_id, licenses, line_dedup, lm, neighbours, pieces, sampling, sharding, simhash, toxicity
from glossmill.llm.sampling import remainder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "the same line of text\nanother longer line"), (6, "The Same line of text  \nshort\nshort"),
    (6, "The Same line of text  \nshort\nshort"), (7, "x" * 50_000), (None, "the same line of text"), (8, "▁ é 漢 \U0001F600\n\n tail "), (9, "a b c d e f g " * 2000),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumns({"score": F.lit(1), "slot": F.lit("x"), "h1": F.lit(2), "fp": F.lit(3), "tokens": F.lit(4)})


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def line_rule(rows):
    """The contract of line dedup, directly."""
    first = {}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else []:
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_edges(spark):
    got = line_dedup.dedup_lines(frame(spark, EDGE)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == line_rule(EDGE)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_line_dedup_hot_key(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", most)
    rows = [(i, f"one line that all documents share\nown line number {i % 700} of many" + "\n short" * (i % 3)) for i in range(2000)]
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == line_rule(rows)


def fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints, radius=3):
    """Least doc_id of each single-linkage group, over all pairs."""
    keys = sorted({f for _, f in prints})
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        least[root(f)] = min(least.get(root(f), d), d)
    return {d: least[root(f)] for d, f in prints}


def test_simhash_edges(spark):
    got = simhash.near_duplicates(frame(spark, EDGE)).collect()
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1)) for r in got) == sorted((str(i), fingerprint(t)) for i, t in EDGE)
    want = groups([(i, fingerprint(t)) for i, t in EDGE if i is not None])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_simhash_sf(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    want = groups(prints)
    assert got == {d: (f, want[d]) for d, f in prints}


@pytest.mark.parametrize("bucket", [2000, 5])
def test_links_of_dense_fingerprints(spark, bucket):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b for b in base}
    for b in base:
        for _ in range(40):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 3, bucket)).collect()}
    want = groups([(int(np.array(f, np.uint64).view(np.int64)), f) for f in fps])
    assert {f: roots.get(f, f) for f in signed} == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {501: 500}


def test_pieces_round_trip(spark):
    vocab = pieces.load()
    got = pieces.decode(pieces.encode(frame(spark, EDGE), vocab, seed=3, theta=0.3), vocab).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in EDGE)
    again = pieces.encode(frame(spark, EDGE).repartition(5), vocab, seed=3, theta=0.3).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(str((r.doc_id, r.ids)) for r in again)
    assert pieces.encode(frame(spark, []), vocab).count() == 0


@pytest.mark.parametrize("short", [30, 0])
def test_pieces_law(short, monkeypatch):
    """Sampled segmentations of a word follow the law that all its paths give."""
    monkeypatch.setattr(pieces, "SHORT", short)
    vocab = pieces.load()
    word, theta, n = "abed", 0.4, 20_000
    paths = {}

    def walk(at, ids, weight):
        if at == len(word):
            paths[tuple(ids)] = weight
        for end in range(at + 1, len(word) + 1):
            if (p := vocab["pieces"].get(word[at:end])) is not None:
                walk(end, [*ids, p[0]], weight + theta * p[1])

    walk(0, [], 0.0)
    total = sum(map(math.exp, paths.values()))
    lattices = pieces.Lattices(vocab, theta)
    ids, counts = pieces.sample([word] * n, np.arange(n, dtype=np.int64), lattices, 7)
    seen = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(seen) <= set(paths) and len(paths) > 3
    for path, weight in paths.items():
        p = math.exp(weight) / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_hypergeometric_matrix():
    counts, sizes = [5, 0, 12, 3], [7, 7, 6]
    for seed in range(50):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes and min(map(min, m)) >= 0
    rng, n = np.random.default_rng(2), 20_000
    seen = Counter(sharding.hypergeometric(rng, 10, 15, 8) for _ in range(n))
    for k in range(9):
        p = math.comb(10, k) * math.comb(15, 8 - k) / math.comb(25, 8)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    big = [sharding.hypergeometric(np.random.default_rng(k), 10**10, 39 * 10**10, 10**9) for k in range(300)]
    mean, sd = 2.5e7, math.sqrt(1e9 / 40 * 39 / 40 * (399 / 400))
    assert abs(sum(big) / 300 - mean) < 5 * sd / math.sqrt(300) and 0.8 < math.sqrt(sum((b - mean) ** 2 for b in big) / 300) / sd < 1.2
    huge = sharding.communication_matrix([6 * 10**8, 10**9, 5 * 10**8], [21 * 10**7] * 10, 4)  # more than numpy draws from
    assert [sum(r) for r in huge] == [6 * 10**8, 10**9, 5 * 10**8] and {sum(c) for c in zip(*huge)} == {21 * 10**7}


def test_sharding_edges(spark):
    rows = EDGE + [(77, "copy")] * 500
    got = sharding.shuffle_into_shards(sharding.digest(frame(spark, rows)), 40, 9).collect()
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert len(got) == len(rows) and {len(s) for s in shards.values()} <= {len(rows) // 40, len(rows) // 40 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert Counter((str(r.doc_id), r.size) for r in got) == Counter((str(i), 16 + len((t or "").encode())) for i, t in rows)
    assert len({r.shard for r in got if r.doc_id == 77}) == 40
    assert sharding.shuffle_into_shards(sharding.digest(frame(spark, [])), 40, 9).count() == 0


@pytest.mark.parametrize("split", ["2k", "512m"])
def test_sharding_when_stored_files_are_split_anew(spark, split):
    """Between the draw and the run the stored files may be read in other partitions; rows and shards stay exact."""
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for k in keys:
        spark.conf.set(k, "64k" if split == "512m" else "512m")
    try:
        out = sharding.shuffle_into_shards(spark.range(20_000, numPartitions=5), 40, 3)
        for k in keys:
            spark.conf.set(k, split)
        rows = out.select("*").collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert sorted(r.id for r in rows) == list(range(20_000)) and Counter(r.shard for r in rows) == {s: 500 for s in range(40)}
    assert len({(r.shard, r.slot) for r in rows}) == 20_000 and max(r.slot for r in rows) == 499


def test_sharding_is_repeatable(spark):
    d = sharding.digest(documents(spark)).repartition(5, "doc_id")
    a, b = (sorted(map(tuple, sharding.shuffle_into_shards(d, 7, 1).collect())) for _ in range(2))
    assert a == b


def test_sharding_keeps_columns(spark):
    """Columns of any name come back, but shard and slot are replaced."""
    names = ["block", "copy", "n", "bin", "row", "rank", "ends", "c0", "shard", "slot", "before", "place"]
    df = spark.createDataFrame([tuple(f"{i}{k}" for k in names) for i in range(30)], ", ".join(f"{k} string" for k in names))
    got = sharding.shuffle_into_shards(df, 4, 2).collect()
    assert sorted(r.block for r in got) == sorted(f"{i}block" for i in range(30)) and all(r.c0 == r.block.replace("block", "c0") for r in got)
    assert {type(r.shard) for r in got} == {int} and Counter(r.shard for r in got) == {0: 8, 1: 8, 2: 7, 3: 7}


def test_sharding_is_uniform(spark):
    """From end to end: where rows come from says nothing about shard, slot or the order of neighbours."""
    n, shards, runs = 3000, 6, 6
    df = spark.range(n, numPartitions=5)
    cells, same, later, halves = Counter(), 0, 0, Counter()
    for seed in range(runs):
        at = {r.id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, shards, 100 + 7 * seed).collect()}
        assert Counter(s for s, _ in at.values()) == {s: n // shards for s in range(shards)}
        for i in range(n):
            cells[i * 30 // n, at[i][0]] += 1
            halves[i * 30 // n] += at[i][1] < n // shards // 2
            same += i + 1 < n and at[i][0] == at[i + 1][0]
            later += i + 1 < n and at[i] < at[i + 1]
    mean = runs * n / 30 / shards
    chi = sum((cells[a, s] - mean) ** 2 / mean for a in range(30) for s in range(shards))
    assert abs(chi - 29 * 5) < 5 * math.sqrt(2 * 29 * 5)
    pairs = runs * (n - 1)
    assert abs(same / pairs - 1 / shards) < 5 * math.sqrt(1 / shards / pairs) and abs(later / pairs - 0.5) < 5 * math.sqrt(0.25 / pairs)
    assert max(abs(h - runs * n / 60) for h in halves.values()) < 5 * math.sqrt(runs * n / 120)


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(30)], [word() for _ in range(7)], [word() for _ in range(3)]]
    noise = lambda n: [word() for _ in range(n)]
    swapped = list(items[0])
    for k in (4, 11, 19, 26):
        swapped[k] = word()
    half = items[0][:13] + noise(17)
    rows = [
        (1, noise(50) + items[0] + noise(9)), (2, noise(5) + swapped), (3, noise(90)), (4, noise(3) + [w.upper() + "!" for w in items[1]] + noise(3)), (5, items[2] * 4),
        (6, noise(4) + items[1][:6] + noise(4)), (7, noise(3) + half), (8, items[0][:25]), (None, items[0]), (12, noise(30_000) + items[0]), (1, noise(50) + items[0] + noise(9)),
    ]
    rows[-1] = rows[0]
    docs = frame(spark, [(i, " ".join(t)) for i, t in rows] + [(9, None), (10, ""), (11, "a line\n " + " ".join(items[2]).upper() + ".\nan end")]).withColumn("leaked_doc", F.lit(1))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(None, "x"), (4, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.stretch) for r in decontamination.overlaps(docs, bench).collect()}
    assert got == {(1, 0): (20, 20), (2, 0): (18, 20), (4, 1): (7, 7), (8, 0): (20, 20), (11, 2): (3, 3), (12, 0): (20, 20)}
    assert sorted(str(r.doc_id) for r in decontamination.clean(docs, bench).collect()) == sorted(["3", "5", "6", "7", "9", "10", "None"])
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0 and decontamination.overlaps(docs.limit(0), bench).count() == 0


def test_decontamination_finds_all_shared_passages(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = documents(spark)
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    grams = defaultdict(set)
    for b in bench.collect():
        w = tokens(b.text)
        for i in range(len(w) - 19):
            grams[tuple(w[i : i + 20])].add(b.item_id)
    want = set()
    for d in docs.collect():
        w = tokens(d.text)
        want |= {(d.doc_id, k) for i in range(len(w) - 19) for k in grams.get(tuple(w[i : i + 20]), ())}
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench).collect()}
    assert want and want <= got


def best_runs(rows, dice=0.8):
    """The best run of words for each document and licence, over all runs of all sizes."""
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    found = {}
    for doc, text in rows:
        w = words(text)
        grams = list(zip(w, w[1:]))
        for name, wording in licenses.TEMPLATES:
            t = words(wording)
            want = Counter(zip(t, t[1:]))
            b = len(t) - 1
            for i in range(len(grams)):
                seen, m = Counter(), 0
                for j in range(i, min(len(grams), i + 2 * b)):
                    seen[grams[j]] += 1
                    m += seen[grams[j]] <= want[grams[j]]
                    d = 2 * m / (j - i + 1 + b)
                    if d >= dice:
                        found[doc, name] = min(found.get((doc, name), (0, 0, 0)), (-d, i, j))
    return {(str(doc), name): (round(-d, 9), i, j - i + 2) for (doc, name), (d, i, j) in found.items()}


def wrapped(text, width=12, sign="# "):
    w = text.split()
    return "\n".join(sign + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licenses(spark):
    rng = random.Random(7)
    code = "\n".join(f"def f{i}(x, y):\n    return x * {i} + y  # of the software, in the case of any use" for i in range(60))
    mit = " ".join(t for n, t in licenses.TEMPLATES if n == "mit" and len(t) > 600)
    bsd = max((t for n, t in licenses.TEMPLATES if n == "bsd-3-clause"), key=len).split()
    for k in range(5, len(bsd), 25):
        bsd[k] = "changed"
    rows = [
        (1, "Some words to begin with\nreleased under the MIT license\nand some to end with"), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, "MIT License"), (None, "Released under the MIT License."),
        (5, "the of and to a in"), (6, "/*\n" + wrapped(mit) + "\n*/\n" + code), (7, "Copyright 2020 somebody\n" + wrapped(" ".join(bsd), 9, " * ") + code), (8, wrapped(licenses.MIT_1, 7, "// ")), (9, ""),
        (10, "Released under the MIT License. See the file LICENSE for details."), (1, "Some words to begin with\nreleased under the MIT license\nand some to end with"), (11, "word " * 30_000 + "Released under the MIT License."),
        (12, " ".join(rng.choice(licenses.MIT_1.split()) for _ in range(400))), (13, "of the of the of the license of the license mit license released under the mit the mit license under the mit license"),
    ]
    docs = frame(spark, rows).withColumns({"template": F.lit("x"), "license": F.lit(1), "wanted": F.lit(2), "text_key": F.lit(3)})
    got = {(str(r.doc_id), r.license): (round(r.best_dice, 9), r.first_word, r.n_words) for r in licenses.scan(docs, licenses.template_table(spark)).collect()}
    assert got == best_runs([r for r in rows if len(r[1] or "") < 100_000]) | {("11", "mit"): (1.0, 30_000, 5)}
    assert {("6", "mit"), ("7", "bsd-3-clause"), ("8", "mit"), ("10", "mit"), ("None", "mit")} <= set(got) and not {"3", "4", "5", "9"} & {d for d, _ in got}
    assert licenses.scan(frame(spark, []), licenses.template_table(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.template_table(spark, [("x", "y z")] * 3000)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def recall(got, x, ids, asked):
    """Share of the true ten nearest that were found, over all queries, those without a result included."""
    hit = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = {i for _, i in sorted((v, i) for v, i in zip(d, ids) if i != q)[:10]}
        found = {i for i, _ in got.get(q, [])}
        assert all(abs(d[ids == i][0] - s) < 1e-9 for i, s in got.get(q, []))
        hit += len(best & found) / len(best)
    return hit / len(asked)


@pytest.mark.parametrize("sf, block_rows", [("sf0.1", neighbours.BLOCK_ROWS), ("sf0.1", 300), ("sf0.01", 40)])
def test_neighbours_recall(spark, sf, block_rows):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = defaultdict(list)
    for r in neighbours.search(rows, rows.where("vec_id % 100 = 0"), 10, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    pdf = rows.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    assert recall(got, x, ids, [i for i in ids if i % 100 == 0]) >= 0.9


@pytest.mark.parametrize("kind", ["sphere", "gaussian", "clusters"])
def test_neighbours_of_a_full_block(kind):
    """The shipped block size: recall against brute force, and the threshold leaves most vectors out."""
    rng, n = np.random.default_rng(5), neighbours.BLOCK_ROWS
    x = rng.normal(size=(n, 64))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "clusters":
        x = rng.normal(size=(100, 64))[rng.integers(0, 100, n)] + 0.2 * x
    ids = np.arange(n)
    block = neighbours.Block(ids, x)
    got = {q: list(zip(*block.search(x[q], 10, q))) for q in range(0, n, 100)}
    assert recall(got, x, ids, list(range(0, n, 100))) >= 0.9
    assert block.verified / block.searches / n < (0.05 if kind == "clusters" else 0.6)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [5.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [9.0, 9.0]), (None, [1.0, 0.0]), (100, [float("inf"), 0.0])]
    v = vectors(spark, rows).withColumns({c: F.lit("x") for c in ("v", "block", "kind", "id", "score", "rank")})
    got = [tuple(r) for r in neighbours.search(v, v.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    assert [(q, k, i) for q, k, i, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 8)]
    assert neighbours.search(vectors(spark, []), vectors(spark, []), 10).count() == 0


@pytest.mark.parametrize("block_rows", [8192, 7])
def test_neighbours_ties(spark, block_rows):
    """Of more than k equal distances the smaller ids answer; repeated rows and ids answer once."""
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(0, 60)] * 2 + [(5, [9.0, 9.0, 9.0])] * 15
    v = vectors(spark, rows)
    got = defaultdict(list)
    for r in neighbours.search(v, v.where("vec_id = 0"), 10, block_rows).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {0: [(i, 0.0) for i in range(1, 11)]}


@pytest.mark.parametrize("form", ["narrow", "moved", "wide", "shuffled"])
def test_lm_brute_force(spark, monkeypatch, form):
    if form == "moved":  # so few bits that words meet, and nearly all are moved
        monkeypatch.setattr(lm, "LOW", 3)
    if form == "wide":
        monkeypatch.setattr(lm, "moved_words", lambda counts: None)
    if form == "shuffled":
        monkeypatch.setattr(lm, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lm, "SHARES", 4)
    texts = [(1, "a b a b c"), (2, "a b c"), (3, None), (4, ""), (5, "z"), (2, "b c a"), (6, "A b\tc  a b"), (None, "c a q"), (None, "r q"), (7, "long words " * 20_000), (8, "x" * 90_000)]
    got = {r.doc_id: (r.n_words, r.n_seen, r.log_score, r.mean_log_score) for r in lm.scores(frame(spark, texts)).collect()}
    docs = defaultdict(list)
    for i, t in texts:
        docs[i].append((t or "").lower().split())
    uni = Counter(w for d in docs.values() for t in d for w in t)
    own = {i: Counter(p for t in d for p in zip(t, t[1:])) for i, d in docs.items()}
    every, n = sum(own.values(), Counter()), sum(uni.values())
    held = Counter(p for c in own.values() for p in c)
    assert len(got) == len(docs)
    for i, d in docs.items():
        s = sum(math.log(uni[t[0]] / n) for t in d if t)
        for (a, b), c in own[i].items():
            s += c * (math.log(every[a, b] / uni[a]) if held[a, b] > 1 else math.log(0.4 * uni[b] / n))
        words = sum(map(len, d))
        assert got[i][:2] == (words, sum(c for p, c in own[i].items() if held[p] > 1)) and abs(got[i][2] - s) < 2e-4
        assert (got[i][3] is None) == (words == 0)
    assert lm.scores(frame(spark, [])).count() == 0


def test_language_codes():
    for n in (2, 4, 5, 9):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_many_languages(spark):
    """Every label is learned, however many there are: 90 languages with letters of their own."""
    rng = random.Random(3)
    rows = []
    for n in range(90):
        letters = [chr(0x4E00 + 40 * n + k) for k in range(12)]
        rows += [(1000 * n + i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12)), f"l{n:02}") for i in range(14 if n else 400)]
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    model = language_id.learn(docs.where("key % 2 = 0"))
    assert len(model["names"]) == 90
    held = docs.where("key % 2 = 1").select(F.col("key").alias("doc_id"), "text", F.lit(True).alias("held_out"), "lang")
    got = language_id.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)


def test_samples(spark, monkeypatch):
    """Long texts give a stretch only where a label has no other; too many labels are an error."""
    monkeypatch.setattr(sampling, "MOST_CHARS", 10)
    rows = spark.createDataFrame([(1, "short a", "a"), (2, "a" * 30, "a"), (3, "b" * 10 + "middle" + "b" * 10, "b")], "key long, text string, lang string")
    assert [(r.key, r.text) for r in sampling.labelled_sample(rows, "lang", 10)] == [(1, "short a"), (3, "bbmiddlebb")]
    monkeypatch.setattr(sampling, "MOST_ROWS", 8)
    with pytest.raises(ValueError):
        sampling.labelled_sample(rows, "lang", 10)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = language_id.learn(docs.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    rows = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    edge = language_id.identify(frame(spark, EDGE).withColumn("held_out", F.lit(True)), model).collect()
    assert len(edge) == len(EDGE) and {r.lang_pred for r in edge if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in edge)
    none = language_id.learn(docs.limit(0).select(F.col("doc_id").alias("key"), "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(docs.limit(3), none).collect()} == {"und"}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(toxicity.with_labels(docs, labels))
    held = docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    rows = toxicity.score(held, model, ["doc_id", "held_out"]).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    edge = toxicity.score(frame(spark, EDGE).drop("score"), model, ["doc_id"]).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge) and all(r.predicted == 0 for r in edge if r.doc_id in (1, 2, 3))
    assert toxicity.learn(toxicity.with_labels(docs, labels.limit(0))) is None
    assert {r.score for r in toxicity.score(docs.limit(3), None, ["doc_id"]).collect()} == {0.0}


def test_long_text_pools_like_short_chunks(monkeypatch):
    model = toxicity.fit(["you idiot here", "a fine day"] * 30, [1, 0] * 30, ["en"] * 60)
    bag = ["fine", "day", "idiot", "here", "you"] * 50
    whole = toxicity.pooled(bag, toxicity.Hasher(), model)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert np.allclose(whole, toxicity.pooled(bag, toxicity.Hasher(), model))


def test_short_and_long_words_have_one_law():
    """Words added together in numpy and words added one by one get the same edges."""
    vocab = pieces.load()
    words = [" hello", "naïve", "漢字x", " ", "aaaa", "\n", "unbelievably"]
    a, b = pieces.Lattices(vocab, 0.5), pieces.Lattices(vocab, 0.5)
    a.add_short(words)
    for w in words:
        b.add_long(w)
    assert a.last == b.last and a.nodes == b.nodes

    def edges(x):
        return sorted(zip((np.searchsorted(x.first, np.arange(len(x.ids)), "right") - 1).tolist(), x.starts.tolist(), x.ids.tolist(), np.diff(x.keys, prepend=0).tolist()))

    assert [e[:3] for e in edges(a)] == [e[:3] for e in edges(b)]
    assert all(abs(e[3] - f[3]) < 1 << 20 for e, f in zip(edges(a), edges(b)) if e[3] > 0 and f[3] > 0)


def test_a_words_shares_know_no_neighbours():
    """To the bit: alone, among others and after many others a word has the same edges."""
    vocab = pieces.load()
    rng = random.Random(9)
    noise = ["".join(rng.choice("abcdefghij é漢") for _ in range(rng.randint(1, 20))) for _ in range(4000)]
    for word in (" hello", "naïveté", "unbelievably", "x" * 40, " " * 35):
        found = []
        for before, among in (([], []), (noise, []), (noise[:50], noise[50:90]), ([], noise[90:])):
            x = pieces.Lattices(vocab, 0.37)
            x.of(before) if before else None
            last = x.of([*among[:20], word, *among[20:]])[min(20, len(among[:20]))]
            low, high = x.first[last - len(word) + 1], x.first[last + 1] if last + 1 < len(x.first) else len(x.keys)
            found.append((x.keys[low:high].tolist(), x.ids[low:high].tolist()))
        assert all(f == found[0] for f in found) and found[0][0]


def test_labels_apart_draw_the_same_sample(spark):
    docs = documents(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    joined = sampling.labelled_sample(toxicity.with_labels(docs, labels).where("text is not null"), "toxic", 20)
    own = docs.where(remainder(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("key"), "text", "lang")
    apart = sampling.labelled_sample(own, "toxic", 20, labels.select(F.col("doc_id").alias("key"), "toxic"))
    assert [(r.key, r.text, r.toxic) for r in joined] == [(r.key, r.text, r.toxic) for r in apart] and len(joined) > 10


def test_neighbours_over_several_full_blocks(spark, tmp_path):
    """Recall at the shipped block size, with three blocks, on clustered vectors and on ones without any structure."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(31)
    n, dim = 3 * neighbours.BLOCK_ROWS - 500, 32
    centres = rng.normal(size=(400, dim))
    vectors = np.concatenate([centres[rng.integers(0, 400, n // 2)] + 0.3 * rng.normal(size=(n // 2, dim)), rng.normal(size=(n - n // 2, dim))])
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), dim).cast(pa.list_(pa.float64()))}), str(tmp_path / "v.parquet"))
    rows = spark.read.parquet(str(tmp_path / "v.parquet"))
    asked = list(range(0, n, 700))
    got = neighbours.search(rows, rows.where(F.col("vec_id").isin(asked)), 10).collect()
    hits = 0
    for q in asked:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 10 * len(asked) and hits >= 0.9 * len(got)
