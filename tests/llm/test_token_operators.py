"""Alignment, packing and the trie against plain Python over whole tables, with their defined edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import alignment, packing, prefix_trie, vocab
from glossmill.llm.common import stored

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, pairs string, row int, place int, bin int"
EDGE = [
    None, "", " ", "\n", "a", "word", " lead", "tail ", "tail\n", "a  b", "two\n\nlines", "a \n b", "\nfirst", "tab\tbed \t x", "end.", "a.b,c", "3.5, 4,5", ".5 ,6", "...", ".,", "a.. b", "x, ,y",
    "it's we'll I'd 'S", "<|endoftext|> text <|endoftext|>", "<s> </s> <unk> <0x41>", "▁ in piece signs", "漢字かな。句点", "naïve café, é q́. q́,", "²,³.", "\U0001f600\U0001f600 \U0001f468‍\U0001f469",
    "a b c 　 d", "\x1c\x1d x\x85y", "A" * 3000, "ab" * 2000, "word " * 9000, "null\x00sign", "İstanbul İ Σας ΣΑΣ", "a" * 70 + " b", "repeat.", "repeat.", "x" * 5 + ".\n" + "y, " * 3,
]


def edge(spark):
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(EDGE)] + [(None, "repeat.", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def texts(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


# ---------------------------------------------------------------- alignment


def alignment_rule(rows):
    """The contract, token by token."""
    import sentencepiece

    a = vocab.tokenizer(alignment.BYTES, plain_specials=True)
    b = sentencepiece.SentencePieceProcessor(model_file=f"{vocab.FOLDER}/{alignment.PIECES}")
    sign = alignment.byte_alphabet()
    linked, out = {}, []
    for n, (i, text) in enumerate(rows):
        whole = (" " + (text or "")).encode()
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        spelled = [[bytes(sign[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids[1] for p in [b.id_to_piece(x)]]]
        if any(b"".join(s) != whole for s in spelled):
            ids, spelled = [[], []], [[], []]
        ends = [np.cumsum([len(s) for s in side]).tolist() for side in spelled]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [side.index(end) + 1 for side in ends]
            groups.append([x[u:v] for x, u, v in zip(ids, at, to)])
            at = to
        pairs = Counter((x, y) for g, h in groups for x in g for y in h)
        linked[n] = pairs
        label = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append([i, len(ids[0]), len(ids[1]), len(groups), sum(pairs.values()), label and hashlib.sha256(label.encode()).hexdigest()])
    count = Counter(p for pairs in linked.values() for p in pairs)
    most = defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    for n, row in enumerate(out):
        row += [sum(t for p, t in linked[n].items() if count[p] == most[p[0]]), sum(t * count[p] for p, t in linked[n].items())]
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("broadcast_pairs", [0, 4_000_000])
def test_alignment_rule(spark, broadcast_pairs):
    for docs in (edge(spark), texts(spark)):
        linked = stored(alignment.links(docs), "linked")
        counts = alignment.pair_counts(linked, len(alignment.aligner(vocab.FOLDER).b_bytes))
        got = sorted((tuple(r) for r in alignment.score(linked, counts, broadcast_pairs).collect()), key=str)
        assert got == alignment_rule([(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.score(linked.limit(0), counts.limit(0), broadcast_pairs).count() == 0


def test_alignment_forgets_words(spark, monkeypatch):
    docs = texts(spark)
    kept = alignment.links(docs).drop("row").collect()
    known = alignment.Stretches(vocab.FOLDER)
    monkeypatch.setattr(alignment, "MOST_SIGNS", 500)
    for r in random.Random(1).sample(kept, 20):
        text = docs.where(F.col("doc_id") == r.doc_id).first().text
        (at,) = known.numbers([text])
        assert tuple(known.sums[:, at].sum(axis=1)) == (r.n_a, r.n_b, r.n_groups, r.n_links)


def test_long_repetitive_groups_stay_small():
    """Periods of 7 and 11 bytes meet every 77: the pairs of a group are counted, not listed."""
    a, b = [[1] * 1100], [[2] * 700]
    group, ids, side, owner = alignment.coalesce(a, b, np.array([0, 7, 11]), np.array([0, 7, 11]))
    (who, pair), times, links, groups = alignment.expand(group, ids, side, owner, 1, 10)
    assert groups.tolist() == [100] and links.tolist() == [100 * 11 * 7] and pair.tolist() == [12] and times.tolist() == [100 * 77]


# ---------------------------------------------------------------- packing


def test_words_are_the_tokenizer(spark):
    words, whole = packing.Words(packing.TOKENIZER, vocab.FOLDER), vocab.tokenizer(packing.TOKENIZER)
    for rows in ([t or "" for t in EDGE], [r.text or "" for r in texts(spark).collect()]):
        for text, ids in zip(rows, words.ids(rows)):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text[:80]


def check_packing(rows, got, window):
    """Every id lies in one piece, sequences are gapless and within the window; returns how many ids sequences lack."""
    whole = vocab.tokenizer(packing.TOKENIZER)
    need = Counter()
    for i, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [packing.END], "<u4")
        for start in range(0, len(ids), window):
            piece = ids[start : start + window]
            need[(i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == need
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window
    return len(by) * window - sum(r.length for r in got)


@pytest.mark.parametrize("window,bin_pieces", [(4096, 4096), (64, 50), (100, 7)])
def test_packing(spark, window, bin_pieces):
    for docs in (edge(spark), texts(spark)):
        pieces = stored(packing.cut(docs, window), "pieces")
        got = packing.pack(pieces, window, bin_pieces).collect()
        padding = check_packing([(r.doc_id, r.text) for r in docs.collect()], got, window)
        if bin_pieces > 1000 and docs.count() > 100:
            assert padding < 0.03 * sum(r.length for r in got)
    assert packing.pack(pieces.limit(0), window, bin_pieces).count() == 0


def test_best_fit_is_tightest():
    """Against a plain search over all open windows."""
    rng = random.Random(5)
    for window in (1, 2, 10, 100, 4096):
        lengths = sorted((rng.randint(1, window) for _ in range(400)), reverse=True)
        fit, room = packing.BestFit(window), {}
        for n in lengths:
            fits = [r for r in room.values() if r >= n]
            sequence, offset = fit.put(n)
            assert (room[sequence] == min(fits) if fits else sequence not in room) and offset == window - room.get(sequence, window)
            room[sequence] = room.get(sequence, window) - n
        assert fit.opened == len(room)


# ---------------------------------------------------------------- trie


def trie_rule(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    order = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c, own in order.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(order.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for seq in members:
        kids[seq[:-1]] += bool(seq)
    for seq, m in members.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] += kids[seq] == 0
            saved[seq[:d]] += (len(m) - 1) * len(seq[-1][1]) if seq else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s], sha([c for c in m if built[c] == s])) for s, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, node string, s1 int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


def check_trie(spark, rows):
    got = sorted(tuple(r) for r in prefix_trie.trie(turns(spark, rows)).collect())
    assert got == trie_rule(rows)
    return got


def test_trie_given_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(tuple(r) for r in prefix_trie.trie(table).collect()) == trie_rule([tuple(r) for r in table.collect()])


def test_trie_edges(spark):
    assert check_trie(spark, []) == []
    rows = [(100, None, None, None), (100, 3, "user", "b"), (100, 1, "user", ""), (None, 1, "user", "x"), (-5, 1, "a", "t"), (-105, 1, "a", "t"), (-100, 7, "a", "t"), (0, 0, "", "")]
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(4)]  # copies
    rows += [(c, t, "user", "same") for c in range(240, 290) for t in range(c - 239)]  # each one turn longer: a chain whose nodes all end something
    rows += [(c, 0, "user", "lone") for c in range(301, 330)]  # turnless where no other conversation gives turns
    check_trie(spark, rows)


def test_trie_random(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", None])) for c in range(400) for t in range(rng.choice([1, 2, 3, 6, 9]))]
    rows += [(450, t, "u", str(t % 3)) for t in range(300)] + [(451, t, "u", str(t % 3)) for t in range(200)]
    check_trie(spark, rows)


def test_one_conversation_over_many_partitions(spark, monkeypatch):
    """Running sums go on over the partitions' borders."""
    rows = [(7, t, "u", f"turn {t}") for t in range(500)] + [(3, 1, "u", "first"), (9, 1, "u", "last")]
    monkeypatch.setattr(type(turns(spark, rows)), "repartitionByRange", lambda self, *c, f=type(turns(spark, rows)).repartitionByRange: f(self, 9, *c))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.beginnings(turns(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.conv_id, r.rank) for r in got) == [(3, 1), *((7, t) for t in range(1, 501)), (9, 1)]
    whole = {(r.conv_id, r.rank): (r.s1, r.s2) for r in got}
    monkeypatch.undo()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {(r.conv_id, r.rank): (r.s1, r.s2) for r in prefix_trie.beginnings(turns(spark, rows)).collect()} == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_contraction_of_deep_and_wide_trees(spark):
    rng = random.Random(8)
    parent = {0: None} | {i: i - 1 for i in range(1, 150)} | {i: rng.randrange(0, 150) for i in range(150, 260)} | {i: rng.choice([259, i - 1]) for i in range(260, 400)} | {1000: None}
    value = {i: rng.randrange(100) for i in parent}
    total = Counter()
    for i in parent:
        up = i
        while up is not None:
            total[up] += value[i]
            up = parent[up]
    depth = {}
    for i in parent:
        depth[i] = 0 if parent[i] is None else depth[parent[i]] + 1
    kind = "node struct<conv_id:long,depth:long>, parent struct<conv_id:long,depth:long>, v long, w long"
    tree = spark.createDataFrame([((i, depth[i]), None if p is None else (p, depth[p]), value[i], 1) for i, p in parent.items()], kind)
    got = {r.node.conv_id: (r.v, r.w) for r in prefix_trie.subtree_totals(tree, ["v", "w"]).collect()}
    assert {i: v for i, (v, _) in got.items()} == dict(total) and got[1000] == (value[1000], 1)
