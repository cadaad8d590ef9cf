"""Links between the tokens of two tokenizers, by interval coalescing, and how often each pair of ids is linked.

A text and the space before it are spelled by both tokenizers; byte ranges of tokens of both sides are sorted together by
start (lexsort) and running ends are kept (maximum.accumulate): a group ends where a start reaches the running maximum,
which is where tokens of both sides end. Inside a group every token of A is linked with every token of B; equal ids of a
group are counted before they are expanded, so a long repetitive group stays small.

No token of either side crosses the place before a single space, before a single line feed, or between a letter or digit and
a full stop or comma (checked against the vocabulary of B when it is loaded), so both sides end there, and so does a
group. Each distinct stretch between such places is spelled and coalesced once a worker; a document is put together from
its stretches in numpy. Documents where a space, line feed, stop or comma meets anything else there are cut by a
pattern, at the plain places only.

A document's distinct linked pairs are written once with their counts; the corpus-wide count of a pair is one grouped sum
over them. Up to BROADCAST_PAIRS counted pairs are sent to every task as sorted arrays; beyond, pairs are joined by shuffle.

Defined cases: texts that are null, empty, or that a side doesn't spell byte for byte have no tokens: zeros and an empty
groups_sha256; repeated rows count as documents of their own; ids of the rows that are linked never depend on doc_id, which may be
null; an empty table gives no rows; texts of any length are spelled whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vocab import FOLDER, Numbers, spread, text_slices, tokenizer

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
BROADCAST_PAIRS = 4_000_000  # 17 bytes each
MOST_SIGNS = 4_000_000  # characters of distinct stretches that a worker remembers
STOPS = ",."
#: Before a single space or line feed between other signs.
PLACES = re.compile(r"(?<=\S)(?=[ \n]\S)")

_known: dict = {}


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Stretches:
    """Distinct stretches of text with their tokens' groups and links, in flat arrays."""

    def __init__(self, folder: str):
        import sentencepiece

        self.a, sign = tokenizer(BYTES, folder, plain_specials=True), byte_alphabet()
        spelled = {i: bytes(sign[c] for c in p) if all(c in sign for c in p) else p.encode() for p, i in self.a.get_vocab().items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        own = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        if any(" " in p.lstrip(" ") or "\n" in p or re.search(r"[a-z0-9][,.]", p, re.I) for p in own):
            raise ValueError("pieces cross the places where texts are cut")
        #: Letters and digits before a stop that a piece of B holds together with it: not a place to cut.
        self.bound = {p[m.start()] for p in own for m in re.finditer(r".(?=[,.])", p) if p[m.start()].isalnum()}
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.decimal = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.clear()

    def clear(self) -> None:
        self.index, self.labels, self.signs = Numbers(), [], 0
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.size, self.kind = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.sums = np.zeros((4, 0), np.int64)  # tokens of A and of B, groups, links

    def spell(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B. B reads a space before a text, which replaces the stretch's own; other stretches are read behind a
        line feed, and the ids of that space and line feed are dropped."""
        a = [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s if s[0] == "\n" else "\n" + s for s in stretches], num_threads=1)
        return a, [ids if s[0] == " " else ids[1:] if s[0] == "\n" else ids[2:] for s, ids in zip(stretches, b)]

    def learn(self) -> None:
        """Spells and coalesces the stretches that were numbered since the last time. An empty one is not sound."""
        keys, self.index.new = self.index.new, []
        if not keys:
            return
        stretches = [k if k[:1] in (" ", "\n", *STOPS) else " " + k for k in keys]
        a, b = self.spell(stretches)
        whole = [b"".join([side[i] for i in ids]) == s.encode() for side, both in ((self.a_bytes, a), (self.b_bytes, b)) for ids, s in zip(both, stretches)]
        n = len(keys)
        sound = [x and y for x, y in zip(whole[:n], whole[n:])]
        a, b = ([ids if ok else [] for ids, ok in zip(side, sound)] for side in (a, b))
        group, ids, side, owner = coalesce(a, b, self.a_size, self.b_size)
        pairs, times, links, groups = expand(group, ids, side, owner, n, len(self.b_bytes))
        sizes = np.bincount(pairs[0], minlength=n)
        self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pairs, self.times = np.concatenate([self.pairs, pairs[1]]), np.concatenate([self.times, times])
        self.sums = np.concatenate([self.sums, np.array([[len(x) for x in a], [len(x) for x in b], groups, links])], axis=1)
        # Bits: 1 starts with a line feed, 2 with a stop; 4 ends with a sign, 8 with a letter or digit to cut after; 16 can't be used; 32 not spelled.
        self.kind = np.concatenate([self.kind, np.array([self._kind(k, ok) for k, ok in zip(keys, sound)], np.int8)])
        self.labels += labels_of(group, ids, side, owner, n, self.decimal)
        self.signs += sum(map(len, keys))

    def _kind(self, key: str, sound: bool) -> int:
        if not key:
            return 16
        starts = 1 if key[0] == "\n" else 2 if key[0] in STOPS else 0
        bad = key[0] == "\n" and (len(key) < 2 or key[1].isspace()) or key[0] != "\n" and key[0].isspace()
        last = key[-1]
        return starts + 4 * (not last.isspace()) + 8 * (last.isalnum() and last not in self.bound) + 16 * bad + 32 * (not sound)

    def keys(self, text: str) -> list[str]:
        """The stretches of a text cut at single spaces, line feeds and stops, as if it were regular."""
        cut = text.replace("\n", " \n")
        for stop in STOPS:
            cut = cut.replace(stop, " " + stop)
        return cut.split(" ")

    def regular(self, at: np.ndarray) -> bool:
        """Whether each stretch may follow the one before it."""
        kind = self.kind[at]
        follows, before = kind[1:], kind[:-1]
        need = np.where(follows & 2, 8, 4)
        return not (kind & 16).any() and not kind[0] & 3 and bool((before & need == need).all())

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its stretches; none for the empty."""
        if self.signs > MOST_SIGNS:
            self.clear()
        out = [self.index.of(self.keys(t)) if t else np.zeros(0, np.int64) for t in texts]
        self.learn()
        odd = [i for i, at in enumerate(out) if len(at) and not self.regular(at)]
        for i in odd:
            out[i] = self.index.of([s[1:] if s[0] == " " and s[1] not in " \n" + STOPS else s for s in PLACES.split(" " + texts[i])])
        self.learn()
        return out


def coalesce(a: list, b: list, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, id, side and owner of all tokens in byte order. a, b: ids of each owner, which spell the same bytes."""
    flat, starts, ends, owners = [], [], [], []
    for ids, size in ((a, a_size), (b, b_size)):
        flat.append(np.array([i for x in ids for i in x], np.int64))
        ends.append(np.cumsum(size[flat[-1]]))
        starts.append(ends[-1] - size[flat[-1]])
        owners.append(np.repeat(np.arange(len(ids)), [len(x) for x in ids]))
    side = np.repeat([0, 1], [len(x) for x in flat])
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((side, start))
    running = np.maximum.accumulate(end[order]) if len(order) else end
    breaks = np.concatenate([np.zeros(min(1, len(order)), bool), start[order][1:] >= running[:-1]])
    return np.cumsum(breaks), np.concatenate(flat)[order], side[order], np.concatenate(owners)[order]


def expand(group: np.ndarray, ids: np.ndarray, side: np.ndarray, owner: np.ndarray, n: int, width: int):
    """(owner, pair) of distinct pairs of ids of each owner, how often each is linked, and links and groups of the n owners.

    A pair is its A id times width, plus its B id."""
    def counted(which):
        """Distinct (group, id) of a side, sorted, and how often each occurs."""
        order = np.lexsort((ids[which], group[which]))
        g, i = group[which][order], ids[which][order]
        new = np.concatenate([np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
        at = np.flatnonzero(new)
        return g[at], i[at], np.diff(np.append(at, len(g)))

    groups = int(group[-1]) + 1 if len(group) else 0
    of = np.zeros(groups, np.int64)
    of[group] = owner
    (ga, ia, ka), (gb, ib, kb) = counted(side == 0), counted(side == 1)
    size_b = np.bincount(gb, minlength=groups)
    first_b = np.cumsum(size_b) - size_b
    left = np.repeat(np.arange(len(ga)), size_b[ga])
    right = spread(first_b[ga], size_b[ga])
    pair, times, who = ia[left] * width + ib[right], ka[left] * kb[right], of[ga][left]
    order = np.lexsort((pair, who))
    pair, times, who = pair[order], times[order], who[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]) | (who[1:] != who[:-1])]))
    total = np.add.reduceat(times, at) if len(at) else times
    links = np.zeros(n, np.int64)
    np.add.at(links, who, times)
    return (who[at], pair[at]), total, links, np.bincount(of, minlength=n)


def labels_of(group: np.ndarray, ids: np.ndarray, side: np.ndarray, owner: np.ndarray, n: int, decimal: list[str]) -> list[str]:
    """The groups of each owner as text: a1,a2|b1;a3|b2,b3"""
    out, cuts = [""] * n, np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(group) else []
    words = [decimal[i] for i in ids.tolist()]
    left = side == 0
    before = np.concatenate([[0], np.cumsum(left)])
    a, b = [w for w, s in zip(words, left.tolist()) if s], [w for w, s in zip(words, left.tolist()) if not s]
    who = owner.tolist()
    for lo, hi in zip(cuts[:-1].tolist() if len(group) else [], cuts[1:].tolist() if len(group) else []):
        x, y = int(before[lo]), int(before[hi])
        text = ",".join(a[x:y]) + "|" + ",".join(b[lo - x : hi - y])
        out[who[lo]] = out[who[lo]] + ";" + text if out[who[lo]] else text
    return out


def aligner(folder: str) -> Stretches:
    if folder not in _known:
        _known[folder] = Stretches(folder)
    return _known[folder]


def _linker(folder: str):
    def run(batches):
        from pyspark import TaskContext

        known, row = aligner(folder), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in text_slices(texts):
                numbers = known.numbers([t or "" for t in texts[lo:hi]])
                numbers = [at[:0] if (known.kind[at] & 32).any() else at for at in numbers]
                sums = np.array([known.sums[:, at].sum(axis=1) for at in numbers]).reshape(-1, 4)
                digests = [hashlib.sha256(";".join([known.labels[i] for i in at.tolist()]).encode()).hexdigest() if len(at) else "" for at in numbers]
                pairs, times = [], []
                for at in numbers:
                    flat = spread(known.first[at], known.size[at])
                    found, where = np.unique(known.pairs[flat], return_inverse=True)
                    pairs.append(found)
                    times.append(np.bincount(where, known.times[flat], len(found)).astype(np.int64))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)]
                columns = [pa.array(np.arange(row, row + hi - lo)), batch.column("doc_id").slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in sums.T), pa.array(digests, pa.string()), *lists]
                row += hi - lo
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def links(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """For each row of docs(doc_id, text): row (its number), counts of tokens, groups and links, the digest of its groups,
    and its distinct linked pairs (A id times the size of B's vocabulary, plus B id) with how often each is linked."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_linker(folder), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """pair, docs (rows that hold it), best (whether no other pair of its A id is held by more)."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counts = stored(counts, "alignment-counts")
    most = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", F.expr(f"pair div {width}")).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _scorer(shared):
    def run(batches):
        known, docs, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at, times = np.searchsorted(known, lists.flatten().to_numpy()), batch.column("times").flatten().to_numpy()
            sums = [np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, docs)]
            out = [pa.array(s[offsets[1:]] - s[offsets[:-1]], pa.int64()) for s in sums]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + out, names=[*names, "n_best", "count_sum"])

    return run


def score(linked: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """n_best and count_sum beside each row of linked: its links whose pair is a best one, and the sum of their counts."""
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if counts.count() <= broadcast_pairs:
        sorted_ = counts.toArrow().sort_by("pair")
        arrays = tuple(sorted_.column(c).to_numpy() for c in ("pair", "docs", "best"))
        scored = linked.mapInArrow(_scorer(linked.sparkSession.sparkContext.broadcast(arrays)), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
        return scored.select(*own, "n_best", "count_sum")
    each = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return linked.join(met, "row", "left").select(*own, zero("n_best"), zero("count_sum"))


def query(spark, sf_dir, folder: str = FOLDER):
    from .common import table

    linked = stored(links(table(spark, sf_dir, "documents").select("doc_id", "text"), folder), "alignment-links")
    return score(linked, stored(pair_counts(linked, len(aligner(folder).b_bytes)), "alignment-pairs"))
