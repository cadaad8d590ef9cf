"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text is a path through the lattice of its vocabulary pieces. Encoding runs the forward sums over the
lattice and then samples a path backward, each step in proportion to the forward sum it leaves: an exact
draw from the law in which a path's weight is the product of its pieces' weights to the power `theta`.
No piece of the vocabulary holds a space (U+2581 in the file) after another sign, so the lattice of a text
falls into independent lattices of words and each distinct word's forward pass is done once a task.
Backward steps of all words of a batch are drawn together in numpy. Random numbers are hashes of the row's
key, the word's place and the step, and shares are whole numbers computed from the word alone, so a row's segmentation
never depends on its partition or batch.

The public model has merge ranks for scores; piece weights follow Zipf's law over those ranks. Characters
without a piece, such as U+2581 itself, are written as byte pieces, so decode(encode(text)) == text for any text.

Defined cases: a null text gives null ids and decodes to null; an empty text gives no ids; null keys count as
one key; repeated rows get equal segmentations; a word of any length is one lattice of linear size; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
RARE = -20.0  # log weight of a character without a piece
LONE = 1 << 20  # ids from here on stand for characters that are written as bytes
MOST_EDGES = 700_000  # lattice edges that a task remembers


def load(model_file: str = MODEL) -> dict:
    """Pieces of a SentencePiece model, with spaces for marks: ids and weights, byte pieces, surfaces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids, surface = {}, np.zeros(256, np.int32), [b""] * sp.get_piece_size()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = piece.replace(MARK, " ")
            pieces[piece] = (i, -math.log(2 + min(-sp.get_score(i), 1e6)))
            surface[i] = piece.encode()
    if any(" " in p.lstrip(" ") or "\n" in p and len(p) > 1 for p in pieces):
        raise ValueError("pieces cross word limits; this encoder needs a model split by white space")
    return {"pieces": pieces, "byte_ids": byte_ids, "surface": surface, "longest": max(map(len, pieces))}


#: Independent lattices: a line feed, a run of spaces with the word after it, or a word.
PARTS = re.compile("\n| +[^ \n]*|[^ \n]+")


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = np.uint64(0x5851F42D4C957F2D)
ONE = 1 << 53
SHORT = 30  # characters of a word that is added together with others


class Lattices:
    """Forward passes of distinct words, as edges sorted by their end node.

    An edge's key is the cumulated share of its end node's forward sum, as a whole number of 2^-53; it is computed from
    the word alone, to the bit. The edge's start is negative where the lattice begins. Short words are added together in numpy: substrings are looked up by rolling
    hashes in tables of piece prefixes, length by length, and sums advance over all words at once. Longer
    words are added one by one with rescaled sums.
    """

    def __init__(self, vocab: dict, theta: float = 1.0):
        self.vocab, self.longest, self.rare = vocab, vocab["longest"], math.exp(theta * RARE)
        self.weights = {p: (i, math.exp(theta * w)) for p, (i, w) in vocab["pieces"].items()}
        self.tables = [self._table(n) for n in range(1, self.longest + 1)]
        self.clear()

    def _table(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of all piece prefixes of n characters, with id (-1: no piece) and weight."""
        prefixes = sorted({p[:n] for p in self.weights if len(p) >= n})
        h = np.zeros(len(prefixes), np.uint64)
        for k in range(n):
            h = h * BASE + np.array([ord(p[k]) for p in prefixes], np.uint64) + np.uint64(1)
        found = [self.weights.get(p, (-1, 0.0)) for p in prefixes]
        order = h.argsort()
        if len(np.unique(h)) < len(h):
            raise ValueError("piece prefixes collide under the rolling hash")
        return h[order], np.array([f[0] for f in found], np.int32)[order], np.array([f[1] for f in found])[order]

    def clear(self):
        self.last, self.nodes = {}, 0
        self.keys, self.ids, self.starts, self.first = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, words, sizes, keys, ids, starts, ends):
        """Appends words whose nodes follow the known ones; edges are sorted by end node."""
        count = int(sizes.sum()) + len(sizes)
        first = np.searchsorted(ends, np.arange(self.nodes, self.nodes + count)) + len(self.keys)
        self.last.update(zip(words, (self.nodes + np.cumsum(sizes + 1) - 1).tolist()))
        self.nodes += count
        self.keys, self.ids, self.starts, self.first = (np.concatenate(x) for x in ((self.keys, keys), (self.ids, ids), (self.starts, starts), (self.first, first)))

    def add_short(self, words: list[str]) -> None:
        sizes = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), sizes)
        stop = np.cumsum(sizes)[word]
        offset = np.arange(len(chars)) - (np.cumsum(sizes) - sizes)[word]
        node = self.nodes + np.arange(len(chars)) + word  # the node before each character
        live, h, edges = np.arange(len(chars)), np.zeros(len(chars), np.uint64), []
        for n, (hashes, ids, weights) in enumerate(self.tables, 1):
            fits = live + n <= stop[live]
            live, h = live[fits], h[fits]
            h = h * BASE + chars[live + n - 1].astype(np.uint64) + np.uint64(1)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            ok = hashes[at] == h
            piece = np.where(ok, ids[at], -1)
            if n == 1:  # characters without a piece of their own
                lone = live[piece < 0]
                edges.append((lone, np.ones(len(lone), np.int64), LONE + chars[lone].astype(np.int32), np.full(len(lone), self.rare)))
            whole = piece >= 0
            edges.append((live[whole], np.full(int(whole.sum()), n), piece[whole], weights[at[whole]]))
            live, h = live[ok], h[ok]
            if not len(live):
                break
        at, length, piece, weight = (np.concatenate(x) for x in zip(*edges))
        start, end_offset = node[at], offset[at] + length
        end = start + length
        by = end_offset.astype(np.uint16).argsort(kind="stable")
        cuts = np.searchsorted(end_offset[by], np.arange(1, int(sizes.max()) + 2))
        alpha = np.zeros(len(chars) + len(words))
        local = lambda x: x - self.nodes
        alpha[np.cumsum(sizes + 1) - sizes - 1] = 1.0
        flow = np.empty(len(at))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                e = by[lo:hi]
                flow[e] = alpha[local(start[e])] * weight[e]
                np.add.at(alpha, local(end[e]), flow[e])
        order = end.argsort(kind="stable")
        end, start, piece = end[order], start[order], piece[order]
        # Whole numbers add up without rounding, and differences survive an overflow, so no word sees its neighbours.
        run = np.cumsum((flow[order] / alpha[local(end)] * ONE).astype(np.int64))
        fresh = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        groups = np.diff(np.append(fresh, len(end)))
        keys = run - np.repeat(np.append(0, run[fresh[1:] - 1]), groups)
        keys[fresh + groups - 1] = ONE
        starts = np.where(offset[at[order]] == 0, -1, start)
        self._keep(words, sizes, keys, piece, starts, end)

    def add_long(self, word: str) -> None:
        """Forward sums in plain floats, rescaled where they get small, and the edges they give."""
        get, longest, base = self.weights.get, self.longest, self.nodes
        keys, ids, starts, ends, alpha = [], [], [], [], [1.0]
        for end in range(1, len(word) + 1):
            total, shares, single = 0.0, [], False
            for start in range(end - longest if end > longest else 0, end):
                found = get(word[start:end])
                if found is not None:
                    total += alpha[start] * found[1]
                    shares.append(total)
                    ids.append(found[0])
                    starts.append(base + start if start else -1)
                    single = start == end - 1
            if not single:  # no piece for this character alone
                total += alpha[end - 1] * self.rare
                shares.append(total)
                ids.append(LONE + ord(word[end - 1]))
                starts.append(base + end - 1 if end > 1 else -1)
            keys += [int(x / total * ONE) for x in shares]
            keys[-1] = ONE
            ends += [base + end] * len(shares)
            alpha.append(total)
            if total < 1e-200:  # only the last sums are looked at again
                alpha[-longest:] = [x / total for x in alpha[-longest:]]
        self._keep([word], np.array([len(word)]), np.array(keys, np.int64), np.array(ids, np.int32), np.array(starts, np.int64), np.array(ends, np.int64))

    def of(self, words: list[str]) -> np.ndarray:
        """The last node of each word's lattice."""
        if len(self.keys) > MOST_EDGES:
            self.clear()
        last = self.last
        new = [w for w in set(words) if w not in last]
        if short := [w for w in new if len(w) <= SHORT]:
            self.add_short(short)
        for w in new:
            if len(w) > SHORT:
                self.add_long(w)
        return np.array([last[w] for w in words], np.int64)


def sample(texts: list, keys: np.ndarray, lattices: Lattices, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each text has."""
    own = [PARTS.findall(t) if t else [] for t in texts]
    counts = np.array([len(x) for x in own], np.int64)
    words = [w for x in own for w in x]
    if not words:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    owners = np.repeat(np.arange(len(texts)), counts)
    node = lattices.of(words)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    state = mix(mix(keys.view(np.uint64) ^ np.uint64(seed))[owners] + place.astype(np.uint64))
    live, steps, length = np.arange(len(words)), [], np.zeros(len(words), np.int64)
    while len(live):
        target = (mix(state + np.uint64(len(steps))) >> np.uint64(11)).astype(np.int64)
        at = lattices.first[node]
        more = np.flatnonzero(lattices.keys[at] <= target)
        while len(more):
            at[more] += 1
            more = more[lattices.keys[at[more]] <= target[more]]
        steps.append((live, lattices.ids[at]))
        length[live] += 1
        node = lattices.starts[at]
        on = node >= 0
        live, node, state = live[on], node[on], state[on]
    ends = np.cumsum(length)
    ids = np.empty(ends[-1], np.int32)
    for k, (word, piece) in enumerate(steps):  # sampled from the end of each word
        ids[ends[word] - 1 - k] = piece
    return as_bytes(ids, np.repeat(owners, length), lattices.vocab["byte_ids"], len(texts))


def as_bytes(ids: np.ndarray, who: np.ndarray, byte_ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with each lone character spelled in byte pieces, and their number for each of n texts."""
    lone = np.flatnonzero(ids >= LONE)
    if len(lone):
        raw = [chr(c - LONE).encode("utf-8", "surrogatepass") for c in ids[lone].tolist()]
        own = np.array([len(r) for r in raw])
        sizes = np.ones(len(ids), np.int64)
        sizes[lone] = own
        first = np.cumsum(sizes) - sizes
        out = np.repeat(ids, sizes)
        spread = np.repeat(first[lone] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        out[spread] = byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ids, who = out, np.repeat(who, sizes)
    return ids, np.bincount(who, minlength=n).astype(np.int64)


def _parts_of(texts: list, most: int = 250_000):
    """Slices of texts of about so many characters, so that a batch of long texts takes no more memory."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= most:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encoder(shared, seed: int, theta: float):
    def run(batches):
        lattices = Lattices(shared.value, theta)
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("row_key").to_numpy()
            for lo in range(0, batch.num_rows, 512):
                part = texts.slice(lo, 512).to_pylist()
                for a, b in _parts_of(part):
                    ids, counts = sample(part[a:b], keys[lo + a : lo + b].copy(), lattices, seed)
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    mask = pa.array([t is None for t in part[a:b]])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=mask)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo + a, b - a), lists], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, vocab: dict, seed: int = 0, theta: float = 1.0) -> DataFrame:
    """doc_id and sampled ids of docs(doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("string")).alias("row_key"))
    return own.mapInArrow(_encoder(docs.sparkSession.sparkContext.broadcast(vocab), seed, theta), "doc_id long, ids array<int>")


def join_pieces(ids, surface: list[bytes]) -> str:
    return b"".join([surface[i] for i in ids]).decode("utf-8", "surrogatepass")


def _decoder(shared):
    def run(batches):
        surface = pa.array(shared.value["surface"], pa.binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column("ids")
                offsets = lists.offsets.cast(pa.int64())
                offsets = pa.array(offsets.to_numpy() - offsets[0].as_py(), pa.int32())
                spelled = pa.ListArray.from_arrays(offsets, surface.take(lists.flatten()))
                texts = pc.if_else(lists.is_null(), None, pc.binary_join(spelled, b"").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], names=["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, vocab: dict) -> DataFrame:
    """doc_id, ids and the text that the ids spell, for encoded(doc_id, ids)."""
    own = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return own.mapInArrow(_decoder(encoded.sparkSession.sparkContext.broadcast(vocab)), "doc_id long, ids array<int>, text string")


def query(spark, sf_dir, model_file: str = MODEL):
    """doc_id, ids, n_pieces and the SHA-256 of what the ids decode to."""
    from .common import table

    vocab = load(model_file)
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, seed=1, theta=0.5), vocab)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
