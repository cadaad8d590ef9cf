"""Packing of token sequences into windows of one length, best fit decreasing.

A document's ids end with END. Documents of more than a window are first cut into full windows, each a sequence of its
own; what is left of a document is one piece under a window's length. Pieces are dealt at random to bins of about
BIN_PIECES, and a bin is packed in one stream of decreasing length: a segment tree over remaining capacities finds the
open window that fits a piece most tightly, else a new one is opened. A bin leaves a window or two unfilled, whatever
the size of the table, and a task holds the open windows of one bin.

Ids are computed word by word. No token of a lower-casing word tokenizer crosses white space, nor the place between a letter or
digit and a full stop or comma after it, so each distinct word is encoded once a worker and a document's ids are gathered
in numpy. Texts with a stop or comma after anything else are encoded whole.

Only pieces' places and checksums move; texts and ids stay in the task that read them.

Defined cases: a null or empty text is the END id alone; repeated rows are packed as often as they occur; null doc_ids
are values like any other; ties of length go by the piece's place in the stored table; an empty table gives no pieces; a
text of any length is encoded whole; extra columns are ignored. sequence_id tells sequences apart and has gaps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vocab import FOLDER, Numbers, spread, text_slices, tokenizer

TOKENIZER, END, WINDOW = "word_bpe_49k.json", 2, 4096
BIN_PIECES = 4096
MOST_WORDS, LONG_WORD = 500_000, 64  # distinct words that a worker remembers, and their longest
STOPS = ",."
LINE = 200  # words of letters that are encoded together

#: Workers are used again by later tasks: words that one has met stay known.
_known: dict = {}


class Words:
    """Ids of distinct words, one after another in one array."""

    def __init__(self, name: str, folder: str):
        self.encoder = tokenizer(name, folder)
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = 1
        self.clear()

    def clear(self) -> None:
        self.index, self.flat, self.first, self.size, self.joins = Numbers(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Words of letters are read in lines, where each of them has one id that ends a word."""
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        rest, out = [i for i, w in enumerate(words) if not w.isalpha()], [None] * len(words)
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        for line, ids in zip(lines, self.whole([" ".join([words[i] for i in line]) for line in lines])):
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(line):
                rest += line
                continue
            for i, a, b in zip(line, [0, *stops], stops):
                out[i] = ids[a:b]
        for i, ids in zip(rest, self.whole([words[i] for i in rest])):
            out[i] = ids
        return out

    def learn(self) -> None:
        """Encodes the words that were numbered since the last time."""
        words = self.index.new
        if not words:
            return
        ids = self.each(words)
        sizes = np.array([len(x) for x in ids], np.int64)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])
        self.size = np.concatenate([self.size, sizes])
        # 1: may follow a letter or digit only; 2: ends with one.
        self.joins = np.concatenate([self.joins, np.array([(w[:1] in STOPS and w != "") + 2 * w[-1:].isalnum() for w in words], np.int8)])
        for w in words:
            if len(w) > LONG_WORD:
                del self.index[w]  # not kept
        self.index.new = []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them for the whole of it."""
        if self.index.given > MOST_WORDS or len(self.flat) > 8 * MOST_WORDS:
            self.clear()
        numbers, whole, out = [], [], []
        for text in texts:
            cut = lowered(text).replace("\n", " ")
            for stop in STOPS:
                cut = cut.replace(stop, " " + stop)
            numbers.append(self.index.of(cut.split(" ")))
        self.learn()
        for i, at in enumerate(numbers):
            joins = self.joins[at]
            if joins[0] & 1 or ((joins[1:] & 1) > (joins[:-1] >> 1)).any():
                whole.append(i)
            out.append(None if i in whole[-1:] else self.flat[spread(self.first[at], self.size[at])])
        for i, ids in zip(whole, self.whole([texts[i] for i in whole])):
            out[i] = np.array(ids, np.uint32)
        return out


def lowered(text: str) -> str:
    """text in lower case where that is done sign by sign; the tokenizer does it for all others, and again for these."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def encoded_words(name: str, folder: str) -> Words:
    key = (name, folder)
    if key not in _known:
        _known[key] = Words(name, folder)
    return _known[key]


def _cutter(name: str, folder: str, window: int):
    def run(batches):
        from pyspark import TaskContext

        words, place = encoded_words(name, folder), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi in text_slices(texts):
                rows = []
                for key, ids in zip(keys[lo:hi], words.ids([t or "" for t in texts[lo:hi]])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        rows.append((key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), place))
                        place += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return run


def cut(docs: DataFrame, window: int = WINDOW, name: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """Pieces of docs(doc_id, text): full windows, and the rest of each document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_cutter(name, folder, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long")


class BestFit:
    """Open windows by remaining capacity, in a segment tree whose nodes count them. Lengths come in decreasing order."""

    def __init__(self, window: int):
        self.window, self.leaves, self.opened = window, 1 << window.bit_length(), 0
        self.count, self.by_room = [0] * (2 * self.leaves), {}

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least `need` that an open window has."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:  # up to the first right neighbour that holds something, then down to its leftmost leaf
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def put(self, length: int) -> tuple[int, int]:
        """The window that a piece of this length goes to, and its offset there."""
        room = self.tightest(length)
        if room is None:
            sequence, room = self.opened, self.window
            self.opened += 1
        else:
            sequence = self.by_room[room].pop()
            self._add(room, -1)
        if room > length:
            self.by_room.setdefault(room - length, []).append(sequence)
            self._add(room - length, 1)
        return sequence, self.window - room


def _packer(window: int):
    """Streams a partition sorted by bin and decreasing length."""
    def run(batches):
        current, windows = None, None
        for batch in batches:
            sequences, offsets = [], []
            for bin_, length in zip(batch.column("bin").to_pylist(), batch.column("length").to_pylist()):
                if bin_ != current:
                    current, windows = bin_, BestFit(window)
                sequence, offset = windows.put(length)
                sequences.append((((bin_ << 32) | sequence) << 1) + 1)
                offsets.append(offset)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            at = [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + at, names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, window: int = WINDOW, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. pieces: what cut() gives, stored, as its places decide."""
    rest = pieces.where(F.col("length") < window)
    bins = max(1, -(-rest.count() // bin_pieces))
    dealt = rest.withColumn("bin", F.pmod(F.xxhash64("place"), F.lit(bins)).cast("long"))
    sorted_ = dealt.repartition(min(bins, 20_000), "bin").sortWithinPartitions("bin", F.desc("length"), "place")
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    packed = sorted_.mapInArrow(_packer(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == window).select(*own, (F.col("place") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def query(spark, sf_dir):
    from .common import table

    return pack(stored(cut(table(spark, sf_dir, "documents").select("doc_id", "text")), "packing-pieces"))
