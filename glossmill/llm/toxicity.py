"""Toxicity by a small convolutional text classifier.

A word's vector is the sum of hashed embeddings of the word and of its five-letter stem. Filters of several
widths slide over the words of a whole text, each keeps its maximum, and a logistic layer reads the maxima.
The net is trained with Adam in numpy on the driver from a sample of at most 2 * per_label labelled texts of
each label (documented bound, see sampling). Embeddings of slots never seen in training stay zero, so unknown words are
neutral. Thresholds are calibrated for each language on a fold of the sample; a text's language is guessed
from its own words, by word log-odds learned from the same sample, and scores are shifted so that 0.5 is
the threshold.

Defined cases: null, empty and letterless texts score as a text without words; with no labels of both kinds
every row scores 0; repeated rows score alike; equal scores predict alike; rows with a null doc_id are scored and
never learned from; extra columns are ignored, but for those carried on, which may not be called score or predicted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_sample, remainder

SLOTS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
PER_LABEL = 1200
LETTERS = re.compile(r"[^\W\d_]+")
CHUNK = 1 << 16  # words that one step of scoring holds


def slots(word: str) -> tuple[int, int]:
    raw = word.encode()
    return zlib.crc32(raw) % SLOTS, zlib.crc32(b"stem:" + word[:5].encode()) % SLOTS


class Hasher:
    """Slots of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known, self.most = {}, most

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = slots(w)
        return np.array([known[w] for w in words], np.int32).reshape(-1, 2)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def maxima(vec: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each run of word vectors the filters' maxima (0 at least) and where they lie (-1: nowhere)."""
    n = len(offsets) - 1
    best, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1, np.int64)
    sizes = np.diff(offsets)
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        total = len(vec) - width + 1
        if total <= 0:
            continue
        act = model["b"][k] + sum(vec[j : j + total] @ model["w"][k][j] for j in range(width))
        rows = np.flatnonzero(sizes >= width)
        if not len(rows):
            continue
        # Runs of valid starts, with windows that cross into the next text masked out.
        owner = np.repeat(np.arange(n), sizes)[:total]
        act[np.arange(total) + width > offsets[owner + 1]] = -1
        starts = offsets[rows]
        top = np.maximum.reduceat(act, starts, axis=0)
        best[rows, cols] = np.maximum(top, 0)
        if model.get("train"):
            for r, s in zip(rows, starts):
                e = min(offsets[r + 1] - width + 1, total)
                at = s + act[s:e].argmax(axis=0)
                where[r, cols] = np.where(act[at, np.arange(FILTERS)] > 0, at, -1)
    return best, where


def forward(ids: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    vec = model["emb"][ids[:, 0]] + model["emb"][ids[:, 1]]
    best, _ = maxima(vec, offsets, model)
    return best @ model["out"] + model["bias"]


def fit(texts: list[str], labels: list[int], langs: list[str], epochs: int = 12) -> dict | None:
    """The trained net with thresholds, or None when labels of one kind only are there."""
    if len(set(labels)) < 2:
        return None
    rng, hasher = np.random.default_rng(3), Hasher()
    bags = [words_of(t) for t in texts]
    ids = [hasher(b) for b in bags]
    y = np.array(labels, np.float32)
    fold = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)

    # Start embeddings from the slots' smoothed log-odds in the training fold: first coordinate.
    seen = [np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)]
    for i in np.flatnonzero(~fold):
        seen[int(y[i])][np.unique(ids[i])] += 1
    n1, n0 = max(1, (y[~fold] == 1).sum()), max(1, (y[~fold] == 0).sum())
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    enough = seen[0] + seen[1] >= 3
    emb = np.zeros((SLOTS, DIM), np.float32)
    emb[enough] = rng.normal(0, 0.02, (int(enough.sum()), DIM))
    emb[enough, 0] = np.clip(odds[enough], -2, 3) / 3
    model = {"emb": emb, "w": [rng.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS], "b": [np.full(FILTERS, -0.05, np.float32) for _ in WIDTHS], "out": np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), "bias": np.float32(-1.5)}
    for k in range(len(WIDTHS)):
        model["w"][k][:, 0, :] += 0.7 / WIDTHS[k]
    _train(model, ids, y, np.flatnonzero(~fold), enough, rng, epochs)

    names = sorted({v for v in langs if v is not None}) or ["und"]
    counts = {n: Counter() for n in names}
    for b, v in zip(bags, langs):
        if v is not None:
            counts[v].update(set(b))
    common = sorted({w for n in names for w, c in counts[n].most_common(300)})
    sizes = {n: 1 + sum(v == n for v in langs) for n in names}
    model["lang_words"] = {w: np.array([np.log((counts[n][w] + 0.5) / sizes[n]) for n in names], np.float32) for w in common}
    model["names"] = names
    model["thresholds"] = _thresholds(model, bags, ids, y, fold if fold.any() else ~fold)
    model.pop("train")
    return model


def _train(model, ids, y, rows, enough, rng, epochs):
    model["train"] = True
    state, step = {}, 0

    def adam(name, value, grad, rate=0.01):
        m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    balance = {1.0: 0.5 / max(1e-6, (y[rows] == 1).mean()), 0.0: 0.5 / max(1e-6, (y[rows] == 0).mean())}
    batches = max(1, len(rows) // 64)
    for _ in range(max(epochs, -(-500 // batches))):  # 500 steps at least
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            step += 1
            offsets = np.concatenate([[0], np.cumsum([len(ids[i]) for i in part])]).astype(np.int64)
            flat = np.concatenate([ids[i] for i in part])
            vec = model["emb"][flat[:, 0]] + model["emb"][flat[:, 1]]
            best, where = maxima(vec, offsets, model)
            p = 1 / (1 + np.exp(-np.clip(best @ model["out"] + model["bias"], -30, 30)))
            slope = (p - y[part]) * np.array([balance[float(v)] for v in y[part]], np.float32) / len(part)
            back = slope[:, None] * model["out"][None, :]
            grad_emb = {}
            for k, width in enumerate(WIDTHS):
                gw, gb = np.zeros_like(model["w"][k]), np.zeros(FILTERS, np.float32)
                for f in range(FILTERS):
                    at, g = where[:, k * FILTERS + f], back[:, k * FILTERS + f]
                    on = np.flatnonzero(at >= 0)
                    gb[f] = g[on].sum()
                    for j in range(width):
                        gw[j, :, f] = g[on] @ vec[at[on] + j]
                        grad_emb.setdefault("rows", []).append(flat[at[on] + j].ravel())
                        grad_emb.setdefault("grads", []).append(np.repeat(g[on][:, None] * model["w"][k][j, :, f], 2, axis=0))
                adam(f"w{k}", model["w"][k], gw + 1e-4 * model["w"][k])
                adam(f"b{k}", model["b"][k], gb)
            touched, inverse = np.unique(np.concatenate(grad_emb["rows"]), return_inverse=True)
            g = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g, inverse, np.concatenate(grad_emb["grads"]))
            model["emb"][touched[enough[touched]]] -= 0.5 * g[enough[touched]]
            adam("out", model["out"], best.T @ slope + 1e-4 * model["out"])
            model["bias"] = np.float32(model["bias"] - 0.1 * slope.sum())


def language(bag: list[str], model: dict) -> int:
    known = [model["lang_words"][w] for w in set(bag) if w in model["lang_words"]]
    return int(np.sum(known, axis=0).argmax()) if known else 0


def _thresholds(model, bags, ids, y, fold):
    """For each language the logit cut of least error on the fold, in the middle of its gap; 0 where one kind is missing."""
    cuts = np.zeros(len(model["names"]), np.float32)
    rows = np.flatnonzero(fold)
    logit = np.array([float(forward(ids[i], np.array([0, len(ids[i])]), model)[0]) for i in rows])
    lang = np.array([language(bags[i], model) for i in rows])
    for k in range(len(cuts)):
        own = lang == k
        z, t = logit[own], y[rows][own]
        if len(set(t.tolist())) < 2 or len(t) < 20:
            continue
        order = np.sort(np.unique(np.append(z, 0)))
        mids = np.append((order[1:] + order[:-1]) / 2, 0.0)
        errors = [(((z >= c) != (t == 1)).sum(), abs(c)) for c in mids]
        cuts[k] = mids[min(range(len(mids)), key=lambda i: errors[i])]
    return cuts


def pooled(bag: list[str], hasher: Hasher, model: dict) -> np.ndarray:
    """Maxima of one text in overlapping chunks, so that a very long text needs no more memory than a chunk."""
    best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    for start in range(0, max(1, len(bag)), CHUNK):
        ids = hasher(bag[start : start + CHUNK + max(WIDTHS) - 1])
        vec = model["emb"][ids[:, 0]] + model["emb"][ids[:, 1]]
        best = np.maximum(best, maxima(vec, np.array([0, len(ids)]), model)[0][0])
    return best


def _scorer(shared, carry: list[str]):
    def run(batches):
        model, hasher = shared.value, Hasher()
        for batch in batches:
            z = []
            for text in batch.column("text"):
                bag = words_of(text.as_py())
                z.append(float(pooled(bag, hasher, model) @ model["out"] + model["bias"]) - float(model["thresholds"][language(bag, model)]))
            score = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(score)], names=[*carry, "score"])

    return run


def learn(labelled: DataFrame, per_label: int = PER_LABEL) -> dict | None:
    """A model from labelled(key, text, lang, toxic); rows without text or label are passed over."""
    return _fitted(labelled_sample(labelled.where("text is not null and toxic in (0, 1)"), "toxic", per_label))


def learn_from(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict | None:
    """A model as learn(with_labels(docs, labels)), for which no text is exchanged: labels meet ids and sizes alone."""
    own = docs.where("text is not null").where(remainder(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("key"), "text", "lang")
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    return _fitted(labelled_sample(own, "toxic", per_label, one.where(remainder(F.col("key"), 5) != 0)))


def _fitted(sample: list) -> dict | None:
    return fit([r["text"] for r in sample], [int(r["toxic"]) for r in sample], [r["lang"] for r in sample])


def score(docs: DataFrame, model: dict | None, carry: list[str]) -> DataFrame:
    """The columns in carry with score and predicted, for docs with a text; carry may not hold those two names."""
    if model is None:
        return docs.select(*carry, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    own = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = T.StructType([*own.select(*carry).schema.fields, T.StructField("score", T.DoubleType())])
    found = own.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model), carry), schema)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, text, lang, toxic of labelled documents that may be learned from; of repeated labels the largest counts."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic"))
    own = docs.where(remainder(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("key"), "text", "lang")
    return own.join(one.where(remainder(F.col("key"), 5) != 0), "key")


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn_from(docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0), model, ["doc_id", "held_out"])
