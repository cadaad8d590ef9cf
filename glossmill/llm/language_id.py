"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary logistic classifier for each bit reads hashed byte 1- to
3-gram frequencies of the lower-cased text. Decoding weighs each bit by its logistic loss and takes the
codeword of least loss. Where the two best codewords are close, the row is flagged ambiguous.

The classifiers are fitted in numpy on the driver from a sample of at most 2 * per_language rows of each
language (documented bound; every language has its part, see sampling); scoring streams whole texts through Arrow
buffers.

Defined cases: null texts, empty texts and texts without a letter are `und` with score 0; when nothing
can be learned every row is `und`; repeated rows score alike; ties go to the alphabetically first language;
rows with a null doc_id are scored and learned from like any other; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample, remainder

SLOTS = 1 << 12
PER_LANGUAGE = 400
AMBIGUOUS = 0.6


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: all splits of up to five languages, else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = [c for k in range(n - 1) for c in combinations(range(1, n), k)]
        return np.array([[1 if i == 0 or i in c else -1 for c in splits] for i in range(n)], np.int8)
    rng, best, far = np.random.default_rng(10), None, -1
    for _ in range(50 if n < 200 else 5):
        code = rng.choice(np.array([-1, 1], np.int8), (n, max(15, 4 * n.bit_length())))
        wide = code.astype(np.float32)
        apart = ((code.shape[1] - wide @ wide.T) / 2 + code.shape[1] * np.eye(n)).min()
        if apart > far:
            best, far = code, apart
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of square-rooted n-gram frequencies (n = 1 to 3) of the byte runs between offsets."""
    n = len(offsets) - 1
    out = np.zeros((n, SLOTS), np.float32)
    for i in range(n):
        b = data[offsets[i] : offsets[i + 1]].astype(np.uint32)
        if not len(b):
            continue
        grams = [b, (b[:-1] * 256 + b[1:] + 65536), (b[:-2] * 65536 + b[1:-1] * 256 + b[2:]) ^ np.uint32(0x5BD1E995)]
        h = np.concatenate([(g * np.uint32(2654435761)) >> np.uint32(20) for g in grams])
        out[i] = np.bincount(h, minlength=SLOTS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def fit(texts: list[str], langs: list[str], steps: int = 300) -> dict:
    """The model: language names, codewords, weights and biases."""
    names = sorted(set(langs))
    code = codewords(len(names))
    raw = [t.lower().encode() for t in texts]
    x = features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    y = code[[names.index(v) for v in langs]].astype(np.float32) if langs else np.zeros((0, 1), np.float32)
    weight, bias = np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    square = np.full_like(weight, 1e-8)
    for step in range(steps if len(names) > 1 else 0):
        slope = -y / (1 + np.exp(np.clip(y * (x @ weight + bias), -30, 30)))
        grad = x.T @ slope / len(x) + 1e-5 * weight
        square += grad * grad
        weight -= 0.5 * grad / np.sqrt(square)
        bias -= 0.5 * slope.mean(axis=0)
    return {"names": names, "code": code, "weight": weight, "bias": bias}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best row of code, its share of exp(-loss), and the share of the runner-up."""
    loss = np.logaddexp(0, -margins) @ (code > 0).T + np.logaddexp(0, margins) @ (code < 0).T
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    top = share[np.arange(len(best)), best]
    second = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(best))
    return best, top, second


def _scorer(model):
    def run(batches):
        m = model.value
        for batch in batches:
            text = batch.column("lower").cast(pa.large_binary())
            outs = []
            for start in range(0, batch.num_rows, 256):
                part = text.slice(start, 256)
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
                outs.append(decode(features(data, offsets) @ m["weight"] + m["bias"], m["code"]))
            if not outs:
                continue
            best, top, second = (np.concatenate(x) for x in zip(*outs))
            names = pa.array(m["names"], pa.string()).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("letters"), names, pa.array(top.astype(np.float64)), pa.array(second > AMBIGUOUS * top)], names=["doc_id", "held_out", "letters", "best", "top", "close"])

    return run


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """A model from docs(key, text, lang); rows without text, language or letters are passed over."""
    rows = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    sample = labelled_sample(rows, "lang", per_language)
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for docs(doc_id, text, held_out)."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", text.rlike(r"\p{L}").alias("letters"), F.lower(text).alias("lower"))
    if not model["names"]:
        return own.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = own.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, letters boolean, best string, top double, close boolean")
    ok = F.col("letters")
    return found.select("doc_id", "held_out", F.when(ok, F.col("best")).otherwise("und").alias("lang_pred"), F.when(ok, F.col("top")).otherwise(0.0).alias("score"), (ok & F.col("close")).alias("ambiguous"))


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = learn(docs.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return identify(docs.select("doc_id", "text", "held_out"), model)
