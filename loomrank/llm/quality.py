"""Quality rules: hashed n-gram logistic regression, calibrated, against fixed thresholds.

Features of a text, hashed into 2**18 slots: its words and word pairs, and the 3- and 4-grams of its characters (with
marks and case kept), each slot weighted by its share of the text's n-grams of that kind.  Shares make the score
independent of length, so a text is read whole and its n-grams are summed in one pass.

Weights are learnt by Adam on the logistic loss over a sample of at most ``MAX_TRAIN`` labelled documents of each
class (those whose ids hash least); classes weigh alike.  A quarter of the sample isn't trained on: Platt scaling on it
turns scores into probabilities of good quality at the natural rates of all labels, as each row stands for as many
labels as its class has for each one sampled.  Documents from ``KEEP`` on are kept,
below ``REJECT`` rejected, between them for review.

Nulls: a null or empty text has no features and gets probability 0 and decision 'reject'.  A null id stays null,
repeated rows are scored each by itself, an empty table gives an empty result.  Columns other than doc_id and text aren't
read; ``without_rejected`` passes them on.  If the labels hold one class only, every text with features gets that class's
probability, 1 or 0; without any label there is no ground to reject a text, and each with features gets 1.  Labels whose ids
have the same hash are taken by the smaller id first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, filtered, small_batches, table
from ._text import Words, blocks, mix, release, utf8

MAX_TRAIN = 1200
SLOTS = 1 << 18
KEEP, REJECT = 0.5, 0.2
SCHEMA = "doc_id bigint, probability double, decision string"
_KINDS = 4


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    known: float | None = None
    """The probability of all texts if the labels had one class."""


def features(texts):
    """(slots, document) of each kind of n-gram: word, word pair, 3 characters, 4 characters; documents in order."""
    w = Words(texts)
    n = len(w.first) - 1
    top = np.uint64(64 - 18)
    slot = (w.hash >> top).astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(w.first))
    yield slot, doc
    if len(slot) > 1:
        with np.errstate(over="ignore"):
            pair = mix(w.hash[:-1] * np.uint64(31) + w.hash[1:])
        same = doc[1:] == doc[:-1]
        yield (pair >> top).astype(np.int32)[same], doc[1:][same]
    data, offsets = utf8(texts)
    point, edge = code_points(data, offsets)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(edge))
    if len(point) >= 4:
        with np.errstate(over="ignore"):
            three = point[:-2] * np.uint32(0x01000193) + point[1:-1] * np.uint32(0x0001F35D) + point[2:]
            for gram, length in ((three, 3), (three[:-1] * np.uint32(0x00010DCD) + point[3:], 4)):
                h = (gram ^ np.uint32(length)) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                same = of[length - 1 :] == of[: len(of) - length + 1]
                slot = (h >> np.uint32(14)).astype(np.int32)
                yield (slot, of[: len(slot)]) if same.all() else (slot[same], of[: len(slot)][same])


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes as numbers, and where the texts begin among them."""
    if not (data >= 128).any():
        return data.astype(np.uint32), offsets
    at = np.flatnonzero((data & 0xC0) != 0x80)
    d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    out = d[at]
    for least, most, first in ((0xC0, 0xE0, 0x1F), (0xE0, 0xF0, 0x0F), (0xF0, 0x100, 0x07)):
        k = np.flatnonzero((out >= least) & (out < most) & (d[at] == out))
        point = d[at[k]] & np.uint32(first)
        for more in range(1, {0xC0: 2, 0xE0: 3, 0xF0: 4}[least]):
            point = point << np.uint32(6) | d[at[k] + more] & np.uint32(0x3F)
        out[k] = point
    return out, np.searchsorted(at, offsets)


def raw_scores(texts, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Log odds before calibration, and whether a text has features."""
    n = len(texts)
    out, some = np.full(n, bias), np.zeros(n, bool)
    for slot, doc in features(texts):
        count = np.bincount(doc, minlength=n)
        total = np.bincount(doc, weights[slot], minlength=n)
        out += total / np.maximum(count, 1)
        some |= count > 0
    return out, some


def _sparse(texts):
    """Rows (document, slot, share) of all kinds, one a document and slot and kind, in pieces of some documents each."""
    at = 0
    for part in blocks([pa.record_batch([texts], ["text"])], most=1 << 19):
        for slot, doc in features(part.column("text")):
            key, count = np.unique(doc.astype(np.int64) * SLOTS + slot, return_counts=True)
            d = key // SLOTS
            share = count / np.bincount(d, count)[d]
            yield (d + at).astype(np.int32), (key % SLOTS).astype(np.int32), share.astype(np.float32)
        at += part.num_rows


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _platt(score: np.ndarray, y: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's smoothed targets; a row of class c stands for so many labels."""
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    weight = weight / weight.mean()
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([score, np.ones_like(score)], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ b)
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - t)) + 1e-6 * b)
        b = b - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def train(texts: list[str], good: list[int], rounds: int = 120, rate: float = 0.5, decay: float = 1e-5, stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    y = np.array(good, np.float64)
    if len(set(good)) < 2:
        return Model(np.zeros(SLOTS, np.float32), 0.0, 1.0, 0.0, float(y.mean()) if len(y) else 1.0)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    column = pa.array(texts, pa.large_string())
    fit, rest = column.filter(pa.array(~held)), column.filter(pa.array(held if held.any() else ~held))
    yf, yr = y[~held], y[held if held.any() else ~held]
    rows = list(_sparse(fit))
    weight = np.where(yf == 1, 0.5 / yf.sum(), 0.5 / (1 - yf).sum())
    w, bias, m, v = np.zeros(SLOTS), 0.0, np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for k in range(1, rounds + 1):
        z = np.full(len(yf), bias)
        for doc, slot, share in rows:
            z += np.bincount(doc, w[slot] * share, minlength=len(yf))
        err = weight * (_sigmoid(z) - yf)
        g = np.append(decay * w, err.sum())
        for doc, slot, share in rows:
            g[:-1] += np.bincount(slot, err[doc] * share, minlength=SLOTS)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w -= step[:-1]
        bias -= 0.1 * step[-1]
    weights = w.astype(np.float32)
    del rows
    release()
    score = np.concatenate([raw_scores(b.column("text"), weights, bias)[0] for b in blocks([pa.record_batch([rest], ["text"])])])
    return Model(weights, float(bias), *_platt(score, yr, stands_for))


def probabilities(texts, model: Model) -> np.ndarray:
    score, some = raw_scores(texts, model.weights, model.bias)
    p = np.full(len(score), model.known) if model.known is not None else _sigmoid(model.slope * score + model.shift)
    return np.where(some, p, 0.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = known.filter("y = 0").orderBy("h", "doc_id").limit(most).union(known.filter("y = 1").orderBy("h", "doc_id").limit(most))
    counted = dict(map(tuple, known.groupBy("y").count().collect()))
    stands_for = tuple(counted.get(c, 0) / max(1, min(most, counted.get(c, 0))) for c in (0, 1))
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").filter("text is not null").select("h", "doc_id", "text", "y").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("y").to_pylist(), stands_for=stands_for)


def _scored(model: Model):
    def run(batches):
        for batch in blocks(batches, most=2 << 20):
            p = probabilities(batch.column("text"), model)
            decision = np.where(p >= KEEP, "keep", np.where(p < REJECT, "reject", "review"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(decision.tolist(), pa.string())], ["doc_id", "probability", "decision"])

    return run


def quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, probability, decision) of every row; see the module's text."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_scored(model or fit(docs, labels)), SCHEMA)


def without_rejected(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns, whatever their names."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels)
    return filtered(docs, lambda: lambda texts: probabilities(texts, model) >= REJECT)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
