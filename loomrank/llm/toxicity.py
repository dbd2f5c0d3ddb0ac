"""Toxicity by compression distance.

Two dictionaries are trained by zstandard on labelled text, separately: one on ordinary documents, one on toxic ones.  A
toxic document is mostly ordinary prose, so the toxic dictionary is trained on the parts of toxic texts that recur
among them and that ordinary texts don't hold: runs of bytes of which no ``D`` in a row stand in more than one in a thousand of
the ordinary training texts, and which a first dictionary, trained on the other half of the toxic texts, compresses better in
their context.  A window of a text is compressed with the ordinary dictionary, and with the toxic dictionary put before
the same ordinary one; the bytes that the second saves are the window's margin.  Because both sides share the ordinary
content, ordinary text has a margin of about nought whatever its language.

Windows of 96 bytes at steps of 80 cover each whole text.  Those with a margin are compressed again as windows of 64
bytes at steps of 32 with a closer parser, which settles the margin.  A document's score is the sum of its three
largest window margins; it is toxic from a threshold on.  Three fifths of the labelled documents train; a fifth sets the toxic
dictionary's size and the threshold: where at most ``FALSE_RATE`` of the ordinary ones are lost, the best share of toxic
ones found less ``COST`` times that of ordinary lost; the last fifth, which nothing else sees, gives ``Model.held_out``.

Training reads at most ``MAX_TRAIN`` labelled documents of each class, whole, those with the smallest hash of their id (ties: the
smaller id); all else covers every document.

Nulls: a null, empty or very short text has score 0 and is not toxic.  A null id stays null, repeated rows are scored
each by itself, and an empty table gives an empty result.  Columns other than doc_id and text aren't read; ``without_toxic``
passes them on.  Without toxic labels nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, filtered, small_batches, table
from ._text import blocks, lowered, mix, release

MAX_TRAIN = 2000
FALSE_RATE, COST = 0.02, 3.0
WIDE, WIDE_STEP, CLOSE, CLOSE_STEP = 96, 80, 64, 32
GATE = 1
D, AROUND, RARE, SAVED = 6, 28, 0.001, 3
ORDINARY_BYTES, FIRST_BYTES, TOXIC_BYTES, SEGMENTS = 16384, 2048, (288, 320, 384, 512), (12, 16)
_COVER = {"d": D, "f": 20, "split_point": 1.0}
TOP = 3
SCHEMA = "doc_id bigint, score int, windows int, marked int, toxic boolean"

_TO_LETTERS = np.array([i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)], np.uint8)
_WIDE = {"strategy": zstandard.STRATEGY_LAZY2, "window_log": 15, "hash_log": 15, "chain_log": 14, "search_log": 3, "min_match": 5, "target_length": 16}
_CLOSE = {"strategy": zstandard.STRATEGY_LAZY2, "window_log": 15, "hash_log": 15, "chain_log": 15, "search_log": 9, "min_match": 4, "target_length": 999}


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    held_out: tuple[float, float] = (0.0, 0.0)
    """Of documents that neither trained nor calibrated: the part of toxic ones found, of ordinary ones lost."""


def normalised(texts) -> tuple[bytes, np.ndarray]:
    """Lower-cased bytes, ASCII marks as spaces, a space around each text, and the offsets."""
    data, offsets = lowered(texts)
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    out[np.arange(len(data)) + shift] = _TO_LETTERS[data]
    return out.tobytes(), offsets + 2 * np.arange(n + 1)


def _cut(start: np.ndarray, length: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of the windows of each range, and the index of the range."""
    count = np.maximum(1, -(-(length - width) // step) + 1)
    of = np.repeat(np.arange(len(start)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = k * step
    return np.stack([start[of] + at, np.minimum(width, length[of] - at)], 1), of


class Scorer:
    def __init__(self, model: Model):
        make = lambda content, kw: self._compressor(content, kw)
        self.wide = make(model.ordinary, _WIDE), make(model.toxic + model.ordinary, _WIDE)
        self.close = make(model.ordinary, _CLOSE), make(model.toxic + model.ordinary, _CLOSE)
        self.silent = not model.toxic

    @staticmethod
    def _compressor(content: bytes, kw: dict):
        how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **kw)
        d = zstandard.ZstdCompressionDict(content or b"        ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=how)

    @staticmethod
    def _margin(pair, data: bytes, windows: np.ndarray) -> np.ndarray:
        cut = zstandard.BufferWithSegments(data, windows.astype(np.uint64).tobytes())
        with_, without = (np.fromiter(map(len, c.multi_compress_to_buffer(cut, threads=0)), np.int64, len(windows)) for c in pair)
        return with_ - without

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, windows and windows with a margin of each text."""
        data, offsets = normalised(texts)
        n = len(offsets) - 1
        score, marked = np.zeros(n, np.int64), np.zeros(n, np.int64)
        windows, of = _cut(offsets[:-1], np.diff(offsets), WIDE, WIDE_STEP)
        counts = np.bincount(of, minlength=n)
        if self.silent or not n:
            return score, counts, marked
        hit = np.flatnonzero(self._margin(self.wide, data, windows) >= GATE)
        if len(hit):
            close, back = _cut(windows[hit, 0], windows[hit, 1], CLOSE, CLOSE_STEP)
            margin = np.zeros(len(hit), np.int64)
            np.maximum.at(margin, back, self._margin(self.close, data, close))
            doc = of[hit]
            order = np.lexsort((-margin, doc))
            doc, margin = doc[order], margin[order]
            rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
            np.add.at(score, doc[rank < TOP], margin[rank < TOP])
            np.add.at(marked, doc[margin > 0], 1)
        return score, counts, marked


def _codes(text: bytes) -> np.ndarray:
    """A slot for each ``D`` bytes in a row."""
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(a) - D + 1)
    h = np.zeros(n, np.uint64)
    for k in range(D):
        h |= a[k : n + k] << np.uint64(8 * k)
    return (mix(h) >> np.uint64(64 - 24)).astype(np.int64)


def novel(texts: list[bytes], ordinary: list[bytes]) -> list[list[tuple[bytes, bytes]]]:
    """(part, part in its context) of the parts of each text whose ``D`` bytes in a row stand in few ordinary texts; each part once a text."""
    common = np.zeros(1 << 24, np.uint16)
    for t in ordinary:
        common[np.unique(_codes(t))] += 1  # at most one a text, and fewer than 65,536 texts
    common = common > RARE * len(ordinary)
    out = []
    for t in texts:
        new = ~common[_codes(t)]
        mark = np.zeros(len(t), bool)
        for k in range(D):
            mark[k : len(new) + k] |= new
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
        own: dict[bytes, bytes] = {}
        for a, b in zip(edge[::2], edge[1::2]):
            own.setdefault(b"  " + t[a:b].strip() + b"  ", t[max(0, a - AROUND) : b + AROUND])
        out.append(list(own.items()))
    return out


def trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary that zstandard trains on the samples; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def recurrent(parts: list[list[tuple[bytes, bytes]]], ordinary: bytes) -> list[bytes]:
    """The novel parts of toxic texts that a dictionary trained on the other half of the toxic texts compresses better."""
    kept: list[bytes] = []
    for half in (0, 1):
        other = [x for own in parts[1 - half :: 2] for x in own]
        scorer = Scorer(Model(ordinary, trained(FIRST_BYTES, [x for own in parts[half::2] for x, _ in own], k=16, **_COVER), 1))
        if other and not scorer.silent:
            ends = np.cumsum([len(c) for _, c in other])
            windows = np.stack([np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)], 1)
            margin = scorer._margin(scorer.close, b"".join(c for _, c in other), windows)
            kept += [x for (x, _), m in zip(other, margin) if m >= SAVED]
    return kept or [x for own in parts for x, _ in own]


def _threshold(clean: np.ndarray, dirty: np.ndarray) -> tuple[float, int]:
    """The threshold at which at most ``FALSE_RATE`` of the clean are lost that is best by found less COST times lost; its worth."""
    least = 2
    while len(clean) and (clean >= least).mean() > FALSE_RATE:
        least += 1
    if not len(dirty):
        return 0.0, least
    return max(((dirty >= t).mean() - COST * ((clean >= t).mean() if len(clean) else 0.0), t) for t in range(least, least + 8))


def _batches(texts: list[str]):
    """Small batches, so that training needs little memory beside the texts."""
    return blocks([pa.record_batch([pa.array(texts, pa.large_string())], ["text"])], most=1 << 19)


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    scorer = Scorer(model)
    return np.concatenate([scorer(b.column("text"))[0] for b in _batches(texts)] or [np.zeros(0, np.int64)])


def train(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries from three fifths of the labelled texts; the toxic one's size and the threshold from another, the figures from the last."""
    rows = []
    for batch in _batches(texts):
        data, offsets = normalised(batch.column("text"))
        rows += [data[a:b] for a, b in zip(offsets, offsets[1:])]
    part = np.arange(len(rows)) % 5
    bad, good = (list(dict.fromkeys(r for r, t, k in zip(rows, toxic, part) if t == c and k < 3)) for c in (1, 0))
    ordinary = trained(ORDINARY_BYTES, [r[i : i + 256] for r in good for i in range(0, len(r), 256)])
    if not bad:
        return Model(ordinary, b"", 2)
    parts = recurrent(novel(bad, good), ordinary)
    known = np.array(toxic)
    asked = [[t for t, k in zip(texts, part) if k == c] for c in (3, 4)]
    tune, test = known[part == 3], known[part == 4]
    best = None
    for size in TOXIC_BYTES:
        for k in SEGMENTS:
            model = Model(ordinary, trained(size, parts, k=k, **_COVER), 2)
            score = _scores(model, asked[0])
            worth, threshold = _threshold(score[tune == 0], score[tune == 1])
            if best is None or worth > best[0]:
                best = worth, threshold, model
    _, threshold, model = best
    score = _scores(model, asked[1])
    share = lambda c: float((score[test == c] >= threshold).mean()) if (test == c).any() else 0.0
    return Model(ordinary, model.toxic, int(threshold), (share(1), share(0)))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): of each class the ``most`` labelled documents whose ids hash least."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = known.filter("y = 0").orderBy("h", "doc_id").limit(most).union(known.filter("y = 1").orderBy("h", "doc_id").limit(most))
    return docs.join(F.broadcast(chosen), "doc_id").filter("text is not null").select("h", "doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    rows = sample(documents(docs), labels, "toxic", most).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
    texts, toxic = rows.column("text").to_pylist(), rows.column("y").to_pylist()
    del rows
    model = train(texts, toxic)
    del texts
    release()
    return model


def _scored(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for batch in blocks(batches):
            score, windows, marked = scorer(batch.column("text"))
            columns = [batch.column("doc_id"), *(pa.array(x.astype(np.int32)) for x in (score, windows, marked)), pa.array(score >= model.threshold)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "windows", "marked", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, score, windows, marked, toxic) of every row; see the module's text."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_scored(model or fit(docs, labels)), SCHEMA)


def without_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns, whatever their names."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels)

    def keeper():
        scorer = Scorer(model)
        return lambda texts: scorer(texts)[0] < model.threshold

    return filtered(docs, keeper)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
