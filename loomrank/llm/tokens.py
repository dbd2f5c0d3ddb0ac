"""Byte-pair encoding: forced-boundary encoding and decoding, and token counts by overlap resynchronisation.

The vocabulary is a tiktoken file of ranks; its path is a parameter.  Texts are taken as ordinary text: strings of
special tokens have no special meaning.

Cuts.  A pair of bytes that stands nowhere inside any token can't be merged over, so the text may be cut there for the
merges.  The split into words that comes before the merges must not change either: between a byte that isn't white
space and a white-space byte its pattern always splits, and neither side's split looks beyond.  Where both hold, a cut
is certain: both sides encode as they would within the whole.  The first condition is read off the vocabulary; where a
vocabulary has tokens across such a place, that pair makes no cut.

Encoding.  A text is cut at all certain places into fragments; each distinct fragment of a batch is encoded once and the
ids are put together.  Inside a fragment of one long word the remaining forbidden pairs cut again, so that the merges
never run over more than they have to.

Counting.  A document up to ``huge`` characters is encoded as it is.  A longer one becomes overlapping chunks, encoded
one by one with byte offsets.  Neighbours are spliced inside their overlap at a boundary that both encodings have
and that is a certain cut of the text.  If an overlap holds none, the right chunk is encoded again from further left,
twice as far each time, at the latest from the document's start.

Nulls: a null text has null ids and null count, an empty one none and 0.  A null id stays null, repeated rows are
done each by itself, an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, small_batches, table
from ._text import blocks, utf8

VOCABULARY = os.environ.get("LOOMRANK_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HUGE, OVERLAP = 1 << 16, 256
LONG_WORD = 1 << 10
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_REMEMBER = 1 << 17


class Vocabulary:
    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        inside = np.zeros((256, 256), bool)
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for a, b in zip(token, token[1:]):
                inside[a, b] = True
        self.forced = ~inside
        """forced[a, b]: no token holds b right after a."""
        ascii_ = np.arange(256) < 128
        self.certain = self.forced & (~_SPACE & ascii_)[:, None] & _SPACE[None, :]
        letter = np.array([i >= 128 for i in range(256)])
        self.certain |= self.forced & letter[:, None] & _SPACE[None, :]
        self.length = np.array([len(t) for t in self.tokens], np.int64)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Byte offsets of the certain cuts.  After a non-ASCII character that may itself be white space there is none."""
        at = np.flatnonzero(self.certain[data[:-1], data[1:]]) + 1 if len(data) > 1 else np.zeros(0, np.int64)
        if len(at) and (data[at - 1] >= 128).any():
            # U+0085, U+00A0, U+1680, U+2000..200A, U+2028/9, U+202F, U+205F, U+3000: by their last three bytes
            p = np.concatenate([np.zeros(2, np.uint8), data]).astype(np.int64)
            x, y, z = p[at - 1], p[at], p[at + 1]
            blank = ((y == 0xC2) & ((z == 0x85) | (z == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
            blank |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
            at = at[~blank]
        return at

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(text)

    def fragment(self, raw: bytes) -> list[int]:
        """Ids of one fragment."""
        if len(raw) > LONG_WORD:
            data = np.frombuffer(raw, np.uint8)
            if (data[1:] < 128).all() and not _SPACE[data[1:]].any():
                kind = np.where((data >= 48) & (data <= 57), 1, np.where(((data | 32) >= 97) & ((data | 32) <= 122), 2, 3))
                if (kind[1:] == kind[1]).all() and kind[1] < 3 and (kind[0] == kind[1] or raw[0] == 32):  # one word of one kind: no split by the pattern
                    at = np.flatnonzero(self.forced[data[:-1], data[1:]]) + 1
                    at = at[at > 1]
                    out: list[int] = []
                    for a, b in zip([0, *at], [*at, len(raw)]):
                        out += self.encoder._encode_single_piece(raw[a:b]) if b - a > 1 else [self.encoder.encode_single_token(raw[a:b])]
                    return out
        return self.encoder.encode_ordinary(raw.decode())

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens[i] for i in ids)


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(texts, v: Vocabulary, memory: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts by certain cuts, and where each text's begin; ``memory`` keeps the short fragments met before."""
    data, offsets = utf8(texts)
    raw = data.tobytes()
    cut = np.union1d(v.cuts(data), offsets)
    pieces = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    ids, sizes = [], np.empty(len(pieces), np.int64)
    get = memory.get
    for k, piece in enumerate(pieces):
        e = get(piece)
        if e is None:
            e = v.fragment(piece)
            if len(piece) <= 64 and len(memory) < _REMEMBER:
                memory[piece] = e
        ids += e
        sizes[k] = len(e)
    flat = np.array(ids, np.int32)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = total[np.searchsorted(cut, offsets)] if len(cut) > 1 else np.zeros(len(offsets), np.int64)
    return flat, at


def _encode(path: str):
    def run(batches):
        v, memory = vocabulary(path), {}
        for batch in blocks(batches):
            flat, at = encoded(batch.column("text"), v, memory)
            null = np.asarray(batch.column("text").is_null())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat), mask=pa.array(null))
            count = pa.array(np.diff(at).astype(np.int32), mask=null)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), count, lists], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; see the module's text."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_encode(path), "doc_id bigint, n_tokens int, ids array<int>")


def _decode(path: str):
    def run(batches):
        tokens = vocabulary(path).tokens
        for batch in batches:
            lists = batch.column("ids")
            flat, off = lists.flatten().to_pylist(), np.asarray(lists.offsets)
            off = off - off[0]
            rows, at = [], 0
            for k, valid in enumerate(np.asarray(lists.is_valid())):
                n = int(off[k + 1] - off[k]) if valid else 0
                rows.append(b"".join([tokens[i] for i in flat[at : at + n]]).decode("utf-8", "replace") if valid else None)
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids).  Ids that make no valid UTF-8 give U+FFFD there; null ids give a null text."""
    small_batches(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path), "doc_id bigint, text string")


# Counting -------------------------------------------------------------------------------------------------------


def chunk_ranges(n: int, huge: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges of the chunks of a text of n characters; each starts ``overlap`` before the last one's end."""
    step = max(1, huge - overlap)
    starts = range(0, max(1, n - overlap), step)
    return [(a, min(n, a + huge)) for a in starts]


def boundaries(v: Vocabulary, text: str) -> np.ndarray:
    """Byte offsets of the token boundaries of a text encoded by itself, 0 and the end included."""
    return np.concatenate([[0], np.cumsum(v.length[v.encode(text)])]).astype(np.int64)


def splice(v: Vocabulary, text: str, ranges: list[tuple[int, int]]) -> tuple[int, int]:
    """Tokens of ``text`` from chunks, and how often an overlap had to be widened."""
    total, widened = 0, 0
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(text[a:b].encode()) for a, b in zip([r[0] for r in ranges], [*[r[0] for r in ranges[1:]], len(text)])])])
    certain = v.cuts(raw)
    have = boundaries(v, text[slice(*ranges[0])])  # of the part before, from byte ``base`` on
    base = 0
    for k in range(1, len(ranges)):
        a, b = ranges[k]
        start, reach = int(at[k]), ranges[k - 1][1] - a
        left_end = base + int(have[-1])
        while True:
            right = boundaries(v, text[a:b]) + start
            common = np.intersect1d(np.intersect1d(have + base, right), certain)
            common = common[(common > start) & (common < left_end)]
            if len(common) or a == 0:
                break
            reach *= 2
            widened += 1
            a2 = max(0, a - reach)
            start -= len(text[a2:a].encode())
            a = a2
        if len(common):
            cut = int(common[len(common) // 2])
            total += int(np.searchsorted(have + base, cut))
        else:  # encoded from the document's start: it replaces all before
            cut, total = 0, 0
        have, base = right[right >= cut] - cut, cut
    return total + len(have) - 1, widened


def _count(path: str, huge: int, overlap: int):
    def run(batches):
        v = vocabulary(path)
        for batch in blocks(batches):
            ids = batch.column("doc_id")
            out, parts, wide = [], [], []
            for text in batch.column("text").to_pylist():
                if text is None:
                    out.append(None), parts.append(0), wide.append(0)
                elif len(text) <= huge:
                    out.append(len(v.encode(text))), parts.append(1), wide.append(0)
                else:
                    ranges = chunk_ranges(len(text), huge, overlap)
                    n, w = splice(v, text, ranges)
                    out.append(n), parts.append(len(ranges)), wide.append(w)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.int64()), pa.array(parts, pa.int32()), pa.array(wide, pa.int32())], ["doc_id", "n_tokens", "chunks", "widened"])

    return run


def count_tokens(docs: DataFrame, path: str = VOCABULARY, huge: int = HUGE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, chunks, widened) of every row; see the module's text."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_count(path, huge, overlap), "doc_id bigint, n_tokens bigint, chunks int, widened int")


def op5_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
