"""Chunkers: fixed word windows as a Spark expression; structure-aware ones as Arrow-batched functions."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.functions.text import fields
from loomrank.sources.shared import small_batches

TARGET, OVERLAP = 120, 24
_BREAKS = ("\n\n", "\n", ". ", " ")
_SHORT = frozenset("al co dr e.g etc fig i.e inc jr ltd mr mrs ms no prof sr st vs".split())
_LETTERS = string.ascii_letters + "."
_IS_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])
CHUNK = "chunk_id string, doc_id bigint, pos int, text string, start int, end int, headings array<string>"


def bounds(target: int | None, overlap: int | None) -> tuple[int, int]:
    target = TARGET if not target or target <= 0 else target
    overlap = OVERLAP if overlap is None else overlap
    return target, target // 4 if overlap < 0 or overlap >= target else overlap


def word_chunks(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, pos, text): windows of target words, overlap words in common; the last ends with the text."""
    target, overlap = bounds(target, overlap)
    stride = max(1, target - overlap)
    words = docs.select("doc_id", fields(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - target) / F.lit(float(stride)))).cast("int")
    rows = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return rows.select(F.concat_ws("#", "doc_id", "pos").alias("chunk_id"), "doc_id", "pos", F.array_join(F.slice("w", F.col("pos") * stride + 1, F.lit(target)), " ").alias("text"))


def _parts(text: str, marks: tuple[str, ...], target: int) -> list[str]:
    if not text.strip():
        return []
    if len(text.split()) <= target or not marks:
        return [text]
    pieces = text.split(marks[0])
    pieces = [p + marks[0] for p in pieces[:-1]] + pieces[-1:]
    return [q for p in pieces if p.strip() for q in _parts(p, marks[1:], target)]


def _packed(parts: list[str], target: int, overlap: int) -> list[str]:
    """Parts joined up to the target; each further piece begins with the last words of the one before."""
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close():
        body = " ".join(held).strip()
        if size and body:
            out.append(body)

    for part in parts:
        n = len(part.split())
        if size and size + n > target:
            tail = " ".join(" ".join(held).split()[-overlap:]) if overlap else ""
            close()
            held, size = ([tail], len(tail.split())) if tail else ([], 0)
        held.append(part.strip())
        size += n
    close()
    return out


def recursive_pieces(text: str, target: int = TARGET, overlap: int = OVERLAP):
    """Paragraphs, lines, sentences, words: the coarsest that fit, packed."""
    return [(p, []) for p in _packed(_parts(text, _BREAKS, target), target, overlap)]


def sentences(text: str) -> list[str]:
    """Split after .!? before white space; a full stop also needs a capital or digit next and no abbreviation before."""
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s|$)", text):
        if m.group() == ".":
            left = text[max(0, m.start() - 64) : m.start()].removesuffix("\n")
            word = left[len(left.rstrip(_LETTERS)) :]
            if word.rstrip(".").lower() in _SHORT:
                continue
            after = text[m.end() :].lstrip()[:1] if len(text) - m.end() < 256 else (text[m.end() : m.end() + 256].lstrip() or text[m.end() :].lstrip())[:1]
            if after and not after.isupper() and after not in "0123456789":
                continue
        piece = text[start : m.end()].strip()
        if piece:
            out.append(piece)
        start = m.end()
    rest = text[start:].strip()
    return out + [rest] if rest else out


def sentence_pieces(text: str, target: int = TARGET, overlap: int = OVERLAP):
    return [(p, []) for p in _packed(sentences(text), target, overlap)]


def markdown_pieces(text: str, target: int = TARGET, overlap: int = OVERLAP):
    """Sections with their headings; tables (with the line before as caption) and fenced blocks whole, prose packed."""
    out: list[tuple[str, list[str]]] = []
    path: list[tuple[int, str]] = []
    prose: list[str] = []
    table: list[str] = []
    fence: list[str] | None = None
    caption = ""
    names = lambda: [t for _, t in path]

    def end_prose():
        if prose:
            out.extend((p, names()) for p in _packed(_parts("\n".join(prose), _BREAKS, target), target, overlap))
            prose.clear()

    def end_table():
        if table:
            out.append(("\n".join([caption, *table] if caption else table).strip(), names()))
            table.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if fence is not None:
            fence.append(line)
            if bare.startswith("```"):
                out.append(("\n".join(fence).strip(), names()))
                fence = None
        elif bare.startswith("```"):
            end_table()
            end_prose()
            fence = [line]
        elif bare.startswith("|") and bare.count("|") > 1:
            if not table:
                caption = next((p.strip() for p in reversed(prose) if p.strip()), "")
                end_prose()
            table.append(line)
        else:
            end_table()
            head = re.match(r"(#{1,6}) (.*)", bare, re.S)
            if head:
                end_prose()
                level = len(head[1])
                path[:] = [h for h in path if h[0] < level] + [(level, head[2].strip())]
            else:
                prose.append(line)
    if fence:
        out.append(("\n".join(fence).strip(), names()))
    end_table()
    end_prose()
    return out


class Places:
    """Where pieces stand in a text, white space aside: one pass over the text, then a search a piece without it."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.flatnonzero(~_IS_SPACE[np.minimum(codes, len(_IS_SPACE) - 1)]).astype(np.int32)
        self.dense = "".join(text.split())

    def located(self, piece: str, start: int) -> tuple[int, int]:
        """From ``start`` on; (-1, -1) if nowhere.  Long pieces begin with eight words that are words of the text too."""
        words = piece.split()
        if not words:
            return -1, -1
        whole, head = "".join(words), words[:2] if len(piece) < 200 else words[:8]
        first = "".join(head)
        k = self.dense.find(first, int(np.searchsorted(self.at, max(0, start))))
        while k >= 0:
            if len(piece) >= 200 and not self._words(k, head):
                k = self.dense.find(first, k + 1)
            elif self.dense.startswith(whole, k):
                return int(self.at[k]), int(self.at[k + len(whole) - 1]) + 1
            else:
                k = self.dense.find(first, k + len(first))
        return -1, -1

    def _words(self, k: int, head: list[str]) -> bool:
        """Whether white space stands between these words from the k-th character on, and nowhere in them."""
        for n, w in enumerate(head):
            if self.at[k + len(w) - 1] - self.at[k] != len(w) - 1 or (n and self.at[k] == self.at[k - 1] + 1):
                return False
            k += len(w)
        return True


def located(text: str, piece: str, start: int) -> tuple[int, int]:
    """Where a piece stands in its text from ``start`` on, white space aside; (-1, -1) if nowhere."""
    return Places(text).located(piece, start)


STRATEGIES: dict[str, Callable] = {
    "recursive": recursive_pieces,
    "sentence": sentence_pieces,
    "markdown": markdown_pieces,
}


def chunks(docs: DataFrame, strategy: str | Callable = "recursive", target: int | None = None, overlap: int | None = None) -> DataFrame:
    """Chunks of documents (doc_id, text) by a named strategy (unknown names mean recursive) or a function text -> pieces.

    A piece is text with a list of headings, which go before the chunk's text as a line of their own.  Start and end are
    the characters of the piece in the document.
    """
    target, overlap = bounds(target, overlap)
    small_batches(docs.sparkSession)
    split = strategy if callable(strategy) else STRATEGIES.get(strategy, recursive_pieces)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                cursor, places = 0, Places(text or "")
                for pos, (piece, heads) in enumerate(split(text or "", target, overlap)):
                    a, b = places.located(piece, cursor)
                    cursor = max(cursor, a)
                    rows.append((f"{doc_id}#{pos}", doc_id, pos, " > ".join(heads) + "\n" + piece if heads else piece, a, b, list(heads)))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["chunk_id", "doc_id", "pos", "text", "start", "end", "headings"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, CHUNK)


def index_text(context: F.Column, text: F.Column) -> F.Column:
    """What is embedded and indexed: the context before the text, if there is any."""
    return F.when(F.coalesce(context, F.lit("")) == "", text).otherwise(F.concat(context, F.lit("\n\n"), text))


def windowed(chunks: DataFrame, hits: DataFrame, width: int = 1) -> DataFrame:
    """(qid, chunk_id, passage): each hit with its neighbours up to width positions away in its document, in order."""
    around = hits.join(chunks.select("chunk_id", "doc_id", "pos"), "chunk_id")
    near = chunks.select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("text").alias("t"))
    j = around.join(near, (F.col("doc_id") == F.col("d")) & F.col("p").between(F.col("pos") - width, F.col("pos") + width))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda s: s["t"])
    return j.groupBy("qid", "chunk_id").agg(F.array_join(parts, "\n").alias("passage"))
