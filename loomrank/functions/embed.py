"""Embedding seam: any function of texts to vectors, and a deterministic one from hashed words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.sources.shared import small_batches

#: model family: (before a query, before a document)
PREFIXES = {"nomic": ("search_query: ", "search_document: "), "e5": ("query: ", "passage: "), "gemma": ("task: search result | query: ", "title: none | text: ")}


def prefixes(model: str) -> tuple[str, str]:
    """What a model's family wants before queries and documents."""
    return next((p for name, p in PREFIXES.items() if name in model.lower()), ("", ""))


def _hashed_rows(dims: int):
    """Sums of a row's words, worked out once for each word of a batch."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            known = words.dictionary.cast(pa.binary())
            h = np.frombuffer(b"".join(hashlib.md5(w).digest()[:4] for w in known.to_pylist()), ">u4").astype(np.int64)
            sign = np.where(h >= 1 << 31, -1, 1) * (pc.binary_length(known).to_numpy(zero_copy_only=False) > 0)
            at, row = words.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
            x = np.bincount(row * dims + (h % dims)[at], sign[at], batch.num_rows * dims).reshape(batch.num_rows, dims).astype(np.int32)
            some = np.flatnonzero(x.any(1))
            ends = pa.array(np.arange(0, len(some) * dims + 1, dims), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(x[some].ravel()))], ["id", "x"])

    return run


def _hashed_texts(dims: int):
    """The sums of rows that share an id, at unit length."""

    def run(batches):
        for batch in batches:
            x, lists = np.zeros((batch.num_rows, dims)), batch.column(1)
            rows = lists.flatten().flatten().to_numpy().reshape(-1, dims)
            np.add.at(x, pc.list_parent_indices(lists).to_numpy(), rows)
            some = np.flatnonzero(x.any(1))
            x = x[some] / np.sqrt(np.square(x[some]).sum(1, keepdims=True))
            ends = pa.array(np.arange(0, len(some) * dims + 1, dims), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "vector"])

    return run


def hashed(docs: DataFrame, dims: int = 64, id_col: str = "doc_id") -> DataFrame:
    """(id, vector): each lower-cased alphanumeric word adds 1 or -1 to a dimension, both by its MD5; unit length.

    What is shuffled is a vector a row, not its words; rows that share an id are added up.
    """
    small_batches(docs.sparkSession)
    words = docs.select(F.col(id_col).alias("id"), F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+").alias("w"))
    rows = words.mapInArrow(_hashed_rows(dims), f"id {dict(docs.dtypes)[id_col]}, x array<int>").groupBy("id").agg(F.collect_list("x").alias("x"))
    return rows.mapInArrow(_hashed_texts(dims), f"id {dict(docs.dtypes)[id_col]}, vector array<double>").withColumnRenamed("id", id_col)


def embedded(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 64, text_col: str = "text") -> DataFrame:
    """``docs`` with a vector from any embedder, called with at most ``batch`` texts at a time."""

    def run(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            out = [v for a in range(0, len(texts), batch) for v in np.asarray(embed(texts[a : a + batch]), np.float32)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.tolist() for v in out], pa.list_(pa.float32()))], [*b.schema.names, "vector"])

    return docs.mapInArrow(run, docs.schema.add("vector", "array<float>"))
