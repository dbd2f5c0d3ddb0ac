"""Corpus maintenance: content identity, upserts, versions, deletion, merging, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def new_documents(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch (ord, doc_id, text) whose content no known document has; in the batch the first of each content, then of each id, stays."""
    b = batch.withColumn("hash", content_hash(F.col("text"))).join(known.select(content_hash(F.col("text")).alias("hash")).distinct(), "hash", "left_anti")
    for key in ("hash", "doc_id"):
        first = Window.partitionBy(key).orderBy("ord")
        b = b.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    return b.drop("hash")


def owners(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, duplicate): the least id with a document's content."""
    w = Window.partitionBy(content_hash(F.col("text")))
    return docs.select("doc_id", F.min("doc_id").over(w).alias("owner")).withColumn("duplicate", F.col("doc_id") != F.col("owner"))


def upsert_actions(store: DataFrame, batch: DataFrame) -> DataFrame:
    """(doc_id, action, owner) of each document of a batch: duplicate of another id's content, unchanged, updated or added."""
    s = store.select("doc_id", content_hash(F.col("text")).alias("old"))
    owner = store.groupBy(content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("owner"))
    b = batch.select("doc_id", content_hash(F.col("text")).alias("hash"))
    j = b.join(s, "doc_id", "left").join(owner, "hash", "left")
    action = F.when(F.col("old") == F.col("hash"), "unchanged").when(F.col("owner").isNotNull(), "duplicate").when(F.col("old").isNotNull(), "updated").otherwise("added")
    return j.select("doc_id", action.alias("action"), F.when(action == "duplicate", F.col("owner")).alias("owner"))


def upserted(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store after a batch (doc_id, text): updates replace, additions join, duplicates and unchanged ones do nothing."""
    act = upsert_actions(store, batch).filter("action in ('updated', 'added')").select("doc_id")
    fresh = batch.join(act, "doc_id", "left_semi").select("doc_id", "text")
    return store.select("doc_id", "text").join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh)


def chunks_to_embed(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, reused): a chunk whose document had the same text before keeps its vector."""
    had = old_chunks.select("doc_id", content_hash(F.col("text")).alias("hash"), F.lit(True).alias("had")).distinct()
    return new_chunks.select("doc_id", "pos", content_hash(F.col("text")).alias("hash")).join(had, ["doc_id", "hash"], "left").select("doc_id", "pos", F.coalesce("had", F.lit(False)).alias("reused"))


def without(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cascade of a deletion to any table that has the document's id."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def versions(history: DataFrame) -> DataFrame:
    """(doc_id, n, hash, bytes, current) of a history (doc_id, time, text): a text equal to the one before is no version."""
    t = Window.partitionBy("doc_id").orderBy("time")
    h = history.withColumn("hash", content_hash(F.col("text")))
    h = h.withColumn("before", F.lag("hash").over(t)).filter("before is null or before <> hash")
    h = h.withColumn("n", F.row_number().over(t))
    last = F.max("n").over(Window.partitionBy("doc_id"))
    return h.select("doc_id", "n", F.substring("hash", 1, 8).alias("hash"), F.octet_length("text").cast("bigint").alias("bytes"), (F.col("n") == last).alias("current"))


def version_text(history: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) of version n of each document that has one."""
    t = Window.partitionBy("doc_id").orderBy("time")
    h = history.withColumn("before", F.lag("text").over(t)).filter("before is null or before <> text")
    return h.withColumn("n", F.row_number().over(t)).filter(F.col("n") == n).select("doc_id", "text")


def merged_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, meta): new metadata where it isn't empty, else the old."""
    filled = F.when(~F.coalesce("new_meta", F.lit("")).isin("", "{}"), F.col("new_meta"))
    j = old.join(new.withColumnRenamed("meta", "new_meta"), "doc_id", "full")
    return j.select("doc_id", F.coalesce(filled, F.col("meta")).alias("meta"))


def listing(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, bytes) of chunks (doc_id, pos, text)."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))


def merge(dst: DataFrame, src: DataFrame, dst_space: str = "", src_space: str = "") -> DataFrame:
    """The union of two stores (doc_id, text, ...): source documents whose id or content the destination has are skipped.

    Stores of different vector spaces are refused.
    """
    if dst_space != src_space:
        raise ValueError(f"stores of different vector spaces: {dst_space!r} and {src_space!r}")
    taken = src.join(dst.select("doc_id"), "doc_id", "left_anti")
    h = content_hash(F.col("text"))
    taken = taken.withColumn("hash", h).join(dst.select(h.alias("hash")).distinct(), "hash", "left_anti").drop("hash")
    return dst.unionByName(taken)
