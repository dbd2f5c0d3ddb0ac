"""Lexical ranking: term statistics, BM25 and reciprocal rank fusion, for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions.text import word_tokens
from loomrank.sources.shared import small_batches

K1, B, RRF_K = 1.2, 0.75, 60
MOST_TERMS = 1 << 20


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col), F.explode(word_tokens(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl): documents without terms count with length 0."""
    return docs.select(F.col(id_col), F.size(word_tokens(F.coalesce(F.col(text_col), F.lit("")))).cast("bigint").alias("dl"))


def corpus_size(dl: DataFrame) -> DataFrame:
    """One row: n documents, mean length."""
    return dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(df: F.Column, n: F.Column) -> F.Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def document_frequency(post: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(size).select("term", "df", F.round(idf(F.col("df"), F.col("n")), 6).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, id_col: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, id, score, rank): the k best documents for each query (qid, query); its repeated terms count once.

    Documents are scored where they are read, in two passes: one counts, the other keeps a task's k best a query, so only
    those are shuffled.  Joins of the postings do the same where all scores are wanted, ids repeat (their rows' terms are
    added up, but each row has its length) or the queries' terms are too many to send to every task.
    """
    k1, b = max(k1, 0.0), min(max(b, 0.0), 1.0)
    terms = queries.select("qid", F.explode(F.array_distinct(word_tokens(F.col("query")))).alias("term")).distinct()
    plain = all(dict(df.dtypes)[c] in ("smallint", "int", "bigint", "string") for df, c in ((docs, id_col), (queries, "qid")))
    asked = terms.limit(MOST_TERMS + 1).toArrow() if k and plain else None
    if asked is None or asked.num_rows > MOST_TERMS or not docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return _bm25_of_postings(docs, terms, k, id_col, k1, b)
    return best(_bm25_of_texts(docs, asked, k, id_col, k1, b, dict(queries.dtypes)["qid"]), k, id_col)


def _wanted(batch, words: pa.Array):
    """(row, term, tf) of a batch's words among ``words``, and the rows' lengths."""
    lists = batch.column(1)
    flat = lists.flatten().dictionary_encode()
    at = pc.fill_null(pc.index_in(flat.dictionary.cast(pa.string()), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    term = at[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
    row = pc.list_parent_indices(lists).to_numpy()[term >= 0].astype(np.int64)
    key, tf = np.unique(row * max(len(words), 1) + term[term >= 0], return_counts=True)
    row, term = np.divmod(key, max(len(words), 1))
    return row, term, tf, pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _bm25_of_texts(docs: DataFrame, asked: pa.Table, k: int, id_col: str, k1: float, b: float, qid_kind: str) -> DataFrame:
    from loomrank.operators.vector import _Best, _numbers

    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), word_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    coded = asked.column("term").combine_chunks().dictionary_encode()
    who = asked.column("qid").combine_chunks().dictionary_encode()
    words, names = coded.dictionary.cast(pa.string()), who.dictionary
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    of, first = who.indices.to_numpy()[order].astype(np.int64), np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(words) + 1))
    shared = spark.sparkContext.broadcast((words, names, of, first))

    def count(batches):
        df, n, dl = np.zeros(len(shared.value[0]), np.int64), 0, 0
        for batch in batches:
            _, term, _, size = _wanted(batch, shared.value[0])
            df += np.bincount(term, minlength=len(df))
            n, dl = n + batch.num_rows, dl + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df))), pa.array([dl, n, *df.tolist()], pa.int64())], ["term", "n"])

    counts = texts.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").toArrow().column("n").to_numpy()
    dl_all, n, df = (counts[0], counts[1], counts[2:]) if len(counts) else (0, 0, np.zeros(len(words)))
    idf_of, mean = np.log(1.0 + (n - df + 0.5) / (df + 0.5)), dl_all / n if n else 0.0

    def score(batches):
        words, names, of, first = shared.value
        held, kind = _Best(len(names), k, -np.inf), None
        wide = np.diff(first)
        for batch in batches:
            ids, kind = _numbers(batch.column(0)), batch.column(0).type
            row, term, tf, size = _wanted(batch, words)
            part = idf_of[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * (size[row] / mean)))
            # rows in turns of at most 2^21 sums, and of so many additions unless a row alone has more
            load = np.concatenate([[0], np.cumsum(np.bincount(row, wide[term], batch.num_rows))])
            start = 0
            while start < batch.num_rows and len(row):
                end = max(start + 1, min(start + (1 << 21) // len(names), int(np.searchsorted(load, load[start] + (1 << 21), "right")) - 1))
                own = slice(*np.searchsorted(row, [start, end]))
                many = wide[term[own]]
                at = np.repeat(first[term[own]] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if many.size else np.zeros(0, np.int64)
                sums = np.bincount(np.repeat(row[own] - start, many) * len(names) + of[at], np.repeat(part[own], many), (end - start) * len(names))
                hit = np.flatnonzero(sums)
                r, q = np.divmod(hit, len(names))
                held.add(q, np.floor(sums[hit] * 1e6 + 0.5) / 1e6, ids[r + start])
                start = end
        held.settle()
        if held.ids is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(held.row)), pa.array(held.ids, kind), pa.array(held.score)], ["qid", "id", "score"])

    out = texts.mapInArrow(score, f"qid {qid_kind}, id {dict(docs.dtypes)[id_col]}, score double")
    return out.withColumnRenamed("id", id_col)


def _bm25_of_postings(docs: DataFrame, terms: DataFrame, k: int | None, id_col: str, k1: float, b: float) -> DataFrame:
    """Only postings of query terms are grouped and joined: the terms are told before the shuffle by a join that Spark
    broadcasts when they are small enough."""
    tokens = docs.select(F.col(id_col), F.explode(word_tokens(F.col("text"))).alias("term"))
    wanted = tokens.join(terms.select("term").distinct(), "term", "left_semi")
    post = wanted.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    dl = lengths(docs, id_col)
    size = corpus_size(dl)
    df = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(size).select("term", idf(F.col("df"), F.col("n")).alias("idf"), "avgdl")
    tf, longness = F.col("tf").cast("double"), F.col("dl") / F.col("avgdl")
    part = F.col("idf") * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * longness))
    scored = post.join(df, "term").join(dl, id_col).select(id_col, "term", part.alias("part")).join(terms, "term")
    scored = scored.groupBy("qid", id_col).agg(F.round(F.sum("part"), 6).alias("score"))
    return best(scored, k, id_col)


def best(scored: DataFrame, k: int | None, id_col: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query by score, then id; with their rank from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), id_col)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = RRF_K, id_col: str = "doc_id") -> DataFrame:
    """(qid, id, score): sum over the rankings (qid, id, rank from 1) of 1 / (k + rank - 1); repeats count once, at their best."""
    k = k or RRF_K
    union = None
    for i, r in enumerate(rankings):
        own = r.groupBy("qid", id_col).agg(F.min("rank").alias("rank")).withColumn("list", F.lit(i))
        again = Window.partitionBy("qid").orderBy("rank", id_col)
        own = own.withColumn("place", F.row_number().over(again) - 1)
        union = own if union is None else union.unionByName(own)
    return union.groupBy("qid", id_col).agg(F.round(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("place"))), 9).alias("score"))
