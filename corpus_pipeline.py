"""Corpus pipeline: toxicity, quality, near duplicates, identifiers, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents, but
for the last, which returns the packed windows.  ``run`` writes each stage's result as Parquet in the shared folder and
reads it again as the next one's documents.

Rows without a text have nothing to train on: they pass toxicity, leave at quality.  Extra columns, whatever their names,
pass through up to packing.  Of documents that near duplicates connect, the one with the least id stays.  Rows that share
an id are one document there: the row whose text hashes least stays (ties: any of the equal texts).  Rows without an id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.llm import jaccard_join, packing, pii, quality, toxicity
from loomrank.llm._shared import every, free_name, small, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = written(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        place = free_name(docs, "place")
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        one = docs.join(repeated, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
        docs = docs.join(repeated, "doc_id", "left_anti").select(every(docs)).unionByName(one.select(every(docs)))
    groups = jaccard_join.grouped(docs)
    first = groups.groupBy("root").agg(F.min("doc_id").alias("first"))
    rest = written(groups.join(first, "root").filter("doc_id <> first").select("doc_id"), "duplicates")
    return docs.join(small(rest), "doc_id", "left_anti").select(every(docs))


def mask_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, pii.find_identifiers(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", keep_one_of_each),
    ("pii", mask_identifiers),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
