"""Streaming ingestion: files of documents come in as micro-batches, are redacted, deduplicated and stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions.redact import redacted
from loomrank.operators.corpus import new_documents

KINDS = "doc_id bigint, text string"


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str, files_at_once: int = 8) -> int:
    """All new Parquet files of documents under ``source`` into the table ``store``; rows added.

    A batch keeps its own folder under the store, written over if the batch runs again, so a replay adds nothing.
    """
    before = _rows(spark, store)

    def add(batch: DataFrame, n: int) -> None:
        clean = redacted(batch.select("doc_id", "text")).drop("findings").withColumn("ord", F.col("doc_id"))
        known = [p for p in _parts(spark, store) if not p.endswith(f"batch={n}")]
        old = spark.read.schema(KINDS).parquet(*known) if known else spark.createDataFrame([], KINDS)
        fresh = new_documents(clean, old).join(old.select("doc_id"), "doc_id", "left_anti")
        fresh.select("doc_id", "text").write.mode("overwrite").parquet(f"{store}/batch={n}")

    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", files_at_once).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _rows(spark, store) - before


def _parts(spark: SparkSession, store: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName().startswith("batch=")]


def _rows(spark: SparkSession, store: str) -> int:
    parts = _parts(spark, store)
    return spark.read.schema(KINDS).parquet(*parts).count() if parts else 0


def stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(KINDS).parquet(*_parts(spark, store))
