"""Folders that outlive an executor, id filters of a fixed size, and column checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 1 << 20
_WORDS, _HASHES = 1 << 20, 3


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, as in local tests, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="loomrank-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage is cut and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that very long texts don't meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Just the columns needed, ids as bigint and text as string; other columns, whatever their names, are left out."""
    kinds = {"doc_id": "bigint", "text": "string"}
    return docs.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in (columns or ("doc_id", "text"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(docs: DataFrame) -> list:
    """All columns of ``docs``, whatever marks their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer by marks until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(side: DataFrame, most: int = FEW) -> DataFrame:
    """``side``, to be broadcast if it has at most ``most`` rows, which must be short ones; else joined by a shuffle."""
    return F.broadcast(side) if side.count() <= most else side


def places(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of each id for hash number k."""
    from ._text import mix

    h = mix(ids.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
    return (h >> np.uint64(8)) & np.uint64(_WORDS - 1), np.uint64(1) << (h & np.uint64(63))


def id_filter(ids: DataFrame, column: str):
    """A broadcast Bloom filter of 8 MB, whatever the number of ids: ``passes`` is true for all of them and for few others.

    With very many ids it lets more and more others pass, so what it lets through is joined with the ids again.
    """

    def bits(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            for k in range(_HASHES):
                word, bit = places(own, k)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bit.view(np.int64))], ["word", "bits"])

    got = ids.select(column).mapInArrow(bits, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(_WORDS, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(out)


def passes(only, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter may hold."""
    ok = np.ones(len(ids), bool)
    for k in range(_HASHES):
        word, bit = places(ids, k)
        ok &= (only.value[word.astype(np.int64)] & bit) != 0
    return ok


def filtered(docs: DataFrame, keeper) -> DataFrame:
    """The rows for whose texts ``keeper()`` gives true, with all columns, whatever their names; the texts stay whole."""
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"

    def run(batches):
        from ._text import blocks

        keep = keeper()
        for batch in blocks(batches, text):
            yield batch.filter(pa.array(keep(batch.column(text))))

    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
