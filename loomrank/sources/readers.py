"""Sources: files through extractors, JSON and base64 ingestion, benchmark suites, snapshots, buckets, the journal."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_KINDS = ("markdown", "md", "text", "txt")
BUCKET = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}")
Extractor = Callable[[str, bytes], str]


class Command:
    """An external extractor: ``{in}`` and ``{out}`` in its arguments are files; without ``{out}`` its standard output counts."""

    def __init__(self, *argv: str, seconds: float = 120):
        self.argv, self.seconds = argv, seconds

    def __call__(self, name: str, content: bytes) -> str:
        with tempfile.TemporaryDirectory() as d:
            src, dst = os.path.join(d, "in" + os.path.splitext(name)[1]), os.path.join(d, "out.txt")
            with open(src, "wb") as f:
                f.write(content)
            argv = [a.replace("{in}", src).replace("{out}", dst) for a in self.argv]
            done = subprocess.run(argv, capture_output=True, timeout=self.seconds, check=True)
            if any("{out}" in a for a in self.argv):
                with open(dst, "rb") as f:
                    return f.read().decode("utf-8", "replace").rstrip()
            return done.stdout.decode("utf-8", "replace").rstrip()


def default_extractors() -> dict[str, Extractor]:
    """By extension: text as it is, PDF if its tool is there."""
    out: dict[str, Extractor] = {k: lambda name, content: content.decode("utf-8", "replace") for k in TEXT_KINDS}
    if shutil.which("pdftotext"):
        out["pdf"] = Command("pdftotext", "-layout", "{in}", "{out}")
    return out


def supported(extractors: dict[str, Extractor]) -> list[str]:
    return sorted(k.lower().lstrip(".") for k in extractors)


def extracted(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """(doc_id, text, error) of files (doc_id, content): by extension, whatever its case; a file that fails has an error, not the job."""
    table = {k.lower().lstrip("."): f for k, f in (extractors or default_extractors()).items()}

    def one(name: str, content: bytes):
        kind = os.path.splitext(name)[1].lower().lstrip(".")
        if kind not in table:
            return None, f"no extractor for .{kind}"
        try:
            text = table[kind](name, content)
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"
        return (text, None) if text else (None, "no text")

    def run(batches):
        for b in batches:
            names = b.column("doc_id").to_pylist()
            text, error = zip(*(one(n, c) for n, c in zip(names, b.column("content").to_pylist()))) if names else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string()), pa.array(error, pa.string())], ["doc_id", "text", "error"])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, "doc_id string, text string, error string")


def walk(spark: SparkSession, path: str, extractors: dict[str, Extractor] | None = None, done: DataFrame | None = None) -> DataFrame:
    """(doc_id, content) of the supported files under a path, told by their path from there, without those done (doc_id)."""
    kinds = supported(extractors or default_extractors())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = re.escape(os.path.abspath(path).rstrip("/"))
    files = files.select(F.regexp_replace("path", f"^(?:file:/*)?/*{root.lstrip('/')}/", "").alias("doc_id"), "content")
    files = files.filter(F.lower(F.regexp_extract("doc_id", r"\.([^./]+)$", 1)).isin(*kinds))
    return files.join(done.select("doc_id"), "doc_id", "left_anti") if done is not None else files


def from_base64(files: DataFrame) -> DataFrame:
    """(doc_id, content, error) of files (doc_id, b64)."""
    raw = F.try_to_binary("b64", F.lit("base64"))
    return files.select("doc_id", raw.alias("content"), F.when(raw.isNull(), "not base64").alias("error"))


def asset_id(content: Column, extension: Column) -> Column:
    """Content address of an image: 16 hex digits and the extension."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), F.lit("."), F.lower(extension))


def beir(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and cases (qid, query, relevant): title and text on lines of their own; cases without relevant ids are left out."""
    c = spark.read.schema("_id string, title string, text string").json(corpus)
    title = F.coalesce("title", F.lit(""))
    docs = c.select(F.col("_id").alias("doc_id"), F.when(title == "", F.col("text")).otherwise(F.concat(title, F.lit("\n"), F.col("text"))).alias("text"))
    q = spark.read.schema("_id string, text string").json(queries).select(F.col("_id").alias("qid"), F.col("text").alias("query"))
    r = spark.read.schema("qid string, doc string, score int").option("sep", "\t").option("header", True).csv(qrels).filter("score > 0")
    return docs, q.join(r.groupBy("qid").agg(F.sort_array(F.collect_set("doc")).alias("relevant")), "qid")


def multihop(spark: SparkSession, corpus: str, queries: str) -> tuple[DataFrame, DataFrame]:
    """Documents by their URL, and cases with the known evidence; null queries and cases without evidence are left out."""
    c = spark.read.option("multiLine", True).schema("title string, body string, url string").json(corpus)
    docs = c.select(F.col("url").alias("doc_id"), F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), F.col("body")).alias("text"))
    kind = "query string, question_type string, evidence_list array<struct<url:string>>"
    q = spark.read.option("multiLine", True).schema(kind).json(queries).filter("question_type is null or question_type <> 'null_query'")
    q = q.select(F.monotonically_increasing_id().cast("string").alias("qid"), "query", F.explode("evidence_list.url").alias("doc_id"))
    known = q.join(docs.select("doc_id"), "doc_id", "left_semi")
    return docs, known.groupBy("qid", "query").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant"))


def suite(lines: DataFrame) -> DataFrame:
    """(n, query, relevant, answer, error) of JSON lines (n from 1, value); blank lines are skipped, a bad one tells its number."""
    kind = "query string, relevant array<string>, answer string, bad string"
    x = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = lines.filter(F.trim("value") != "").select("n", x.alias("x"))
    return rows.select("n", "x.query", "x.relevant", "x.answer", F.when(F.col("x.bad").isNotNull(), F.concat(F.lit("line "), F.col("n").cast("string"))).alias("error"))


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """``suite`` of a file, its lines counted in order."""
    text = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return suite(text.select((F.col("n") + 1).alias("n"), "value"))


# Snapshots, buckets, journal --------------------------------------------------------------------------------------

VECTORS = ("exact", "codes", "none")


def save(tables: dict[str, DataFrame], path: str, vectors: str = "exact") -> str:
    """Tables as a new version under a path, which readers see only when all are written; the version's folder.

    ``vectors`` picks the columns of chunks: the whole vectors, the codes, or neither.
    """
    if vectors not in VECTORS:
        raise ValueError(f"vectors must be one of {VECTORS}")
    spark = next(iter(tables.values())).sparkSession
    fs, p = _fs(spark, path)
    n = 1 + max([int(s.getPath().getName()[1:]) for s in (fs.listStatus(p) if fs.exists(p) else []) if re.fullmatch(r"v\d+", s.getPath().getName())], default=0)
    folder = f"{path.rstrip('/')}/v{n}"
    drop = {"exact": ("codes",), "codes": ("vector",), "none": ("vector", "codes")}[vectors]
    for name, df in tables.items():
        df.drop(*drop).write.mode("overwrite").parquet(f"{folder}/{name}")
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_next")
    out = fs.create(new, True)
    out.write(bytearray(f"v{n}".encode()))
    out.close()
    now = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_current")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(now), how)  # in one step: a reader sees the old version or the new one
    return folder


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    fs, p = _fs(spark, path)
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_current"))  # Spark's own readers pass over such names
    version = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{version.strip()}")
    return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(folder)}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bucket_path(root: str, name: str) -> str:
    """The folder of a bucket, whose name must be plain."""
    if not BUCKET.fullmatch(name):
        raise ValueError(f"not a bucket name: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def buckets(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    return sorted(s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.isDirectory() and BUCKET.fullmatch(s.getPath().getName()))


def delete_bucket(spark: SparkSession, root: str, name: str) -> bool:
    fs, _ = _fs(spark, root)
    return fs.delete(spark._jvm.org.apache.hadoop.fs.Path(bucket_path(root, name)), True)


def export_json(table: DataFrame, vectors: bool = False) -> DataFrame:
    """(value): each row as JSON, with vectors only if asked for."""
    return (table if vectors else table.drop("vector", "codes")).select(F.to_json(F.struct("*")).alias("value"))


def journal_done(journal: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose last entry (doc_id, at, ok) is good: failed ones are tried again."""
    last = journal.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("at"))))
    return last.filter("k = 1 and ok").select("doc_id")


def page_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags, common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, c in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
