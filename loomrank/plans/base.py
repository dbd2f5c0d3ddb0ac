"""Registration of queries with their SQL, and the tables and SQL parts they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions.text import STOPWORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir), under its own name unless another is given, with the SQL that gives the same."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def corpus(spark, d):
    """Documents that have a vector: (id, text, vector)."""
    return documents(spark, d).withColumnRenamed("doc_id", "id").join(items(spark, d), "id")


def questions(spark, d):
    """Benchmark items as queries (qid, query, qv)."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"))
    return b.join(items(spark, d), "id").select(F.col("id").alias("qid"), "query", F.col("vector").alias("qv"))


WORD = r"[\p{L}\p{Nd}]+"
FIELD = r"[^\s\x{85}\p{Z}]+"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tok(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{WORD}'), lambda w: lower(w)), lambda w: strlen(w) >= 2 AND w NOT IN ({_STOP}))"


def fields(x: str) -> str:
    return f"regexp_extract_all({x}, '{FIELD}')"


def cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


def top(source: str, k: int, order: str = "score DESC, id", part: str = "qid") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


CORPUS = "corpus AS (SELECT doc_id AS id, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id)"
ITEMS = "items AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
QUESTIONS = "qs AS (SELECT item_id AS qid, text AS query, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON item_id = vec_id)"


def dense(k: int, source: str = "corpus", name: str = "dense", qs: str = "qs") -> str:
    return f"{name}_all AS (SELECT qid, id, round({cos('v', 'qv')}, 6) AS score FROM {source}, {qs}), {name} AS ({top(name + '_all', k)})"


def bm25_sql(k: int, source: str, name: str = "sparse", key: str = "id") -> str:
    """CTEs: the k best of ``source`` (key, text) by BM25 for qs (qid, query)."""
    return f"""{name}_d AS (SELECT {key} AS id, {tok('text')} AS ws FROM {source}),
{name}_n AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM {name}_d),
{name}_p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM {name}_d) GROUP BY ALL),
{name}_f AS (SELECT term, ln(1.0::DOUBLE + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM {name}_p, {name}_n GROUP BY term, n),
{name}_q AS (SELECT DISTINCT qid, unnest({tok('query')}) AS term FROM qs),
{name}_all AS (SELECT qid, id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / avgdl))), 6) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_f USING (term) JOIN {name}_d USING (id), {name}_n GROUP BY qid, id),
{name} AS ({top(name + '_all', k)})"""
