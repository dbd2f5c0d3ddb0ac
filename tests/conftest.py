"""A local session, and the comparison of a query with its SQL."""

from __future__ import annotations

import datetime
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ["TZ"] = "UTC"
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.codegen.cache.maxEntries": "500",
        "spark.python.worker.reuse": "true",
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(x):
    """A value as either engine gives it, made comparable."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, datetime.datetime) and x.tzinfo:
        return x.replace(tzinfo=None)
    if type(x).__name__ == "Decimal":
        return round(float(x), 5)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


def run_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if os.path.isdir(os.path.dirname(path)) or os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


@pytest.fixture(scope="session")
def same():
    """Asserts that a query gives its SQL's rows; returns how many there are."""

    def check(df, sql: str, sf_dir: str = DATA) -> int:
        columns, want = run_sql(sql, sf_dir)
        assert sorted(df.columns) == sorted(columns)
        got = rows_of(df.columns, df.collect())
        want = rows_of(columns, want)
        assert len(got) == len(want), (len(got), len(want))
        wrong = [(a, b) for a, b in zip(got, want) if a != b]
        assert not wrong, wrong[:3]
        return len(got)

    return check


@pytest.fixture(scope="session")
def data() -> str:
    return DATA
