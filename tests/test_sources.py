"""Snapshots, buckets, fused seeds and the entry module's guard."""

import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomrank.operators import retrieve
from loomrank.sources import readers


def test_snapshots_swap_whole_versions(spark, tmp_path):
    path = f"{tmp_path}/store"
    first = spark.createDataFrame([(1, [1.0], "c")], "id int, vector array<double>, codes string")
    assert readers.save({"chunks": first}, path).endswith("v1")
    held = readers.load(spark, path)["chunks"]
    assert readers.save({"chunks": first.union(first), "docs": spark.range(3)}, path, vectors="codes").endswith("v2")
    now = readers.load(spark, path)
    assert held.count() == 1 and now["chunks"].count() == 2 and now["chunks"].columns == ["id", "codes"] and now["docs"].count() == 3
    with pytest.raises(ValueError):
        readers.save({"chunks": first}, path, vectors="some")


def test_buckets(spark, tmp_path):
    for name in ("one", "two"):
        spark.range(1).write.parquet(readers.bucket_path(str(tmp_path), name) + "/t")
    assert readers.buckets(spark, str(tmp_path)) == ["one", "two"]
    assert readers.delete_bucket(spark, str(tmp_path), "one") and readers.buckets(spark, str(tmp_path)) == ["two"]
    with pytest.raises(ValueError):
        readers.bucket_path(str(tmp_path), "../up")


def test_fused_mass(spark):
    seeded = spark.createDataFrame([(0, 1, 0.9, None), (0, 2, 0.8, 3.0), (0, 3, None, 5.0)], "qid int, id int, sim double, bm double")
    got = {r.node: r.weight for r in retrieve.fused_mass(seeded).withColumn("weight", F.round("weight", 9)).collect()}
    assert got == {1: round(1 / 61, 9), 2: round(1 / 62 + 1 / 62, 9), 3: round(1 / 61, 9)}


def test_entry_without_the_subpackage(monkeypatch):
    """Where the subpackage, or a library that it needs, can't be imported, the other queries stay."""
    monkeypatch.setitem(sys.modules, "loomrank.llm.registry", None)
    names = set(__spark_entry__.queries())
    assert "bm25_topk" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert "bm25_topk" in __spark_entry__.oracle_sql()
