"""Evaluation: ranking metrics, answer metrics, intervals, percentiles, ablations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions.text import answer_words


def first_occurrences(ranked: DataFrame) -> DataFrame:
    """(qid, id, rank): repeated ids keep their first place; places are counted anew."""
    r = ranked.groupBy("qid", "id").agg(F.min("rank").alias("old"))
    return r.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("old", "id")).alias("rank"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, recall, precision, mrr, ndcg, context_precision) of rankings (qid, id, rank) for relevant (qid, id), one row a query that has relevant ids."""
    rel = relevant.select("qid", "id").distinct()
    sizes = rel.groupBy("qid").agg(F.count("*").alias("n"))
    hits = first_occurrences(ranked).join(rel, ["qid", "id"], "left_semi")
    top = hits.filter(F.col("rank") <= k).withColumn("seen", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    got = top.groupBy("qid").agg(F.count("*").alias("hit"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"), F.avg(F.col("seen") / F.col("rank")).alias("ap"))
    first = hits.groupBy("qid").agg((F.lit(1.0) / F.min("rank")).alias("rr"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    j = sizes.join(got, "qid", "left").join(first, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    metric = {"recall": zero(F.col("hit") / F.col("n")), "precision": zero(F.col("hit") / F.lit(float(k))), "mrr": zero(F.col("rr")), "ndcg": zero(F.col("dcg") / ideal), "context_precision": zero(F.col("ap"))}
    return j.select("qid", *[F.round(c, 6).alias(name) for name, c in metric.items()])


def report(metrics: DataFrame) -> DataFrame:
    """One row: number of cases and means."""
    return metrics.agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in metrics.columns if c != "qid"])


def by_document(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """A ranking of chunks (qid, id, rank) as one of documents: each at its first chunk's place."""
    return first_occurrences(ranked.join(chunks.select(F.col("chunk_id").alias("id"), "doc_id"), "id").select("qid", F.col("doc_id").alias("id"), "rank"))


def answer_metrics(answers: DataFrame) -> DataFrame:
    """(qid, exact, f1, cover) of answers (qid, answer, gold)."""
    a = answers.select("qid", answer_words(F.col("answer")).alias("p"), answer_words(F.col("gold")).alias("g"))
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    both = F.aggregate(F.array_distinct("g"), F.lit(0), lambda s, t: s + F.least(count(F.col("p"), t), count(F.col("g"), t)))
    f1 = F.when((F.size("p") == 0) & (F.size("g") == 0), 1.0).when(both == 0, 0.0).otherwise(F.lit(2.0) * both / (F.size("p") + F.size("g")))
    return a.select("qid", (F.col("p") == F.col("g")).alias("exact"), F.round(f1, 6).alias("f1"), (F.size(F.array_except("g", "p")) == 0).alias("cover"))


def nearest_rank(values: DataFrame, points: tuple[int, ...] = (50, 95)) -> DataFrame:
    """One row (p50, p95, ...): the value at index n * p / 100, counted from 0, of column value sorted."""
    s = values.agg(F.sort_array(F.collect_list("value")).alias("v")).filter(F.size("v") > 0)
    return s.select(*[F.get("v", F.least(F.floor(F.size("v") * p / 100).cast("int"), F.size("v") - 1)).alias(f"p{p}") for p in points])


def bootstrap(values: DataFrame, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """(metric, mean, low, high): mean and 95 % interval of column value by metric, resampled with a fixed seed."""

    def run(group):
        v = np.sort(np.array(group.column("value").to_pylist(), np.float64))
        rng = np.random.default_rng(seed)
        means = np.sort(np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(rounds)]))
        return pa.table({"metric": [group.column("metric")[0].as_py()], "mean": [v.mean()], "low": [means[int(0.025 * rounds)]], "high": [means[min(rounds - 1, int(0.975 * rounds))]]})

    return values.filter("value is not null").groupBy("metric").applyInArrow(run, "metric string, mean double, low double, high double")


#: (arm, lexical weight; negative: none, graph mix, diversification)
ARMS = (
    ("dense", -1.0, 0.0, 0.0),
    ("hybrid-0.25", 0.25, 0.0, 0.0),
    ("hybrid-0.5", 0.5, 0.0, 0.0),
    ("hybrid-1", 1.0, 0.0, 0.0),
    ("hybrid-2", 2.0, 0.0, 0.0),
    ("hybrid-4", 4.0, 0.0, 0.0),
    ("hybrid-8", 8.0, 0.0, 0.0),
    ("lexical", 1e6, 0.0, 0.0),
    ("graph-0.2", 0.25, 0.2, 0.0),
    ("graph-0.5", 0.25, 0.5, 0.0),
    ("diverse-0.5", 0.25, 0.0, 0.5),
)


def ablation(seeded: DataFrame, relevant: DataFrame, k: int, arms=ARMS) -> DataFrame:
    """(arm, cases, recall, precision, mrr, ndcg, context_precision) of weightings of one set of seeds (qid, id, sim, bm).

    All arms are one plan: seeds times arms, ranked by arm and query.
    """
    from loomrank.operators.lexical import best

    spark = seeded.sparkSession
    weights = spark.createDataFrame([(a, float(max(w, 0.0))) for a, w, mix, div in arms if not mix and not div], "arm string, w double")
    q = Window.partitionBy("qid")
    share = lambda c: F.when(F.max(c).over(q) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.max(c).over(q)).otherwise(0.0)
    s = seeded.select("qid", "id", share("sim").alias("d"), share("bm").alias("l")).crossJoin(weights)
    s = s.select(F.struct("arm", "qid").alias("qid"), "id", F.round(F.col("d") + F.col("w") * F.col("l"), 6).alias("score")).filter("score > 0")
    both = relevant.crossJoin(weights.select("arm")).select(F.struct("arm", "qid").alias("qid"), "id")
    m = ranking_metrics(best(s, k, "id"), both, k)
    return m.groupBy(F.col("qid.arm").alias("arm")).agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in m.columns if c != "qid"])
