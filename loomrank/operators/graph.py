"""Graphs as edge tables: assembly, degrees, personalised PageRank, label propagation, modularity, views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.sources.shared import written

CUT_EVERY = 5


def undirected(edges: DataFrame) -> DataFrame:
    """(a < b, w): one edge a pair, its greatest weight; loops and weights of 0 or less are dropped."""
    pair = edges.filter("src <> dst and w > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
    return pair.groupBy("a", "b").agg(F.max("w").alias("w"))


def mirrored(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions of edges (a, b, w)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))


def sequential(chunks: DataFrame, weight: float = 0.6) -> DataFrame:
    """(src, dst, w) between neighbouring chunks (doc_id, pos, chunk_id) of a document."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = chunks.select(F.lag("chunk_id").over(order).alias("src"), F.col("chunk_id").alias("dst"), F.lit(weight).alias("w"))
    return rows.filter("src is not null")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, weight) of every node."""
    d = mirrored(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum("w"), 6).alias("weight"))
    return nodes.join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(qid, node, mass): personalised PageRank for a batch of seed sets (qid, node, weight).

    r' = (1 - d) s + d (W r + dangling mass on s).  A fixed number of rounds if tolerance is None, else until the L1
    change of every query is below it.  Each round is a join and an aggregation of (qid, node); its result is written
    every few rounds, so the plan stays short and lost executors cost no more than that.
    """
    total = Window.partitionBy("qid")
    s = seeds.filter("weight > 0").join(nodes, "node", "left_semi").select("qid", "node", (F.col("weight") / F.sum("weight").over(total)).alias("s"))
    s = written(s, "ppr-seeds")
    out = mirrored(edges)
    share = written(out.join(out.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p")), "ppr-edges")
    has_out = share.select(F.col("src").alias("node")).distinct()
    r = s.select("qid", "node", F.col("s").alias("mass"))
    for k in range(1, rounds + 1):
        flow = r.join(share, r.node == share.src).groupBy("qid", F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("p")).alias("x"))
        stuck = r.join(has_out, "node", "left_anti").groupBy("qid").agg(F.sum("mass").alias("stuck"))
        restart = s.join(stuck, "qid", "left").select("qid", "node", (F.lit(1 - damping) * F.col("s") + F.lit(damping) * F.col("s") * F.coalesce("stuck", F.lit(0.0))).alias("x"))
        new = restart.unionByName(flow.select("qid", "node", (F.lit(damping) * F.col("x")).alias("x"))).groupBy("qid", "node").agg(F.sum("x").alias("mass"))
        if k % CUT_EVERY == 0 or k == rounds:
            new = written(new, "ppr")
            if tolerance is not None:
                both = new.join(r.withColumnRenamed("mass", "old"), ["qid", "node"], "full").select("qid", F.abs(F.coalesce("mass", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("d"))
                if both.groupBy("qid").agg(F.sum("d").alias("d")).filter(F.col("d") >= tolerance).isEmpty():
                    return new
        r = new
    return r


def propagate_labels(edges: DataFrame, nodes: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): synchronous label propagation.  Ties go to the least label; a node keeps its own if that weighs as much."""
    label = nodes.select("node", F.col("node").alias("label"))
    both = written(mirrored(edges), "lpa-edges")
    pick = Window.partitionBy("src").orderBy(F.desc("w"), "label")
    for k in range(1, rounds + 1):
        heard = both.join(label, both.dst == label.node).groupBy("src", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        top = heard.withColumn("k", F.row_number().over(pick)).filter("k = 1").select(F.col("src").alias("node"), F.col("label").alias("new"))
        label = label.join(top, "node", "left").select("node", F.coalesce("new", "label").alias("label"))
        if k % CUT_EVERY == 0 or k == rounds:
            label = written(label, "lpa")
    return label


def detect_communities(edges: DataFrame, nodes: DataFrame, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(node, community): asynchronous label propagation in a seeded order, each update seen by the next node.

    It is sequential by definition, so one task holds the graph: for graphs that fit a worker.  ``propagate_labels`` is
    the form that scales.
    """
    kind = dict(nodes.dtypes)["node"]

    def run(key, left, right):
        names = left.column("node").combine_chunks()
        names = names.take(pc.sort_indices(names))
        place = lambda c: pc.index_in(right.column(c).combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int32)
        a, b, w = place("a"), place("b"), right.column("w").to_numpy().astype(np.float32)
        a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        rows = np.lexsort((w, b, a))
        near, w, ends = b[rows], w[rows], np.searchsorted(a[rows], np.arange(len(names) + 1)).tolist()
        label, order, state, mask = list(range(len(names))), list(range(len(names))), seed, (1 << 64) - 1
        for _ in range(rounds):
            for i in range(len(order) - 1, 0, -1):
                state = (state + 0x9E3779B97F4A7C15) & mask
                z = state
                z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
                z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
                j = (z ^ (z >> 31)) % (i + 1)
                order[i], order[j] = order[j], order[i]
            changed = False
            for v in order:
                if ends[v] < ends[v + 1]:
                    heard: dict[int, np.float32] = {}
                    for u, x in zip(near[ends[v] : ends[v + 1]].tolist(), w[ends[v] : ends[v + 1]]):
                        heard[label[u]] = heard[label[u]] + x if label[u] in heard else x
                    new = min(heard, key=lambda c: (-heard[c], c))
                    changed |= new != label[v]
                    label[v] = new
            if not changed:
                break
        first: dict[int, int] = {}
        community = [first.setdefault(c, len(first)) for c in label]
        return pa.table({"node": names, "community": pa.array(community, pa.int64())})

    return nodes.select("node", F.lit(0).alias("g")).groupBy("g").cogroup(edges.withColumn("g", F.lit(0)).groupBy("g")).applyInArrow(run, f"node {kind}, community bigint")


def compacted(labels: DataFrame) -> DataFrame:
    """(node, community): labels numbered from 0 by their least node."""
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    numbered = least.select("label", (F.row_number().over(Window.orderBy("least")) - 1).cast("bigint").alias("community"))
    return labels.join(numbered, "label").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (modularity) of communities (node, community) on edges (a, b, w); 0 without edges."""
    own = mirrored(edges).join(communities.withColumnRenamed("node", "src"), "src").join(communities.select(F.col("node").alias("dst"), F.col("community").alias("other")), "dst")
    per = own.groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    per = per.agg(F.sum("all").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("all") * F.col("all")).alias("squares"))
    return per.select(F.round(F.when(F.col("m2") > 0, F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).otherwise(F.lit(0.0)), 6).alias("modularity"))
