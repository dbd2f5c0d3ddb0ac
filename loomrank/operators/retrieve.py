"""Hybrid retrieval: seeds, fusion with explained components, filters, gates, reranking, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions.text import depends_on_history
from loomrank.operators.lexical import best, bm25
from loomrank.operators.vector import search

LEXICAL_WEIGHT = 0.25


def seeds(corpus: DataFrame, queries: DataFrame, seed_k: int) -> DataFrame:
    """(qid, id, sim, bm): the seed_k best by cosine and by BM25 of corpus (id, text, vector) for queries (qid, query, qv)."""
    dense = search(corpus.select("id", "vector"), queries.select("qid", "qv"), seed_k).select("qid", "id", F.col("score").alias("sim"))
    sparse = bm25(corpus.select(F.col("id"), "text"), queries, seed_k, "id").select("qid", "id", F.col("score").alias("bm"))
    return dense.join(sparse, ["qid", "id"], "full")


def fused_mass(seeded: DataFrame, k: int = 60) -> DataFrame:
    """(qid, node, weight): reciprocal rank fusion of the two lists of ``seeds``, the mass that PageRank starts from."""
    q = Window.partitionBy("qid")
    part = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (F.row_number().over(q.orderBy(F.desc_nulls_last(c), "id")) + F.lit(k))).otherwise(0.0)
    return seeded.select("qid", F.col("id").alias("node"), (part("sim") + part("bm")).alias("weight"))


def components(seeded: DataFrame, weight: float | None = None, ppr: DataFrame | None = None, mix: float = 0.0, entity: DataFrame | None = None, entity_mix: float = 0.0) -> DataFrame:
    """(qid, id, similarity, dense, lexical, graph, entity, score); the score is the sum of the four, candidates above 0.

    Dense and lexical parts are over each query's highest; with ppr (qid, id, mass) the whole graph takes part, its
    part being mix times mass over the highest.  With entity (qid, id, score) all is blended as (1 - m) value + m entity.
    """
    weight = LEXICAL_WEIGHT if not weight else max(weight, 0.0)
    q = Window.partitionBy("qid")
    rows = seeded
    if ppr is not None and mix:
        rows = rows.join(ppr.select("qid", "id", "mass"), ["qid", "id"], "full")
    else:
        rows = rows.withColumn("mass", F.lit(0.0))
    if entity is not None and entity_mix:
        rows = rows.join(entity.select("qid", "id", F.col("score").alias("es")), ["qid", "id"], "full" if ppr is not None and mix else "left")
    else:
        rows, entity_mix = rows.withColumn("es", F.lit(0.0)), 0.0

    def share(c: str) -> Column:
        top = F.max(c).over(q)
        return F.when(top > 0, F.coalesce(F.col(c), F.lit(0.0)) / top).otherwise(F.lit(0.0))

    keep = F.lit(1.0 - entity_mix)
    rows = rows.select(
        "qid", "id", F.coalesce("sim", F.lit(0.0)).alias("similarity"), (keep * share("sim")).alias("dense"), (keep * F.lit(weight) * share("bm")).alias("lexical"),
        (keep * F.lit(mix) * share("mass")).alias("graph"), (F.lit(entity_mix) * F.coalesce("es", F.lit(0.0))).alias("entity"),
    )
    score = F.col("dense") + F.col("lexical") + F.col("graph") + F.col("entity")
    rows = rows.withColumn("score", F.round(score, 6)).filter("score > 0")
    return rows.select("qid", "id", "similarity", *[F.round(c, 6).alias(c) for c in ("dense", "lexical", "graph", "entity")], "score")


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = 8, seed_k: int | None = None, before: Column | None = None, after: Column | None = None, **kw) -> DataFrame:
    """The k best of ``components`` with their rank.  ``before`` filters the corpus, ``after`` the seeds."""
    corpus = corpus.filter(before) if before is not None else corpus
    rows = components(seeds(corpus, queries, seed_k or 3 * k), **kw)
    if after is not None:
        rows = rows.join(corpus.filter(after).select("id"), "id", "left_semi")
    return best(rows, k, "id")


def abstentions(ranked: DataFrame, queries: DataFrame, floor: float) -> DataFrame:
    """(qid, abstain): nothing found, or the first hit's cosine under the floor (a floor of 0 or less never abstains)."""
    top = ranked.filter("rank = 1").select("qid", "similarity")
    j = queries.select("qid").join(top, "qid", "left")
    return j.select("qid", (F.col("similarity").isNull() | ((F.lit(floor) > 0) & (F.col("similarity") < F.lit(floor)))).alias("abstain"))


def subqueries(outputs: DataFrame, most: int = 5) -> DataFrame:
    """(qid, n, sub) of a model's lines (qid, query, output): bullets stripped, overlong and repeated ones dropped, at most five; the query itself if none is left."""
    line = outputs.select("qid", "query", F.posexplode(F.split("output", "\n")).alias("at", "line"))
    line = line.withColumn("sub", F.trim(F.regexp_replace(F.trim("line"), r"^[-*0-9. )]+", "")))
    line = line.filter((F.col("sub") != "") & (F.octet_length("sub") <= 4 * F.octet_length("query") + 120))
    first = line.withColumn("k", F.row_number().over(Window.partitionBy("qid", F.lower("sub")).orderBy("at"))).filter("k = 1")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
    kept = first.withColumn("n", n).filter(F.col("n") <= most).select("qid", "n", "sub")
    rest = outputs.join(kept.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(1).alias("n"), F.col("query").alias("sub"))
    return kept.unionByName(rest)


def best_of_subqueries(ranked: DataFrame) -> DataFrame:
    """(qid, id, score): of rankings (qid, n, id, score) by subquery the best score a document."""
    return ranked.groupBy("qid", "id").agg(F.max("score").alias("score"))


def reply_scores(replies: DataFrame) -> DataFrame:
    """(qid, i, model): scores in a model's reply (qid, reply), a JSON array of {i, score} with anything around it."""
    array = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    rows = replies.select("qid", F.posexplode(F.from_json(array, "array<struct<i:int,score:double>>")).alias("at", "x"))
    last = F.row_number().over(Window.partitionBy("qid", "x.i").orderBy(F.desc("at")))
    return rows.filter("x.i >= 0").withColumn("k", last).filter("k = 1").select("qid", F.col("x.i").alias("i"), F.coalesce("x.score", F.lit(0.0)).alias("model"))


def reranked(ranked: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): retrieval and model scores, each over its highest, blended by place.

    The model weighs 0.35 at the head of the pool and 0.65 at its tail.  Without usable scores the ranking stays.
    """
    q = Window.partitionBy("qid")
    j = ranked.select("qid", "id", "score", "rank", (F.col("rank") - 1).alias("i")).join(scores, ["qid", "i"], "left")
    j = j.withColumns({"n": F.count("*").over(q), "mm": F.max("model").over(q), "bm": F.max("score").over(q)})
    w = F.lit(0.35) + F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(0.0) * F.lit(0.30)
    m = F.when(F.col("mm") > 0, F.coalesce("model", F.lit(0.0)) / F.col("mm")).otherwise(0.0)
    b = F.when(F.col("bm") > 0, F.col("score") / F.col("bm")).otherwise(0.0)
    j = j.withColumn("new", F.when(F.col("mm").isNull(), F.col("score")).otherwise(F.round(w * m + (F.lit(1.0) - w) * b, 6)))
    order = Window.partitionBy("qid").orderBy(F.desc("new"), "rank")
    return j.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("qid", "id", F.col("new").alias("score"), F.col("place").alias("rank"))


def last_questions(turns: DataFrame) -> DataFrame:
    """(conv_id, query, history): the last user message of each conversation and how many turns went before it; and whether it leans on them."""
    asked = turns.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"), F.max("turn").alias("at"))
    before = turns.join(asked, "conv_id").filter("turn < at").groupBy("conv_id").agg(F.count("*").alias("history"))
    j = asked.join(before, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit(0)))
    return j.select("conv_id", "query", "history", ((F.col("history") > 0) & depends_on_history(F.col("query"))).alias("rewrite"))


def rewritten(query: Column, output: Column) -> Column:
    """A model's rewrite of a query: its first line without quotes, unless empty or overlong."""
    line = F.regexp_replace(F.trim(F.element_at(F.split(F.trim(output), "\n"), 1)), '^"+|"+$', "")
    return F.when((line == "") | (F.octet_length(line) > 4 * F.octet_length(query) + 120), query).otherwise(line)


def prompts(passages: DataFrame, queries: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(qid, prompt): numbered passages (qid, rank, text, meta), facts (qid, rank, line), the question."""
    meta = F.when(F.coalesce("meta", F.lit("")) != "", F.concat(F.lit("("), F.col("meta"), F.lit(") "))).otherwise(F.lit(""))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), meta, F.col("text"), F.lit("\n"))
    body = passages.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "").alias("body"))
    out = queries.select("qid", "query").join(body, "qid", "left")
    known = F.lit("")
    if facts is not None:
        said = facts.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda s: F.concat(F.lit("- "), s["line"], F.lit("\n"))), "").alias("facts"))
        out = out.join(said, "qid", "left")
        known = F.coalesce(F.concat(F.lit("\nKnowledge graph facts:\n"), F.col("facts")), F.lit(""))
    return out.select("qid", F.concat(F.lit("Context:\n"), F.coalesce("body", F.lit("")), known, F.lit("\nQuestion: "), F.col("query"), F.lit("\nAnswer:")).alias("prompt"))


def verdicts(claims: DataFrame, replies: DataFrame) -> DataFrame:
    """(qid, n, verdict) of claims (qid, n): from lines ``n: supported|partial|unsupported`` of a reply (qid, reply), else partial."""
    found = replies.select("qid", F.explode(F.split("reply", "\n")).alias("line"))
    found = found.select("qid", F.regexp_extract("line", r"(\d+)", 1).alias("n"), F.regexp_extract(F.lower("line"), r"(unsupported|supported|partial)", 1).alias("verdict"))
    found = found.filter("n <> '' and verdict <> ''").select("qid", F.col("n").cast("int").alias("n"), "verdict").dropDuplicates(["qid", "n"])
    return claims.join(found, ["qid", "n"], "left").select("qid", "n", F.coalesce("verdict", F.lit("partial")).alias("verdict"))
