"""Queries: similarity graphs, PageRank, communities, entity graphs, and the steps around a model's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import entity, graph, retrieve, vector
from loomrank.plans.base import CORPUS, ITEMS, QUESTIONS, corpus, cos, items, query, questions, table, top
from loomrank.sources.shared import written

NEAR, FLOOR = 12, 0.25

EDGES_SQL = f"""{ITEMS}, sim AS (SELECT a.id AS src, b.id AS dst, round({cos('a.v', 'b.v')}, 6) AS sim FROM items a JOIN items b ON a.id <> b.id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS k FROM sim WHERE sim >= {FLOOR}) WHERE k <= {NEAR}),
edges AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(sim) AS w FROM knn GROUP BY ALL),
both_ AS (SELECT a AS src, b AS dst, w FROM edges UNION ALL SELECT b, a, w FROM edges)"""


def _knn(spark, d):
    return vector.neighbours(items(spark, d), NEAR, FLOOR)


def _assembled(spark, d):
    return graph.undirected(_knn(spark, d).withColumnRenamed("sim", "w"))


def _edges(spark, d):
    """The graph's edges, found once however often a plan reads them."""
    return written(_assembled(spark, d), "graph-edges")


def _nodes(spark, d):
    return items(spark, d).select(F.col("id").alias("node"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, sim FROM knn")
def knn_edges(spark, d):
    return _knn(spark, d)


@query(f"WITH {EDGES_SQL} SELECT * FROM edges")
def graph_edges(spark, d):
    return _assembled(spark, d)


@query(f"""WITH {EDGES_SQL}, g AS (SELECT src, count(*) AS degree, round(sum(w), 6) AS weight FROM both_ GROUP BY src)
SELECT id AS node, coalesce(degree, 0) AS degree, coalesce(weight, 0) AS weight FROM items LEFT JOIN g ON src = id""")
def graph_degree(spark, d):
    return graph.degrees(_edges(spark, d), _nodes(spark, d))


@query("""SELECT conv_id || '#' || lag(turn) OVER w AS src, conv_id || '#' || turn AS dst, 0.6::DOUBLE AS w FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY lag(turn) OVER w IS NOT NULL""")
def seq_edges(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat_ws("#", "conv_id", "turn").alias("chunk_id"))
    return graph.sequential(c)


ROUNDS = 5


def _ppr_sql(rounds: int) -> str:
    """PageRank from the two first vectors, a fixed number of rounds."""
    steps = [f"{EDGES_SQL}, s AS (SELECT id AS node, 0.5::DOUBLE AS s FROM items WHERE id IN (0, 1)), share AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM both_), r0 AS (SELECT node, s AS mass FROM s)"]
    for k in range(rounds):
        steps.append(
            f"""r{k + 1} AS (SELECT node, sum(x) AS mass FROM (
  SELECT s.node, 0.15::DOUBLE * s + 0.85::DOUBLE * s * coalesce((SELECT sum(mass) FROM r{k} WHERE node NOT IN (SELECT src FROM share)), 0) AS x FROM s
  UNION ALL SELECT dst, 0.85::DOUBLE * sum(mass * p) FROM r{k} JOIN share ON src = node GROUP BY dst) GROUP BY node)"""
        )
    return "WITH " + ",\n".join(steps)


def _ppr(spark, d):
    seeds = _nodes(spark, d).filter("node in (0, 1)").select(F.lit(0).alias("qid"), "node", F.lit(1.0).alias("weight"))
    return graph.pagerank(_edges(spark, d), _nodes(spark, d), seeds, rounds=ROUNDS, tolerance=None)


@query(_ppr_sql(ROUNDS) + f" SELECT node, round(mass, 7) AS mass FROM r{ROUNDS}")
def ppr_fixed(spark, d):
    return _ppr(spark, d).select("node", F.round("mass", 7).alias("mass"))


@query()
def ppr_converged(spark, d):
    seeds = _nodes(spark, d).filter("node in (0, 1)").select(F.lit(0).alias("qid"), "node", F.lit(1.0).alias("weight"))
    return graph.pagerank(_edges(spark, d), _nodes(spark, d), seeds, tolerance=1e-3)


@query()
def graph_boost(spark, d):
    """Hybrid retrieval with the graph's part: PageRank seeded by the rank fusion of each query's seeds."""
    c, q = corpus(spark, d), questions(spark, d)
    seeded = retrieve.seeds(c, q, 24)
    mass = graph.pagerank(_edges(spark, d), _nodes(spark, d), retrieve.fused_mass(seeded), rounds=ROUNDS, tolerance=None).withColumnRenamed("node", "id")
    return retrieve.best(retrieve.components(seeded, ppr=mass, mix=0.2), 8, "id")


def _lpa_sql(rounds: int) -> str:
    steps = [f"{EDGES_SQL}, l0 AS (SELECT id AS node, id AS label FROM items)"]
    for k in range(rounds):
        steps.append(
            f"""h{k} AS (SELECT src, label, round(sum(w), 6) AS w FROM both_ JOIN l{k} ON node = dst GROUP BY ALL),
l{k + 1} AS (SELECT l.node, coalesce(t.label, l.label) AS label FROM l{k} l LEFT JOIN (SELECT src, label FROM h{k} QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, label) = 1) t ON t.src = l.node)"""
        )
    return "WITH " + ",\n".join(steps)


def _lpa(spark, d, edges=None):
    return graph.propagate_labels(_edges(spark, d) if edges is None else edges, _nodes(spark, d), rounds=ROUNDS)


@query(_lpa_sql(ROUNDS) + f" SELECT node, label FROM l{ROUNDS}")
def lpa_sync(spark, d):
    return _lpa(spark, d)


COMMUNITIES_SQL = _lpa_sql(ROUNDS) + f", c AS (SELECT node, dense_rank() OVER (ORDER BY least_) - 1 AS community FROM (SELECT node, min(node) OVER (PARTITION BY label) AS least_ FROM l{ROUNDS}))"


@query(COMMUNITIES_SQL + " SELECT node, community FROM c")
def communities(spark, d):
    return graph.compacted(_lpa(spark, d))


@query(COMMUNITIES_SQL + " SELECT community, count(*) AS size, list(node ORDER BY node) AS members FROM c GROUP BY community")
def community_members(spark, d):
    return communities(spark, d).groupBy("community").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("members"))


@query(COMMUNITIES_SQL + """, e AS (SELECT x.community AS cs, y.community AS cd, w FROM both_ JOIN c x ON x.node = src JOIN c y ON y.node = dst),
p AS (SELECT cs, sum(CASE WHEN cs = cd THEN w ELSE 0 END) AS inside, sum(w) AS all_ FROM e GROUP BY cs)
SELECT round(CASE WHEN sum(all_) > 0 THEN sum(inside) / sum(all_) - sum(all_ * all_) / (sum(all_) * sum(all_)) ELSE 0 END, 6) AS modularity FROM p""")
def modularity(spark, d):
    edges = _edges(spark, d)
    return graph.modularity(edges, graph.compacted(_lpa(spark, d, edges)))


@query()
def lpa_exact(spark, d):
    return graph.detect_communities(_edges(spark, d), _nodes(spark, d))


# Entities: a part's type and brand are names, a link between them ------------------------------------------------------

LINES_SQL = """lines AS (SELECT p_partkey AS chunk_id, lower(p_type) AS a, lower(p_brand) AS b FROM part)"""


def _outputs(spark, d):
    """Extractions as a model would write them, of the parts' types, with lines that aren't any."""
    said = F.concat(
        F.lit("Here is what I found\n- entity|"), "p_type", F.lit("|type|a type\nentity|"), "p_brand", F.lit("|brand|\n`relation|"), "p_type", F.lit("|"), "p_brand",
        F.lit("|made of`\nrelation|it|"), "p_brand", F.lit("|\nentity||x|\n"),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), said.alias("output"))


def _graph(spark, d):
    return entity.merged(entity.cleaned(entity.parsed(_outputs(spark, d))))


@query("""SELECT p_partkey AS chunk_id, kind, a, b, description FROM part, LATERAL (VALUES
('entity', p_type, 'type', 'a type'), ('entity', p_brand, 'brand', ''),
('relation', p_type, p_brand, 'made of'), ('relation', 'it', p_brand, '')) t(kind, a, b, description)""")
def ent_parse(spark, d):
    return entity.parsed(_outputs(spark, d)).drop("ord")


@query(f"""WITH {LINES_SQL}, m AS (SELECT a AS name, chunk_id, 'type' AS type FROM lines UNION ALL SELECT b, chunk_id, 'brand' FROM lines)
SELECT name, min(type) AS type, count(*) AS mentions, count(DISTINCT chunk_id) AS chunks FROM m GROUP BY name""")
def ent_merge(spark, d):
    e, _ = entity.merged_with_counts(entity.cleaned(entity.parsed(_outputs(spark, d))))
    return e.select("name", "type", "mentions", F.col("n_chunks").alias("chunks"))


@query(f"WITH {LINES_SQL} SELECT least(a, b) AS source, greatest(a, b) AS target, 'made of' AS description, count(*) AS weight FROM lines WHERE a <> b GROUP BY ALL")
def ent_relations(spark, d):
    return _graph(spark, d)[1]


@query(f"WITH {LINES_SQL}, n AS (SELECT a AS name FROM lines UNION SELECT b FROM lines) SELECT name FROM n WHERE name <> 'economy'")
def ent_prune(spark, d):
    """One name made a generic one, which leaves."""
    e, r = _graph(spark, d)
    odd = F.when(F.col("name") == "economy", F.lit("thing")).otherwise(F.col("name"))
    return entity.pruned(e.withColumn("name", odd), r)[0].select("name")


@query("""WITH gone AS (SELECT p_partkey AS chunk_id FROM part WHERE p_size <= 25), live AS (SELECT p_partkey, lower(p_type) AS a, lower(p_brand) AS b FROM part WHERE p_partkey NOT IN (SELECT chunk_id FROM gone))
SELECT name, count(DISTINCT p_partkey) AS chunks FROM (SELECT a AS name, p_partkey FROM live UNION ALL SELECT b, p_partkey FROM live) GROUP BY name""")
def ent_drop_chunks(spark, d):
    e, r = _graph(spark, d)
    gone = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("chunk_id"))
    return entity.without_chunks(e, r, gone)[0].select("name", F.size("chunks").cast("bigint").alias("chunks"))


@query("""WITH n AS (SELECT DISTINCT lower(c_name) AS x FROM (SELECT n_name AS c_name FROM nation UNION SELECT r_name FROM region UNION SELECT n_name || 's' FROM nation UNION SELECT 'great ' || n_name FROM nation)),
w AS (SELECT x, list_distinct(regexp_split_to_array(x, '\\s+')) AS w FROM n)
SELECT least(p.x, q.x) AS a, greatest(p.x, q.x) AS b FROM w p JOIN w q ON p.x <> q.x
WHERE 1.0::DOUBLE - levenshtein(p.x, q.x) / greatest(strlen(p.x), strlen(q.x)) >= 0.9::DOUBLE
  OR (strlen(p.x) <= strlen(q.x) AND len(q.w) >= 2 AND len(p.w) < len(q.w) AND len(list_filter(p.w, lambda t: strlen(t) >= 4 AND list_contains(q.w, t))) = len(p.w)) GROUP BY ALL""")
def edit_pairs(spark, d):
    return entity.alike_pairs(_names(spark, d))


def _names(spark, d):
    n, r = table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name")
    every = n.union(r).union(n.select(F.concat("n_name", F.lit("s")))).union(n.select(F.concat(F.lit("great "), "n_name")))
    return every.toDF("name").select(F.lower("name").alias("name")).distinct()


@query()
def canonicalize(spark, d):
    return entity.canonical_names(_names(spark, d).withColumn("mentions", F.lit(1)))


@query(f"""WITH {LINES_SQL}, hit AS (SELECT p_partkey AS chunk_id FROM part WHERE p_size = 1), f AS (SELECT DISTINCT a, b FROM lines WHERE a <> b),
n AS (SELECT a AS name FROM lines SEMI JOIN hit USING (chunk_id) UNION SELECT b FROM lines SEMI JOIN hit USING (chunk_id)),
r AS (SELECT least(a, b) AS source, greatest(a, b) AS target, count(*) AS weight FROM lines WHERE a <> b GROUP BY ALL)
SELECT count(*) AS relations FROM r WHERE source IN (SELECT name FROM n) OR target IN (SELECT name FROM n)""")
def rel_context(spark, d):
    e, r = _graph(spark, d)
    hits = table(spark, d, "part").filter("p_size = 1").select(F.lit(0).alias("qid"), F.col("p_partkey").alias("chunk_id"))
    return entity.relation_context(hits, e, r, most=1000).agg(F.count("*").alias("relations"))


@query(f"""WITH {ITEMS}, {QUESTIONS}, s AS (SELECT qid, 'n' || id AS name, round({cos('v', 'qv')}, 6) AS sim FROM items, qs),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, name) AS k FROM s WHERE sim >= 0.3) WHERE k <= 24) SELECT qid, name, sim AS weight FROM t""")
def node_seeds(spark, d):
    e = items(spark, d).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), "vector")
    q = questions(spark, d).withColumn("query", F.lit("-"))
    return entity.node_seeds(e, q)


@query()
def fact_seeds(spark, d):
    e = items(spark, d).select(F.col("id").cast("string").alias("name"), F.array(F.col("id")).alias("chunks"))
    facts = items(spark, d).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"), "vector")
    return entity.fact_seeds(facts, e, questions(spark, d))


@query(_ppr_sql(ROUNDS) + f""", x AS (SELECT id // 10 AS chunk_id, sum(mass) AS s FROM r{ROUNDS} JOIN items ON id = node GROUP BY 1)
SELECT chunk_id, round(s / max(s) OVER (), 6) AS score FROM x""")
def ent_chunk_scores(spark, d):
    e = items(spark, d).select(F.col("id").alias("name"), F.array(F.floor(F.col("id") / 10)).alias("chunks"))
    return entity.chunk_scores(_ppr(spark, d), e).select("chunk_id", "score")


# Around a model -------------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT conv_id, max_by(text, turn) AS query, max(turn) AS at FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT u.conv_id, u.query, (SELECT count(*) FROM conversations c WHERE c.conv_id = u.conv_id AND c.turn < u.at) AS history FROM u""")
def last_user_turn(spark, d):
    return retrieve.last_questions(table(spark, d, "conversations")).select("conv_id", "query", "history")


@query()
def rewrite_gate(spark, d):
    return retrieve.last_questions(table(spark, d, "conversations")).select("conv_id", "rewrite")


@query(f"""WITH {CORPUS}, {QUESTIONS}, s AS (SELECT qid, id, round({cos('v', 'qv')}, 6) AS score FROM corpus, qs), t AS ({top('s', 20)}),
m AS (SELECT qid, id, score, rank, (id * 7) % 11 / 10.0::DOUBLE AS model, count(*) OVER (PARTITION BY qid) AS n, max(score) OVER (PARTITION BY qid) AS best FROM t),
x AS (SELECT *, max(model) OVER (PARTITION BY qid) AS mm, 0.35::DOUBLE + CASE WHEN n > 1 THEN (rank - 1) / (n - 1) ELSE 0 END * 0.3::DOUBLE AS w FROM m),
y AS (SELECT qid, id, rank AS old, round(w * (CASE WHEN mm > 0 THEN model / mm ELSE 0 END) + (1.0::DOUBLE - w) * (CASE WHEN best > 0 THEN score / best ELSE 0 END), 6) AS score FROM x)
SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old) AS rank FROM y) WHERE rank <= 5""")
def rerank_blend(spark, d):
    c = corpus(spark, d)
    ranked = vector.search(c.select("id", "vector"), questions(spark, d), 20)
    scores = ranked.select("qid", (F.col("rank") - 1).alias("i"), (F.col("id") * 7 % 11 / F.lit(10.0)).alias("model"))
    return retrieve.reranked(ranked, scores, 5)


@query("SELECT qid, i, model FROM (VALUES (1, 0, 0.5::DOUBLE), (1, 2, 0.25::DOUBLE), (2, 1, 1.0::DOUBLE)) t(qid, i, model)")
def rerank_replies(spark, d):
    rows = [(1, 'Sure: [{"i":0,"score":0.9},{"i":2,"score":0.25},{"i":0,"score":0.5}] done'), (2, '[{"i":1,"score":1}]'), (3, "no idea")]
    return retrieve.reply_scores(spark.createDataFrame(rows, "qid int, reply string"))


@query("SELECT qid, n, sub FROM (VALUES (1, 1, 'who made it'), (1, 2, 'when was it made'), (2, 1, 'a plain question')) t(qid, n, sub)")
def decompose(spark, d):
    rows = [(1, "who made it and when", "1. who made it\n- when was it made\n* Who made it\n"), (2, "a plain question", " \n")]
    return retrieve.subqueries(spark.createDataFrame(rows, "qid int, query string, output string"))


@query("SELECT qid, n, verdict FROM (VALUES (1, 1, 'supported'), (1, 2, 'unsupported'), (1, 3, 'partial')) t(qid, n, verdict)")
def verify_parse(spark, d):
    claims = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "qid int, n int")
    return retrieve.verdicts(claims, spark.createDataFrame([(1, "1: Supported\n2) it is UNSUPPORTED\nthanks")], "qid int, reply string"))


@query(f"""WITH {CORPUS}, {QUESTIONS}, s AS (SELECT qid, id, round({cos('v', 'qv')}, 6) AS score FROM corpus, qs), t AS ({top('s', 3)}),
b AS (SELECT qid, string_agg('[' || rank || '] ' || corpus.text || chr(10), '' ORDER BY rank) AS body FROM t JOIN corpus USING (id) GROUP BY qid)
SELECT qid, md5('Context:' || chr(10) || body || chr(10) || 'Question: ' || query || chr(10) || 'Answer:') AS prompt FROM b JOIN qs USING (qid)""")
def prompt_build(spark, d):
    c, q = corpus(spark, d), questions(spark, d)
    hits = vector.search(c.select("id", "vector"), q, 3).join(c.select("id", "text"), "id").withColumn("meta", F.lit(""))
    return retrieve.prompts(hits, q).select("qid", F.md5("prompt").alias("prompt"))


@query()
def faithfulness_sentences(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.posexplode(T.answer_sentences(F.col("text"))).alias("n", "sentence"))
