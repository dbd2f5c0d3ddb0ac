"""Queries: lexical and vector search, hybrid retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import embed
from loomrank.functions import vectors as V
from loomrank.functions.text import word_tokens
from loomrank.operators import evaluate, lexical, quant, retrieve, vector
from loomrank.plans.base import CORPUS, ITEMS, QUESTIONS, bm25_sql, corpus, cos, dense, documents, items, query, questions, table, tok, top

K, SEED = 8, 24


@query(f"SELECT doc_id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS w FROM documents) GROUP BY ALL")
def tok_counts(spark, d):
    return lexical.postings(documents(spark, d))


@query(f"""WITH p AS (SELECT DISTINCT doc_id, unnest({tok('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1.0::DOUBLE + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM p, n GROUP BY term, n""")
def df_idf(spark, d):
    docs = documents(spark, d)
    return lexical.document_frequency(lexical.postings(docs), lexical.corpus_size(lexical.lengths(docs)))


@query(f"SELECT count(*) AS n, round(avg(len({tok('text')})), 6) AS avgdl FROM documents")
def corpus_lengths(spark, d):
    return lexical.corpus_size(lexical.lengths(documents(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {QUESTIONS}, {bm25_sql(10, 'documents', key='doc_id')} SELECT qid, id AS doc_id, score, rank FROM sparse")
def bm25_topk(spark, d):
    return lexical.bm25(documents(spark, d), questions(spark, d), 10)


@query(f"WITH {ITEMS}, {QUESTIONS}, {dense(10, 'items')} SELECT qid, id, score, rank FROM dense")
def cosine_topk(spark, d):
    return vector.search(items(spark, d), questions(spark, d), 10)


@query(f"""WITH {ITEMS}, {QUESTIONS}, s AS (SELECT qid, id, round(list_inner_product(v, qv), 6) AS score FROM items, qs), t AS ({top('s', 10)})
SELECT qid, id, score, rank FROM t""")
def ip_topk(spark, d):
    return vector.search(items(spark, d), questions(spark, d), 10, "ip")


@query(f"""WITH {ITEMS}, {QUESTIONS}, s AS (SELECT qid, id, round(-pow(list_distance(v, qv), 2), 6) AS score FROM items, qs), t AS ({top('s', 10)})
SELECT qid, id, score, rank FROM t""")
def l2_topk(spark, d):
    return vector.search(items(spark, d), questions(spark, d), 10, "l2")


@query(f"""WITH {ITEMS}, {QUESTIONS}, short AS (SELECT id, v[1:32] AS v FROM items), q AS (SELECT qid, qv[1:32] AS qv FROM qs), {dense(10, 'short', qs='q')}
SELECT qid, id, score, rank FROM dense""")
def matryoshka_topk(spark, d):
    cut = lambda df, c: df.withColumn(c, V.truncated(F.col(c), 32))
    return vector.search(cut(items(spark, d), "vector"), cut(questions(spark, d), "qv"), 10)


@query(f"""WITH {ITEMS}, {QUESTIONS}, short AS (SELECT id, v[1:32] AS v FROM items), q AS (SELECT qid, qv[1:32] AS qv FROM qs), {dense(40, 'short', 'first', 'q')},
s AS (SELECT qid, id, round({cos('v', 'qv')}, 6) AS score FROM first JOIN items USING (id) JOIN qs USING (qid)), t AS ({top('s', 10)}) SELECT qid, id, score, rank FROM t""")
def overscan_topk(spark, d):
    return vector.overscan(items(spark, d), questions(spark, d), 10, 32)


@query(f"""WITH {ITEMS}, {QUESTIONS}, {dense(5, 'items', 'near')},
x AS (SELECT qid, i, avg(x) AS x FROM (SELECT qid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near JOIN items USING (id)) GROUP BY ALL),
m AS (SELECT qid, list(qv[i] + 0.5::DOUBLE * x ORDER BY i) AS qv FROM x JOIN qs USING (qid) GROUP BY qid), {dense(10, 'items', qs='m')}
SELECT qid, id, score, rank FROM dense""")
def prf_topk(spark, d):
    it = items(spark, d)
    return vector.search(it, vector.feedback(it, questions(spark, d)), 10)


@query(f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')) AS t FROM documents),
h AS (SELECT doc_id, CAST('0x' || md5(t)[1:8] AS BIGINT) AS h FROM w),
x AS (SELECT doc_id, h % 64 AS d, sum(CASE WHEN h >= 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS x FROM h GROUP BY ALL HAVING x <> 0),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM x GROUP BY doc_id)
SELECT doc_id, d, round(x / n, 6) AS x FROM x JOIN n USING (doc_id)""")
def hash_embed(spark, d):
    e = embed.hashed(documents(spark, d)).select("doc_id", F.posexplode("vector").alias("d", "x"))
    return e.filter("x <> 0").select("doc_id", F.col("d").cast("bigint").alias("d"), F.round("x", 6).alias("x"))


@query(f"""WITH {CORPUS}, {QUESTIONS}, {dense(SEED)}, {bm25_sql(SEED, 'corpus')},
u AS (SELECT qid, id, rank - 1 AS r FROM dense UNION ALL SELECT qid, id, rank - 1 FROM sparse)
SELECT qid, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM u GROUP BY qid, id""")
def rrf_fuse(spark, d):
    c, q = corpus(spark, d), questions(spark, d)
    return lexical.reciprocal_rank_fusion([vector.search(c.select("id", "vector"), q, SEED), lexical.bm25(c, q, SEED, "id")], id_col="id")


def hybrid_sql(weight: float = 0.25, source: str = "corpus", seed: int = SEED) -> str:
    """CTE seeds and parts of hybrid retrieval."""
    return f"""{dense(seed, source)}, {bm25_sql(seed, source)},
seeds AS (SELECT qid, id, a.score AS sim, b.score AS bm FROM dense a FULL JOIN sparse b USING (qid, id)),
parts AS (SELECT qid, id, coalesce(sim, 0) AS similarity,
  CASE WHEN max(sim) OVER w > 0 THEN coalesce(sim, 0) / max(sim) OVER w ELSE 0 END AS dense,
  CASE WHEN max(bm) OVER w > 0 THEN {weight}::DOUBLE * (coalesce(bm, 0) / max(bm) OVER w) ELSE 0 END AS lexical
  FROM seeds WINDOW w AS (PARTITION BY qid)),
scored AS (SELECT qid, id, similarity, dense, lexical, round(dense + lexical, 6) AS score FROM parts WHERE round(dense + lexical, 6) > 0)"""


@query(f"""WITH {CORPUS}, {QUESTIONS}, {hybrid_sql()}, t AS ({top('scored', K)})
SELECT qid, id, similarity, round(dense, 6) AS dense, round(lexical, 6) AS lexical, 0.0::DOUBLE AS graph, 0.0::DOUBLE AS entity, score, rank FROM t""")
def hybrid_components(spark, d):
    return retrieve.retrieve(corpus(spark, d), questions(spark, d), K)


@query(f"""WITH {CORPUS}, {QUESTIONS}, {hybrid_sql()}, f AS (SELECT scored.* FROM scored JOIN documents ON doc_id = id WHERE lang = 'en'), t AS ({top('f', K)})
SELECT qid, id, score, rank FROM t""")
def hybrid_filter_post(spark, d):
    c = corpus(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return retrieve.retrieve(c, questions(spark, d), K, after=F.col("lang") == "en").select("qid", "id", "score", "rank")


@query(f"""WITH corpus AS (SELECT doc_id AS id, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'en'),
{QUESTIONS}, {hybrid_sql()}, t AS ({top('scored', K)}) SELECT qid, id, score, rank FROM t""")
def hybrid_filter_pre(spark, d):
    c = corpus(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return retrieve.retrieve(c, questions(spark, d), K, before=F.col("lang") == "en").select("qid", "id", "score", "rank")


@query(f"""WITH {CORPUS}, {QUESTIONS}, {hybrid_sql()}, t AS ({top('scored', K)})
SELECT qs.qid, coalesce(similarity < 0.9, true) AS abstain FROM qs LEFT JOIN t ON t.qid = qs.qid AND rank = 1""")
def abstain(spark, d):
    q = questions(spark, d)
    return retrieve.abstentions(retrieve.retrieve(corpus(spark, d), q, K), q, 0.9)


def _relevant(spark, d):
    """Relevant to an item: the vectors with its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = questions(spark, d).select("qid").join(e.toDF("qid", "label"), "qid")
    return q.join(e, "label").select("qid", F.col("vec_id").alias("id"))


REL = "rel AS (SELECT qid, e.vec_id AS id FROM qs JOIN embeddings q ON q.vec_id = qid JOIN embeddings e ON e.label = q.label)"
METRICS = """n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
h AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS seen FROM t JOIN rel USING (qid, id)),
g AS (SELECT qid, count(*) AS hit, sum(1.0::DOUBLE / log2(rank + 1.0::DOUBLE)) AS dcg, avg(seen / rank) AS ap, 1.0::DOUBLE / min(rank) AS rr FROM h GROUP BY qid),
m AS (SELECT qid, round(coalesce(hit / n, 0), 6) AS recall, round(coalesce(hit / 10.0::DOUBLE, 0), 6) AS precision, round(coalesce(rr, 0), 6) AS mrr,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 0), 6) AS ndcg,
  round(coalesce(ap, 0), 6) AS context_precision FROM n LEFT JOIN g USING (qid))"""


@query(f"WITH {CORPUS}, {QUESTIONS}, {hybrid_sql()}, t AS ({top('scored', 10)}), {REL}, {METRICS} SELECT * FROM m")
def ranking_metrics(spark, d):
    return evaluate.ranking_metrics(retrieve.retrieve(corpus(spark, d), questions(spark, d), 10, SEED), _relevant(spark, d), 10)


@query(f"""WITH {CORPUS}, {QUESTIONS}, {hybrid_sql()}, t AS ({top('scored', 10)}), {REL}, {METRICS}
SELECT count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
round(avg(context_precision), 6) AS context_precision FROM m""")
def evaluation_report(spark, d):
    return evaluate.report(ranking_metrics(spark, d))


def _ablation_sql() -> str:
    arms = [(a, max(w, 0.0)) for a, w, mix, div in evaluate.ARMS if not mix and not div]
    values = ", ".join(f"('{a}', {w}::DOUBLE)" for a, w in arms)
    return f"""WITH {CORPUS}, {QUESTIONS}, {hybrid_sql()}, arms(arm, w) AS (VALUES {values}),
s AS (SELECT qid, id, CASE WHEN max(sim) OVER q > 0 THEN coalesce(sim, 0) / max(sim) OVER q ELSE 0 END AS d,
  CASE WHEN max(bm) OVER q > 0 THEN coalesce(bm, 0) / max(bm) OVER q ELSE 0 END AS l FROM seeds WINDOW q AS (PARTITION BY qid)),
a AS (SELECT arm, qid AS item, arm || '/' || qid AS qid, id, round(d + w * l, 6) AS score FROM s, arms WHERE round(d + w * l, 6) > 0), t AS ({top('a', 10)}),
rel AS (SELECT arm || '/' || qid AS qid, e.vec_id AS id FROM arms, qs JOIN embeddings q ON q.vec_id = qid JOIN embeddings e ON e.label = q.label), {METRICS}
SELECT split_part(qid, '/', 1) AS arm, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr,
round(avg(ndcg), 6) AS ndcg, round(avg(context_precision), 6) AS context_precision FROM m GROUP BY 1"""


@query(_ablation_sql())
def ablation_arms(spark, d):
    return evaluate.ablation(retrieve.seeds(corpus(spark, d), questions(spark, d), SEED), _relevant(spark, d), 10)


@query()
def mmr_diversified(spark, d):
    c = corpus(spark, d)
    ranked = retrieve.retrieve(c, questions(spark, d), 4 * K, SEED * 2).select("qid", "id", "score").join(c.select("id", "vector"), "id")
    return vector.diversified(ranked, K)


@query()
def lists_search(spark, d):
    return vector.search_by_lists(items(spark, d), questions(spark, d), 10)


@query()
def quant_search(spark, d):
    it, codec = items(spark, d), quant.Codec(64)
    return quant.code_search(quant.encoded(it, codec), it, questions(spark, d), codec, 10)


@query("WITH b AS (SELECT unnest(range(1, 9)) AS bits) SELECT bits, (64 * bits + 7) // 8 + 16 AS bytes, round(256.0::DOUBLE / ((64 * bits + 7) // 8 + 16), 6) AS ratio FROM b")
def codec_sizes(spark, d):
    rows = [(b, quant.Codec(64, b).bytes_per_vector()) for b in range(1, 9)]
    return spark.createDataFrame(rows, "bits bigint, bytes bigint").withColumn("ratio", F.round(F.lit(256.0) / F.col("bytes"), 6))


@query()
def codec_quality(spark, d):
    return quant.codec_error(items(spark, d), quant.Codec(64))


@query()
def bootstrap_ci(spark, d):
    m = ranking_metrics(spark, d)
    return evaluate.bootstrap(m.select("qid", F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value")))


_ANSWER = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Nd}}]+'), lambda t: t NOT IN ('a', 'an', 'the'))"


@query(f"""WITH a AS (SELECT u.conv_id, u.turn, {_ANSWER.format('u.text')} AS p, {_ANSWER.format('v.text')} AS g FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1),
b AS (SELECT *, list_sum(list_transform(list_distinct(g), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))) AS both_ FROM a)
SELECT conv_id, turn, p = g AS exact, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN coalesce(both_, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * both_ / (len(p) + len(g)) END, 6) AS f1,
  len(list_filter(g, lambda t: NOT list_contains(p, t))) = 0 AS cover FROM b""")
def answer_metrics(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    a = c.join(nxt, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("answer"), "gold")
    return evaluate.answer_metrics(a).select("qid.conv_id", "qid.turn", "exact", "f1", "cover")


@query("WITH v AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL) SELECT v[len(v) * 50 // 100 + 1] AS p50, v[len(v) * 95 // 100 + 1] AS p95 FROM v")
def p50_p95(spark, d):
    return evaluate.nearest_rank(table(spark, d, "events").select("value").filter("value is not null"))


__all__ = ["word_tokens"]
