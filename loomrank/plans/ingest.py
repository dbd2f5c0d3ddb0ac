"""Queries: redaction, chunking, projections of text, corpus maintenance, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import redact as R
from loomrank.functions import text as T
from loomrank.operators import chunking, corpus
from loomrank.plans.base import documents, fields, query, table
from loomrank.sources import readers
from loomrank.sources.transform import Transforms

CHUNKS_SQL = f"""words AS (SELECT doc_id, {fields('text')} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 120) / 96.0::DOUBLE)) AS BIGINT) + 1)) AS pos FROM words WHERE len(w) > 0),
chunks AS (SELECT doc_id || '#' || pos AS chunk_id, doc_id, CAST(pos AS INT) AS pos, array_to_string(w[pos * 96 + 1:pos * 96 + 120], ' ') AS text FROM starts)"""


def word_chunks(spark, d):
    return chunking.word_chunks(documents(spark, d))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id, pos, md5(text) AS hash, length(text) AS n FROM chunks")
def chunk_word(spark, d):
    c = word_chunks(spark, d)
    return c.select("chunk_id", "doc_id", "pos", F.md5("text").alias("hash"), F.length("text").cast("bigint").alias("n"))


@query()
def chunk_recursive(spark, d):
    return chunking.chunks(documents(spark, d), "recursive")


@query()
def chunk_sentence(spark, d):
    return chunking.chunks(documents(spark, d), "sentence")


@query()
def chunk_markdown(spark, d):
    return chunking.chunks(documents(spark, d), "markdown")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS chunks, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM chunks GROUP BY doc_id")
def doc_listing(spark, d):
    return corpus.listing(word_chunks(spark, d))


@query(f"""WITH {CHUNKS_SQL}
SELECT chunk_id, md5(string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS passage FROM chunks""")
def context_window(spark, d):
    c = word_chunks(spark, d)
    got = chunking.windowed(c, c.select(F.lit(0).alias("qid"), "chunk_id"), 1)
    return got.select("chunk_id", F.md5("passage").alias("passage"))


# Text projections ---------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS lines FROM documents WHERE text IS NOT NULL""")
def line_slice(spark, d):
    return documents(spark, d).filter("text is not null").select("doc_id", F.md5(T.line_slice(F.col("text"), 2, 4)).alias("lines"))


@query(f"""WITH w AS (SELECT doc_id, text, {fields('text')} AS w FROM documents)
SELECT doc_id, array_to_string(w, ' ') AS line, CASE WHEN len(w) <= 12 THEN text ELSE array_to_string(w[1:12], ' ') || '...' END AS head FROM w""")
def text_heads(spark, d):
    text = F.col("text")
    return documents(spark, d).select("doc_id", T.one_line(text).alias("line"), T.first_words(text, 12).alias("head"))


@query()
def snippets(spark, d):
    return documents(spark, d).select("doc_id", T.snippet(F.col("text"), 160).alias("snippet"), T.byte_clip(F.col("text"), 500).alias("clip"))


@query("""SELECT event_id, concat_ws(', ', 'type: ' || event_type, 'user: ' || CAST(user_id AS VARCHAR)) AS meta FROM events""")
def metadata_select(spark, d):
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), "value")).alias("meta"))
    return e.select("event_id", T.metadata(F.col("meta"), ["type", "user", "missing"]).alias("meta"))


# Redaction ------------------------------------------------------------------------------------------------------------

#: texts that hold a secret each, put together from parts so that none stands in this file
_PLANTED = [
    ("AKIA", "A1B2C3D4E5F6G7H8", "aws-access-key-id"),
    ("ghp_", "a1B2" * 9, "github-token"),
    ("xoxb-", "1234567890-abcdef", "slack-token"),
    ("AIza", "Ab1_-" * 7, "google-api-key"),
    ("npm_", "q" * 18 + "7" * 18, "npm-token"),
    ("sk_live_", "0123456789abcdef", "stripe-key"),
]


def _planted_sql() -> str:
    rows = ", ".join(f"({k}, 'the key ' || '{a}' || '{b}' || ' end', 'the key [redacted:{kind}] end')" for k, (a, b, kind) in enumerate(_PLANTED))
    return f"SELECT k AS doc_id, want AS text FROM (VALUES {rows}) t(k, have, want)"


@query(_planted_sql())
def redact_rules(spark, d):
    """Rules without groups, as a chain of built-in replacements."""
    rows = [(k, f"the key {a}{b} end") for k, (a, b, _) in enumerate(_PLANTED)]
    return spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", R.redacted_whole(F.col("text")).alias("text"))


@query("SELECT doc_id, n AS secrets, summary FROM (VALUES (1, 1, '1 secret redacted (assigned-secret)'), (2, 2, '2 secrets redacted (aws-access-key-id, slack-token)'), (3, 0, '')) t(doc_id, n, summary)")
def redact_summary(spark, d):
    """Findings counted and told in a line; a placeholder is no secret."""
    a, b = "".join(_PLANTED[0][:2]), "".join(_PLANTED[2][:2])
    rows = [(1, "passw" + "ord = 'q8Zk2LmN'"), (2, f"{a} and {b}"), (3, "passw" + "ord = changeme-now")]
    r = R.redacted(spark.createDataFrame(rows, "doc_id int, text string"))
    return r.select("doc_id", F.aggregate("findings", F.lit(0), lambda s, x: s + x["count"]).alias("secrets"), R.summary(F.col("findings")).alias("summary"))


@query()
def redact_corpus(spark, d):
    """All documents through every rule, with what was found."""
    return R.redacted(documents(spark, d)).select("doc_id", "text", R.summary(F.col("findings")).alias("summary"))


_KNOWN = "known AS (SELECT text FROM benchmark UNION ALL SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0)"

# Corpus maintenance ---------------------------------------------------------------------------------------------------


@query(f"""WITH {_KNOWN} SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents
WHERE text NOT IN (SELECT text FROM known)) WHERE k = 1""")
def dedup_hash(spark, d):
    """All documents as a batch, against a store that knows the passages of the benchmark and what is labelled of low quality."""
    docs = documents(spark, d).withColumn("ord", F.col("doc_id"))
    low = documents(spark, d).join(table(spark, d, "labels").filter("quality = 0"), "doc_id", "left_semi").select("text")
    return corpus.new_documents(docs, low.unionByName(table(spark, d, "benchmark").select("text"))).select("doc_id", "text")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents")
def dedup_owner(spark, d):
    return corpus.owners(documents(spark, d))


#: a store of all documents; a batch of all of them, every third under a new id, every fifth with a changed text
_SHIFT = 1 << 40
_STORE = "store AS (SELECT doc_id, text FROM documents)"
_BATCH = f"""batch AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id + {_SHIFT} ELSE doc_id END AS doc_id,
  CASE WHEN doc_id % 5 = 0 THEN text || ' changed' ELSE text END AS text FROM documents)"""
_ACTIONS = f"""{_STORE}, {_BATCH}, own AS (SELECT sha256(text) AS h, min(doc_id) AS owner FROM store GROUP BY 1),
act AS (SELECT b.doc_id, b.text, CASE WHEN s.text = b.text THEN 'unchanged' WHEN own.owner IS NOT NULL THEN 'duplicate' WHEN s.doc_id IS NOT NULL THEN 'updated' ELSE 'added' END AS action, own.owner
  FROM batch b LEFT JOIN store s ON s.doc_id = b.doc_id LEFT JOIN own ON own.h = sha256(b.text))"""


def _store(spark, d):
    return documents(spark, d)


def _batch(spark, d):
    doc_id = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + _SHIFT).otherwise(F.col("doc_id"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return documents(spark, d).select(doc_id.alias("doc_id"), text.alias("text"))


@query(f"WITH {_ACTIONS} SELECT doc_id, action, CASE WHEN action = 'duplicate' THEN owner END AS owner FROM act")
def upsert_action(spark, d):
    return corpus.upsert_actions(_store(spark, d), _batch(spark, d))


@query(f"""WITH {_ACTIONS}, fresh AS (SELECT doc_id, text FROM act WHERE action IN ('updated', 'added'))
SELECT doc_id, text FROM store WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT * FROM fresh""")
def upsert_store(spark, d):
    return corpus.upserted(_store(spark, d), _batch(spark, d))


@query(f"""WITH {CHUNKS_SQL}, old AS (SELECT doc_id, CASE WHEN pos % 2 = 0 THEN text ELSE text || ' changed' END AS text FROM chunks)
SELECT doc_id, pos, EXISTS (SELECT 1 FROM old WHERE old.doc_id = c.doc_id AND old.text = c.text) AS reused FROM chunks c""")
def chunk_reuse(spark, d):
    c = word_chunks(spark, d)
    old = F.when(F.col("pos") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" changed")))
    return corpus.chunks_to_embed(c, c.withColumn("text", old))


@query(f"WITH {CHUNKS_SQL} SELECT chunk_id, doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_cascade(spark, d):
    gone = table(spark, d, "labels").select("doc_id")
    return corpus.without(word_chunks(spark, d), gone).select("chunk_id", "doc_id")


#: turns of a conversation by a role as the history of a document
@query("""WITH h AS (SELECT conv_id AS doc_id, turn AS time, role AS text FROM conversations),
l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY time) AS before FROM h), k AS (SELECT * FROM l WHERE before IS NULL OR before <> text),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY time) AS n FROM k)
SELECT doc_id, CAST(n AS INT) AS n, sha256(text)[1:8] AS hash, strlen(text) AS bytes, n = max(n) OVER (PARTITION BY doc_id) AS current FROM n""")
def versions(spark, d):
    c = table(spark, d, "conversations")
    return corpus.versions(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("time"), F.col("role").alias("text")))


@query("""WITH h AS (SELECT conv_id AS doc_id, turn AS time, text FROM conversations),
l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY time) AS before FROM h), k AS (SELECT * FROM l WHERE before IS NULL OR before <> text),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY time) AS n FROM k) SELECT doc_id, text FROM n WHERE n = 2""")
def version_restore(spark, d):
    c = table(spark, d, "conversations")
    return corpus.version_text(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("time"), "text"), 2)


@query("""SELECT d.doc_id, CASE WHEN l.doc_id % 2 = 0 THEN '{"toxic":' || toxic || '}' ELSE '{"lang":"' || lang || '"}' END AS meta FROM documents d LEFT JOIN labels l USING (doc_id)""")
def metadata_merge(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')).alias("meta"))
    new = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"toxic":'), F.col("toxic").cast("string"), F.lit("}"))).otherwise(F.lit("{}"))
    return corpus.merged_metadata(old, table(spark, d, "labels").select("doc_id", new.alias("meta")))


@query(f"""WITH {_STORE}, {_BATCH}
SELECT * FROM store UNION ALL SELECT * FROM batch WHERE doc_id NOT IN (SELECT doc_id FROM store) AND text NOT IN (SELECT text FROM store)""")
def merge_skip(spark, d):
    """Two whole stores: what has an id or a text of the first is skipped."""
    return corpus.merge(_store(spark, d), _batch(spark, d))


@query(f"""WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(DISTINCT sha256(text)) FROM documents) AS contents, count(*) AS chunks FROM chunks""")
def corpus_stats(spark, d):
    docs = documents(spark, d).agg(F.count("*").alias("docs"), F.countDistinct(corpus.content_hash(F.col("text"))).alias("contents"))
    return docs.crossJoin(word_chunks(spark, d).agg(F.count("*").alias("chunks")))


# Sources and sinks ----------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(text)[1:16] || '.txt' AS asset, text, CAST(NULL AS VARCHAR) AS error FROM documents""")
def base64_files(spark, d):
    docs = documents(spark, d)
    files = readers.from_base64(docs.select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("b64")))
    return files.select("doc_id", readers.asset_id(F.col("content"), F.lit("TXT")).alias("asset"), F.decode("content", "UTF-8").alias("text"), "error")


@query()
def extract_files(spark, d):
    """Pages as files of three kinds: one that no extractor takes, two that the registry does."""
    p = table(spark, d, "pages")
    ext = F.element_at(F.array(F.lit(".bin"), F.lit(".TXT"), F.lit(".md")), (F.col("page_id") % 3 + 1).cast("int"))
    files = p.select(F.concat(F.col("page_id").cast("string"), ext).alias("doc_id"), F.encode("html", "UTF-8").alias("content"))
    return readers.extracted(files)


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c""")
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", readers.page_text(F.col("html")).alias("text"))


@query("""SELECT doc_id FROM (SELECT user_id AS doc_id, value >= 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND ok""")
def journal_done(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.struct("ts", "event_id").alias("at"), (F.col("value") >= 50).alias("ok"))
    return readers.journal_done(e)


@query()
def export_json(spark, d):
    return readers.export_json(table(spark, d, "embeddings").withColumnRenamed("embedding", "vector"), vectors=True)


@query(r"""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS text, lang FROM documents)
SELECT doc_id, CASE WHEN lang = 'de' THEN text ELSE upper(text) END AS text, lang = 'de' AS dropped FROM a""")
def transform_sequence(spark, d):
    """Two transforms in turn: the first drops a language, the second changes the text."""
    t = Transforms(without_german=lambda x: {"text": x["text"], "drop": x["meta"].get("lang") == "de"}, loud=lambda x: {"text": x["text"].translate(_UPPER)})
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "?").alias("text"), F.to_json(F.struct("lang")).alias("meta"))
    return t.run(docs, "without_german", "loud").select("doc_id", "text", "dropped")


_UPPER = {i: i - 32 for i in range(97, 123)}
