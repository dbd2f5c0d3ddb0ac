"""Chat formatting from reply trees.

Messages form trees by their parents.  Paths are enumerated by repeated self-joins that double: after k joins each message
knows its ancestor 2**k steps up, and the sum of the scores and the number of the messages up to there, so a path of
depth d takes about log2(d) joins, which move ids and sums but no text.  A branch, from a root to a leaf, scores the mean score of its
messages; branches of a tree are ranked by score, then length (longer first), then the ids along the path.  Only of the
first ``branches`` of a tree (and those level with the last of them, until the ids decide) are the paths spelled out, by
the same joins backwards, and each is formatted as one conversation, ``<|im_start|>role`` line, text, ``<|im_end|>`` line for each message.

A table of plain turns has no parents: there a message answers the latest earlier turn of its conversation that another
role wrote (a system turn, having no such turn, is a root, and the first other turn answers it).  So turns in a row by
one role, such as answers generated again, are branches, and rows that share a turn number are alternatives.

Nulls: a null text counts as empty, a null role as 'user', a null score as 0.  Messages with a null tree or message id
are left out.  A parent that isn't there, or is the message itself, makes the message a root; messages on a cycle hang
from no root and are left out, with all that answers them.  Repeated rows count once; of rows that share a message id
and differ, the least (by role, text, score) counts.  Texts of any length are formatted whole.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import discard, table, written

BRANCHES = 1
TURNS = 1024


def reply_parents(turns: DataFrame) -> DataFrame:
    """(tree, message, parent, role, text, score) of plain turns (conv_id, turn, role, text); see the module's text.

    A message is told by its turn and its place among the rows of that turn; its score is the length of its text in
    thousands of characters.
    """
    t = turns.select(
        F.col("conv_id").cast("bigint").alias("tree"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("tree is not null and turn is not null").distinct()
    in_turn = Window.partitionBy("tree", "turn").orderBy("role", "text")
    t = t.withColumn("k", F.row_number().over(in_turn))
    t = t.withColumn("message", F.concat_ws(".", F.lpad(F.col("turn").cast("string"), 20, "0"), F.lpad(F.col("k").cast("string"), 9, "0")))
    t = written(t, "reply-turns")
    # the latest earlier message of each other role in the conversation, then the latest of these; long conversations
    # go by blocks of turns, each of which gets the latest message of the blocks before it
    said = t.select("tree", F.col("role").alias("other"), F.floor(F.col("turn") / TURNS).alias("block"), "turn", F.struct("turn", F.negate("k").alias("k"), "message").alias("m"))
    roles = said.select("tree", "other").distinct()
    kind = "struct<turn:bigint,k:int,message:string>"
    probes = t.select("tree", "role", F.floor(F.col("turn") / TURNS).alias("block"), "turn", "message").join(roles, "tree").filter("other <> role")
    blocks = said.groupBy("tree", "other", "block").agg(F.max("m").alias("last")).unionByName(
        probes.select("tree", "other", "block", F.lit(None).cast(kind).alias("last"))
    ).groupBy("tree", "other", "block").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy("tree", "other").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.max("last").over(earlier)).drop("last")
    both = said.withColumn("of", F.lit(None).cast("string")).unionByName(probes.select("tree", "other", "block", "turn", F.lit(None).cast(kind).alias("m"), F.col("message").alias("of")))
    before = Window.partitionBy("tree", "other", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("m", F.max("m").over(before)).filter("of is not null").join(blocks, ["tree", "other", "block"])
    answered = seen.groupBy("tree", F.col("of").alias("message")).agg(F.max(F.coalesce("m", "carried")).alias("answered"))
    t = t.join(answered, ["tree", "message"], "left")
    return t.select("tree", "message", F.col("answered.message").alias("parent"), "role", "text", (F.length("text") / F.lit(1000.0)).alias("score"))


def ancestors(links: DataFrame) -> list[DataFrame]:
    """Tables k = 0, 1, ... of (tree, message, up, sum, n): ``up`` is the ancestor 2**k steps up, null from the root on.

    ``sum`` and ``n`` are the scores and the number of the messages from this one up to, and without, ``up``.
    """
    out, before = [], None
    up = links.select("tree", "message", F.col("parent").alias("up"), F.col("score").alias("sum"), F.lit(1).alias("n"))
    while True:
        up = written(up, "reply-jumps")
        out.append(up)
        left = up.filter("up is not null").count()
        if left in (0, before):  # as many as before: all that is left hangs from cycles
            return out
        before = left
        above = up.select("tree", F.col("message").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"), F.col("n").alias("add"))
        up = up.join(above, ["tree", "up"], "left").select("tree", "message", F.col("next").alias("up"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), (F.col("n") + F.coalesce("add", F.lit(0))).alias("n"))


def reply_paths(messages: DataFrame, branches: int | None = BRANCHES) -> DataFrame:
    """(tree, branch, leaf, path, score, n_messages, conversation) of messages (tree, message, parent, role, text, score)."""
    m = messages.select(
        "tree",
        F.col("message"),
        F.col("parent"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).filter("tree is not null and message is not null")
    m = m.groupBy("tree", "message").agg(F.min(F.struct("role", "text", "score", "parent")).alias("m")).select("tree", "message", "m.*")
    m = written(m, "reply-messages")
    there = m.select("tree", F.col("message").alias("parent"), F.lit(True).alias("there"))
    links = m.select("tree", "message", "parent", "score").join(there, ["tree", "parent"], "left")
    links = written(links.select("tree", "message", "score", F.when(F.col("there") & (F.col("parent") != F.col("message")), F.col("parent")).alias("parent")), "reply-links")
    jumps = ancestors(links)

    answered = links.filter("parent is not null").select("tree", F.col("parent").alias("leaf")).distinct()
    leaves = jumps[-1].filter("up is null").select("tree", F.col("message").alias("leaf"), F.round(F.col("sum") / F.col("n"), 9).alias("score"), F.col("n").alias("n_messages"))
    leaves = leaves.join(answered, ["tree", "leaf"], "left_anti")
    by_score = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_messages"))
    if branches is not None:
        leaves = leaves.withColumn("level", F.rank().over(by_score)).filter(F.col("level") <= branches).drop("level")
    leaves = written(leaves, "reply-leaves")
    steps = written(leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("up")), "reply-steps")
    for k in range(len(jumps) - 1, -1, -1):
        jump = jumps[k].filter("up is not null").select("tree", F.col("message").alias("node"), F.col("up").alias("next"))
        more = steps.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("next").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        last, steps = steps, written(steps.unionByName(more), "reply-steps")
        discard(last)
    discard(links, *jumps)

    in_order = lambda what: F.sort_array(F.collect_list(F.struct(F.negate("up").alias("at"), what)))
    paths = steps.groupBy("tree", "leaf").agg(in_order("node").alias("nodes"))
    rank = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_messages"), "nodes.node")
    chosen = leaves.join(paths, ["tree", "leaf"]).withColumn("branch", F.row_number().over(rank))
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    chosen = written(chosen.select("tree", "branch", "leaf", F.concat_ws(">", "nodes.node").alias("path"), "score", "n_messages"), "reply-chosen")
    part = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("part")
    said = steps.join(chosen.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(m.select("tree", F.col("message").alias("node"), part), ["tree", "node"])
    said = said.groupBy("tree", "leaf").agg(F.array_join(in_order("part")["part"], "").alias("conversation"))
    return chosen.join(said, ["tree", "leaf"]).select("tree", "branch", "leaf", "path", "score", "n_messages", "conversation")


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_paths(reply_parents(table(spark, sf_dir, "conversations"))).withColumnRenamed("tree", "conv_id")


SQL = {
    "op8_reply_trees": f"""
WITH RECURSIVE u AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
      WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k FROM u),
m AS (SELECT *, lpad(CAST(turn AS VARCHAR), 20, '0') || '.' || lpad(CAST(k AS VARCHAR), 9, '0') AS message FROM k),
p AS (SELECT m.conv_id, m.message, m.role, m.text, length(m.text) / 1000.0::DOUBLE AS score,
      (SELECT b.message FROM m b WHERE b.conv_id = m.conv_id AND b.turn < m.turn AND b.role <> m.role ORDER BY b.turn DESC, b.k LIMIT 1) AS parent FROM m),
t AS (SELECT conv_id, message AS leaf, message AS path, score AS total, 1 AS n_messages, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS conversation
      FROM p WHERE parent IS NULL
      UNION ALL SELECT t.conv_id, p.message, t.path || '>' || p.message, t.total + p.score, t.n_messages + 1,
        t.conversation || '<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10) FROM t JOIN p ON p.conv_id = t.conv_id AND p.parent = t.leaf),
l AS (SELECT *, round(total / n_messages, 9) AS score FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = t.conv_id AND p.parent = t.leaf)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, n_messages DESC, path) AS branch FROM l)
SELECT conv_id, CAST(branch AS INT) AS branch, leaf, path, score, n_messages, conversation FROM r WHERE branch <= {BRANCHES}"""
}
