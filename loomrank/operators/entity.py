"""Entity graph: parsing extractions, merging, canonical names, pruning, linking queries, facts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions import vectors as V

GENERIC = frozenset("a an the it he she they we this that these those thing things entity item object concept system some one".split())
NODE_FLOOR = FACT_FLOOR = 0.30
NODE_TOP, FACT_TOP, FACT_NODES, SHOWN = 24, 12, 8, 14
PART = 50000


def _fields(line):
    clean = F.regexp_replace(F.regexp_replace(F.trim(line), "^- ", ""), "^`+|`+$", "")
    return F.transform(F.split(clean, r"\|"), lambda x: F.trim(x))


def parsed(outputs: DataFrame, tagged: bool = False) -> DataFrame:
    """(chunk_id, ord, kind, a, b, description) of a model's lines (chunk_id, output): ``entity|name|type|description``
    and ``relation|source|target|description``; other lines are ignored.  Tagged lines have a passage number, counted from
    1, after the kind, which chunk_id then is an array for."""
    # a small file may hold very many outputs: a task gets at most about PART of them, however many there are
    parts = 1 if outputs.isStreaming else -(-outputs.count() // PART)
    if parts > 1:
        outputs = outputs.repartition(parts, "chunk_id")
    rows = outputs.select("chunk_id", F.posexplode(F.split("output", "\n")).alias("ord", "line")).withColumn("f", _fields(F.col("line")))
    kind = F.lower(F.get("f", F.lit(0)))
    at = 1
    if tagged:
        n = F.when(F.get("f", F.lit(1)).rlike("^[0-9]{1,9}$"), F.get("f", F.lit(1)).cast("int"))
        rows = rows.withColumn("tag", n).filter((F.col("tag") >= 1) & (F.col("tag") <= F.size("chunk_id"))).withColumn("chunk_id", F.get("chunk_id", F.col("tag") - 1))
        at = 2
    get = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    rest = F.array_join(F.slice("f", at + 3, 1000), " ")
    entity = (kind == "entity") & (get(at) != "")
    relation = kind.isin("relation", "relationship") & (get(at) != "") & (get(at + 1) != "")
    return rows.filter(entity | relation).select("chunk_id", "ord", F.when(entity, "entity").otherwise("relation").alias("kind"), get(at).alias("a"), get(at + 1).alias("b"), rest.alias("description"))


def cleaned(lines: DataFrame) -> DataFrame:
    """Without relations whose ends aren't names: an end is one if its chunk lists it as an entity or it has a capital."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    named = lines.filter("kind = 'entity'").select(F.col("chunk_id").alias("c"), norm("a").alias("name")).distinct()
    out = lines
    for end in ("a", "b"):
        hit = named.select(F.col("c").alias(f"c_{end}"), F.col("name").alias(f"n_{end}"))
        out = out.join(hit, (F.col("chunk_id") == F.col(f"c_{end}")) & (norm(end) == F.col(f"n_{end}")), "left")
    ok = lambda e: (norm(e) != "") & (F.col(f"n_{e}").isNotNull() | F.col(e).rlike(r"\p{Lu}"))
    return out.filter((F.col("kind") == "entity") | (ok("a") & ok("b"))).select(*lines.columns)


def merged(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``merged_with_counts`` without the number of chunks."""
    entities, relations = merged_with_counts(lines)
    return entities.drop("n_chunks"), relations


def merged_with_counts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (name, display, type, description, chunks, mentions) and relations (source < target, description, weight) of cleaned lines.

    Order within a chunk is the lines', between chunks that of their ids; first spellings, types and relation
    descriptions stay; distinct descriptions are joined.  A relation's end counts as a mention where its chunk has no other.
    Entities also have the number of their chunks, n_chunks: plans that don't read ``chunks`` make no lists of them.
    """
    norm = lambda c: F.lower(F.trim(c))
    ents = lines.filter("kind = 'entity'").select("chunk_id", F.col("ord").cast("bigint").alias("ord"), norm(F.col("a")).alias("name"), F.trim("a").alias("display"), F.trim("b").alias("type"), F.trim("description").alias("d"), F.lit(1).alias("listed")).filter("name <> ''")
    rels = lines.filter("kind = 'relation'").select("chunk_id", "ord", norm(F.col("a")).alias("s"), norm(F.col("b")).alias("t"), F.trim("a").alias("sd"), F.trim("b").alias("td"), F.trim("description").alias("d")).filter("s <> t")
    ends = rels.select("chunk_id", F.explode(F.array(F.struct((F.col("ord") * 2 + 1000000).alias("o"), F.col("s").alias("n"), F.col("sd").alias("x")), F.struct((F.col("ord") * 2 + 1000001).alias("o"), F.col("t").alias("n"), F.col("td").alias("x")))).alias("e"))
    ends = ends.select("chunk_id", F.col("e.o").cast("bigint").alias("ord"), F.col("e.n").alias("name"), F.col("e.x").alias("display"), F.lit("").alias("type"), F.lit("").alias("d"), F.lit(0).alias("listed"))
    rows = ents.unionByName(ends)
    per_chunk = rows.groupBy("name", "chunk_id").agg(F.greatest(F.sum("listed"), F.lit(1)).alias("m"))
    counts = per_chunk.groupBy("name").agg(F.sum("m").cast("bigint").alias("mentions"), F.count("*").alias("n_chunks"), F.sort_array(F.collect_list("chunk_id")).alias("chunks"))
    first = F.struct("chunk_id", "ord")
    text = rows.groupBy("name").agg(
        F.min_by("display", first).alias("display"),
        F.coalesce(F.min_by("type", F.when(F.col("type") != "", first)), F.lit("")).alias("type"),
    )
    # the first place of each description, before any are listed: a name has as many as it has different ones
    said = rows.filter("d <> ''").groupBy("name", "d").agg(F.min(first).alias("at"))
    said = said.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "d"))), lambda s: s["d"]), " ").alias("description"))
    entities = counts.join(text, "name").join(said, "name", "left")
    entities = entities.select("name", "display", "type", F.coalesce("description", F.lit("")).alias("description"), "chunks", "mentions", "n_chunks")
    relations = rels.groupBy(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target")).agg(
        F.coalesce(F.min_by("d", F.when(F.col("d") != "", first)), F.lit("")).alias("description"), F.count("*").alias("weight")
    )
    return entities, relations


def edit_ratio(a, b):
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.octet_length(a), F.octet_length(b))


def alike_pairs(entities: DataFrame) -> DataFrame:
    """(a, b) of names that are variants: an edit ratio of 0.9, or all words of the shorter, none generic or under 4 bytes, in the longer.

    Nothing is compared that can't be alike: an edit ratio of 0.9 leaves a tenth of the longer name's bytes to edits, so
    one of the pieces that names of this length are cut into is equal, near its place; words meet by the word.
    """
    names = entities.select("name").filter("name <> ''").distinct()
    n = F.octet_length("name")
    # names of up to 10 L + 9 bytes may differ by L edits; L + 1 pieces, one of them untouched, moved by at most L
    most = F.floor(n / F.lit(10)).cast("int")
    cuts = lambda edits: F.transform(F.sequence(F.lit(0), edits), lambda k: F.struct(k.alias("k"), F.floor(k * n / (edits + 1)).cast("int").alias("at"), (F.floor((k + 1) * n / (edits + 1)) - F.floor(k * n / (edits + 1))).cast("int").alias("size")))
    limits = F.array_distinct(F.array(most, F.floor((n + most) / F.lit(10)).cast("int"), F.floor((n + most + 1) / F.lit(10)).cast("int")))
    piece = names.withColumn("edits", F.explode(limits)).filter("edits > 0").withColumn("c", F.explode(cuts(F.col("edits"))))
    piece = piece.select(F.col("name").alias("a"), F.col("edits").alias("ea"), F.col("c.at").alias("at"), F.substring("name", F.col("c.at") + 1, F.col("c.size")).alias("piece"))
    probe = names.withColumn("edits", F.explode(limits)).filter("edits > 0")
    sizes = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.transform(F.sequence(n - F.col("edits"), n + F.col("edits")), lambda m: F.floor(m / (F.col("edits") + 1)).cast("int") + F.greatest(d, F.lit(0))))))
    probe = probe.withColumn("size", F.explode(sizes)).filter("size > 0 and size <= octet_length(name)")
    probe = probe.withColumn("at", F.explode(F.sequence(F.lit(0), n - F.col("size")))).select(F.col("name").alias("b"), F.col("edits").alias("eb"), F.col("at").alias("bt"), F.expr("substring(name, at + 1, size)").alias("piece"))
    near = probe.join(piece, "piece").filter("a <> b and ea = eb and abs(at - bt) <= ea").select("a", "b").distinct()
    near = near.filter(edit_ratio(F.col("a"), F.col("b")) >= 0.9)
    words = names.select("name", F.explode(F.split("name", r"\s+")).alias("w"), F.size(F.split("name", r"\s+")).alias("k"))
    good = words.filter((F.octet_length("w") >= 4) & ~F.col("w").isin(*GENERIC))
    short, long = good.toDF("a", "w", "ka"), words.distinct().toDF("b", "w", "kb")
    within = short.distinct().join(long, "w").filter("kb >= 2 and ka < kb").groupBy("a", "b", "ka").agg(F.countDistinct("w").alias("hit"))
    distinct_words = words.groupBy(F.col("name").alias("a")).agg(F.countDistinct("w").alias("all"))
    within = within.join(distinct_words, "a").filter("hit = all and octet_length(a) <= octet_length(b)").select("a", "b")
    both = near.unionByName(within)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def canonical_names(entities: DataFrame) -> DataFrame:
    """(name, canonical): greedy, from the longest name down (ties: more mentions, then the name), each joining the first head it is a variant of.

    Pairs are found in Spark; the greedy pass is sequential, but only within names that pairs connect, so each connected
    group is one task.
    """
    names = entities.select("name", "mentions")
    pairs = alike_pairs(entities)
    label = propagate_labels_min(pairs, names.select(F.col("name").alias("node")))

    def run(key, left, right):
        rows = sorted(zip(left.column("name").to_pylist(), left.column("mentions").to_pylist()), key=lambda r: (-len(r[0].encode()), -r[1], r[0]))
        alike = set(zip(right.column("a").to_pylist(), right.column("b").to_pylist()))
        heads: list[str] = []
        out = []
        for name, _ in rows:
            head = next((h for h in heads if (min(name, h), max(name, h)) in alike), None)
            if head is None:
                heads.append(name)
            out.append((name, head or name))
        return pa.table({"name": [r[0] for r in out], "canonical": [r[1] for r in out]})

    left = names.join(label.withColumnRenamed("node", "name"), "name")
    right = pairs.join(label.select(F.col("node").alias("a"), F.col("label").alias("of")), "a")
    return left.groupBy("label").cogroup(right.groupBy("of")).applyInArrow(run, "name string, canonical string")


def propagate_labels_min(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node connected by pairs (a, b)."""
    from loomrank.sources.shared import written

    both = written(pairs.union(pairs.select("b", "a")), "alike")
    label = nodes.withColumn("label", F.col("node"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("heard")), "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("near"))
        step = label.select("node", F.col("label").alias("old")).join(near, "node", "left").select("node", F.least("old", F.coalesce("near", "old")).alias("to"), "old")
        up = label.select(F.col("node").alias("to"), F.col("label").alias("up"))
        step = written(step.join(up, "to").select("node", F.col("up").alias("label"), "old"), "alike-labels")
        label = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return label


def canonicalised(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations with names replaced by canonical ones (name, canonical) and merged; relations that collapse are dropped."""
    e = entities.join(names, "name")
    head = F.struct(F.col("name") != F.col("canonical"), F.negate(F.octet_length("name")), F.negate("mentions"), F.col("name"))
    e = e.groupBy("canonical").agg(
        F.min_by("display", head).alias("display"),
        F.coalesce(F.min_by("type", F.when(F.col("type") != "", head)), F.lit("")).alias("type"),
        F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("description") != "", F.col("description"))))), " ").alias("description"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"),
        F.sum("mentions").cast("bigint").alias("mentions"),
    ).withColumnRenamed("canonical", "name")
    s, t = names.toDF("source", "s"), names.toDF("target", "t")
    r = relations.join(s, "source", "left").join(t, "target", "left").select(F.coalesce("s", "source").alias("s"), F.coalesce("t", "target").alias("t"), "description", "weight", "source", "target").filter("s <> t")
    r = r.groupBy(F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target")).agg(
        F.coalesce(F.min(F.when(F.col("description") != "", F.col("description"))), F.lit("")).alias("description"),
        F.sum("weight").cast("bigint").alias("weight"),
    )
    return e, r


def pruned(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without generic names and their relations; then without unlinked entities of one mention, no type and no description."""
    noise = F.col("name").isin("", *GENERIC)
    kept_rel = relations.filter(~F.col("source").isin("", *GENERIC) & ~F.col("target").isin("", *GENERIC))
    linked = kept_rel.select(F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("linked", F.lit(True))
    e = entities.filter(~noise).join(linked, "name", "left")
    ghost = F.col("linked").isNull() & (F.col("type") == "") & (F.col("description") == "") & (F.col("mentions") <= 1)
    e = e.filter(~ghost).drop("linked")
    return e.select(*entities.columns), kept_rel


def without_chunks(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cascade of deleted chunks (chunk_id): entities lose them, those without any leave with their relations."""
    live = entities.select("name", F.explode("chunks").alias("chunk_id")).join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")
    live = live.groupBy("name").agg(F.sort_array(F.collect_list("chunk_id")).alias("live"))
    e = entities.join(live, "name").withColumn("chunks", F.col("live")).select(*entities.columns)
    names = e.select("name")
    r = relations.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
    return e, r.select(*relations.columns)


def cache_key(version, model, text):
    """Key of a cached extraction: version, model and text, kept apart by NUL."""
    return F.sha2(F.concat_ws("\0", version, model, text), 256)


def cache_misses(chunks: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """Chunks (chunk_id, text) that the cache (key, ...) has no extraction of."""
    return chunks.withColumn("key", cache_key(F.lit(version), F.lit(model), F.col("text"))).join(cache.select("key"), "key", "left_anti").select("chunk_id", "key")


def name_hits(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, name, hits): how many of an entity's words a query (qid, query) has."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-zA-Z0-9]+"), lambda t: t != "")
    q = queries.select("qid", F.explode(F.array_distinct(F.filter(words(F.col("query")), lambda t: F.length(t) >= 2))).alias("w"))
    e = entities.select("name", F.explode(words(F.col("name"))).alias("w"))
    return e.join(q, "w").groupBy("qid", "name").agg(F.count("*").alias("hits"))


def node_seeds(entities: DataFrame, queries: DataFrame, top: int = NODE_TOP, floor: float = NODE_FLOOR) -> DataFrame:
    """(qid, name, weight) of entities (name, vector) and queries (qid, query, qv): cosine of the top matches over a floor, plus half a name hit each."""
    sim = entities.crossJoin(queries).select("qid", "name", F.round(V.cosine(F.col("vector"), F.col("qv")), 6).alias("sim")).filter(F.col("sim") >= floor)
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "name")
    dense = sim.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).drop("k")
    lex = name_hits(entities, queries)
    return dense.join(lex, ["qid", "name"], "full").select("qid", "name", F.round(F.coalesce("sim", F.lit(0.0)) + F.lit(0.5) * F.coalesce("hits", F.lit(0)), 6).alias("weight"))


def fact_texts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(source, target, fact): the sentence a relation is embedded by."""
    s = entities.select(F.col("name").alias("source"), F.col("display").alias("s"))
    t = entities.select(F.col("name").alias("target"), F.col("display").alias("t"))
    j = relations.join(s, "source", "left").join(t, "target", "left")
    name = lambda d, n: F.coalesce(F.when(F.col(d) != "", F.col(d)), F.col(n))
    return j.select("source", "target", F.trim(F.concat_ws(" ", name("s", "source"), F.when(F.col("description") != "", F.col("description")), name("t", "target"))).alias("fact"))


def fact_seeds(facts: DataFrame, entities: DataFrame, queries: DataFrame, top: int = FACT_TOP, floor: float = FACT_FLOOR, most: int = FACT_NODES) -> DataFrame:
    """(qid, name, weight): ends of the facts (source, target, vector) nearest a query (qid, qv), each divided by its number of chunks."""
    sim = facts.crossJoin(queries).select("qid", "source", "target", F.round(V.cosine(F.col("vector"), F.col("qv")), 6).alias("sim")).filter(F.col("sim") >= floor)
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "source", "target")
    ends = sim.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).select("qid", "sim", F.explode(F.array("source", "target")).alias("name"))
    spread = entities.select("name", F.greatest(F.size("chunks"), F.lit(1)).alias("n"))
    node = ends.join(spread, "name", "left").groupBy("qid", "name").agg(F.round(F.sum(F.col("sim") / F.coalesce("n", F.lit(1))), 6).alias("weight"))
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "name")
    return node.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def chunk_scores(mass: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, chunk_id, score): entity mass (qid, node, mass) summed over an entity's chunks, over each query's highest."""
    s = mass.join(entities.select(F.col("name").alias("node"), F.explode("chunks").alias("chunk_id")), "node").groupBy("qid", "chunk_id").agg(F.sum("mass").alias("s"))
    top = F.max("s").over(Window.partitionBy("qid"))
    return s.select("qid", "chunk_id", F.round(F.when(top > 0, F.col("s") / top).otherwise(0.0), 6).alias("score"))


def top_entities(mass: DataFrame, entities: DataFrame, most: int = SHOWN) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "name")
    j = mass.select("qid", F.col("node").alias("name"), F.round("mass", 6).alias("score")).filter("score > 0").join(entities.select("name", "display", "type"), "name")
    return j.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def relation_context(hits: DataFrame, entities: DataFrame, relations: DataFrame, most: int = 12) -> DataFrame:
    """(qid, rank, line): relations with ends in the chunks of hits (qid, chunk_id), those with both first, then by weight."""
    present = entities.select("name", F.explode("chunks").alias("chunk_id")).join(hits.select("qid", "chunk_id"), "chunk_id").select("qid", "name").distinct()
    s = present.select("qid", F.col("name").alias("source"), F.lit(1).alias("ps"))
    t = present.select("qid", F.col("name").alias("target"), F.lit(1).alias("pt"))
    a, b = relations.join(s, "source"), relations.join(t, "target")
    j = a.join(b.select("qid", "source", "target", "pt"), ["qid", "source", "target"], "full")
    j = j.select("qid", "source", "target", (F.col("ps").isNotNull() & F.col("pt").isNotNull()).alias("both")).join(relations, ["source", "target"])
    order = Window.partitionBy("qid").orderBy(F.desc("both"), F.desc("weight"), "source", "target")
    j = j.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    show = entities.select("name", "display")
    j = j.join(show.toDF("source", "sd"), "source", "left").join(show.toDF("target", "td"), "target", "left")
    d = F.trim("description")
    line = F.concat(F.coalesce(F.when(F.col("sd") != "", F.col("sd")), F.col("source")), F.lit(" -> "), F.coalesce(F.when(F.col("td") != "", F.col("td")), F.col("target")), F.when(d != "", F.concat(F.lit(": "), d)).otherwise(F.lit("")))
    return j.select("qid", "rank", line.alias("line"))
