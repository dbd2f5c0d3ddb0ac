"""Operators against brute force over several blocks, odd rows, and plans that don't grow faster than the input."""

import contextlib
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.functions import embed
from loomrank.operators import chunking, entity, graph, lexical, vector
from loomrank.plans import graphs


def plan(df) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def near(ids, x, k, floor):
    x = np.array(x, np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((u := x / np.where(n > 0, n, 1)) @ u.T, 6)
    return {(a, b, s[i, j]) for i, a in enumerate(ids) for b, j in sorted(((b, j) for j, b in enumerate(ids) if b != a and s[i, j] >= floor), key=lambda r: (-s[i, r[1]], r[0]))[:k]}


@pytest.mark.parametrize(("kind", "floor"), [("float", 0.3), ("double", -0.5)])
def test_neighbours_equal_brute_force(spark, kind, floor):
    """Ties, copies, a vector without length and null ones, over several blocks; pairs of blocks aren't shuffled."""
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 6)).astype(np.float32)
    x[100:160] = x[7]
    x[200:230] = 0.5
    x[300] = 0
    ids = r.permutation(2000)[:700].tolist()
    items = spark.createDataFrame([*zip(ids, x.tolist()), (9001, None), (None, x[0].tolist())], f"id bigint, vector array<{kind}>")
    for blocks in (None, 5):
        df = vector.neighbours(items, 4, floor, blocks)
        assert {tuple(row) for row in df.collect()} == near(ids, x, 4, floor)
        assert "hashpartitioning(i" not in plan(df)


def test_neighbours_of_named_items(spark):
    x = np.random.default_rng(4).normal(size=(300, 5)).astype(np.float32)
    ids = [f"é{n * 7 % 300}" for n in range(300)]
    items = spark.createDataFrame([*zip(ids, x.tolist())], "id string, vector array<float>")
    assert {tuple(row) for row in vector.neighbours(items, 3, 0.1, 3).collect()} == near(ids, x, 3, 0.1)


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_search_equals_brute_force(spark, metric):
    """Every pair is scored, without a row for each: odd vectors have no score and come last."""
    r = np.random.default_rng(5)
    x, q = r.normal(size=(3000, 4)).astype(np.float32), r.normal(size=(7, 4))
    x[50:80] = x[3]
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    y = x.astype(np.float64)
    s = unit(q) @ unit(y).T if metric == "cosine" else q @ y.T if metric == "ip" else -((q[:, None] - y[None]) ** 2).sum(2)
    want = {(i, int(j), round(float(s[i, j]), 6), n + 1) for i in range(7) for n, j in enumerate(np.lexsort((np.arange(3000), -np.round(s[i], 6)))[:40])}
    items = spark.createDataFrame([(n, v) for n, v in enumerate(x.tolist())], "id int, vector array<float>").repartition(5)
    queries = spark.createDataFrame([(n, v) for n, v in enumerate(q.tolist())], "qid int, qv array<double>")
    df = vector.search(items, queries, 40, metric)
    assert {(a.qid, a.id, round(a.score, 6), a.rank) for a in df.collect()} == want
    assert "MapInArrow" in plan(df)
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0]), (5, [1.0, None])], "id int, vector array<float>")
    got = vector.search(few, spark.createDataFrame([(0, [1.0, 1.0])], "qid int, qv array<double>"), 4, metric)
    assert [(a.id, a.score is None) for a in got.orderBy("rank").collect()] == [(1, False), (4, False), (2, True), (3, True)]


def test_edges_are_found_once(spark, data, monkeypatch):
    """A plan that reads the graph more than once doesn't search the neighbours anew."""
    calls = []
    found = vector.neighbours
    monkeypatch.setattr(vector, "neighbours", lambda *a, **k: calls.append(1) or found(*a, **k))
    assert "MapInArrow" not in plan(graphs.modularity(spark, data)) + plan(graphs.graph_degree(spark, data))
    assert len(calls) == 2


def test_asynchronous_labels_equal_plain_lists(spark):
    """The same communities as the sequential pass over lists of tuples that it was written from."""
    r = np.random.default_rng(6)
    pairs = {tuple(sorted(map(int, p))) for p in r.integers(0, 90, (260, 2)) if p[0] != p[1]}
    rows = [(a, b, float(np.float32(r.random()))) for a, b in sorted(pairs)]
    edges, nodes = spark.createDataFrame(rows, "a bigint, b bigint, w double"), spark.range(95).select(F.col("id").alias("node"))
    assert {tuple(x) for x in graph.detect_communities(edges, nodes).collect()} == plain_labels(rows, 95)


def plain_labels(rows, n, rounds=20, state=0):
    near = [[] for _ in range(n)]
    for a, b, w in sorted(rows):
        near[a].append((b, w))
        near[b].append((a, w))
    label, order, mask = list(range(n)), list(range(n)), (1 << 64) - 1
    for _ in range(rounds):
        for i in range(n - 1, 0, -1):
            state = (state + 0x9E3779B97F4A7C15) & mask
            z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
            j = (z ^ (z >> 31)) % (i + 1)
            order[i], order[j] = order[j], order[i]
        before = label[:]
        for v in order:
            heard = {}
            for u, w in near[v]:
                heard[label[u]] = heard.get(label[u], np.float32(0)) + np.float32(w)
            if heard:
                label[v] = min(heard, key=lambda c: (-heard[c], c))
        if before == label:
            break
    first = {}
    return {(v, first.setdefault(c, len(first))) for v, c in enumerate(label)}


def test_hashed_words_are_added_in_place(spark):
    """Rows that share an id are one text; rows without words leave; no shuffle of words."""
    rows = [(1, "Amber basin, amber"), (2, None), (1, "CEDAR 7 amber"), (3, " ,; "), (4, "x"), (None, "delta")]
    df = embed.hashed(spark.createDataFrame(rows, "doc_id int, text string"), 8)
    want = {}
    for n, text in rows:
        for w in re.findall(r"[a-z0-9]+", (text or "").lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want.setdefault(n, np.zeros(8))[h % 8] += -1 if h >= 1 << 31 else 1
    got = {r.doc_id: r.vector for r in df.collect()}
    assert set(got) == {n for n, v in want.items() if v.any()}
    assert all(np.allclose(v, want[n] / np.linalg.norm(want[n])) for n, v in got.items())
    assert "Generate explode" not in plan(df) and "MapInArrow" in plan(df)


def plainly_located(text, piece, start):
    """By regular expressions and character by character, as it was first written."""
    words = piece.split()
    if not words:
        return -1, -1
    at = re.compile(r"\s*".join(re.escape(c) for c in "".join(words[:2]))) if len(piece) < 200 else re.compile(r"\s+".join(map(re.escape, words[:8])))
    for m in at.finditer(text, max(0, start)):
        i = m.start()
        for c in "".join(words):
            while i < len(text) and text[i].isspace():
                i += 1
            if i >= len(text) or text[i] != c:
                break
            i += 1
        else:
            return m.start(), i
    return -1, -1


def test_pieces_are_located_as_by_patterns():
    r = random.Random(2)
    for n in range(300):
        text = "".join(r.choice(["a", "ab", "b ", "a\n", " ", "\u3000", "\x85", "Mr. ", "e.g. ", "x. ", "A", "1! "]) for _ in range(r.randrange(900)))
        for split in chunking.STRATEGIES.values():
            places, cursor = chunking.Places(text), 0
            for piece, _ in split(text, 12, 3):
                got = places.located(piece, cursor)
                assert got == plainly_located(text, piece, cursor)
                cursor = max(cursor, got[0])
            assert places.located(text[5:400] + "c", 0) == plainly_located(text, text[5:400] + "c", 0)


def test_locating_compiles_no_pattern(monkeypatch):
    """A pattern a piece was most of the time."""
    text = " ".join(f"word{n}" for n in range(4000))
    places = chunking.Places(text)
    monkeypatch.setattr(re, "compile", None)
    assert [places.located(p, 0) for p, _ in chunking.recursive_pieces(text)][1] == (text.index("word96 "), text.index(" word216"))


def test_bm25_without_postings_equals_the_joins(spark, monkeypatch):
    """Scores are made where the texts are read; repeated ids still go through the joins."""
    r = random.Random(7)
    words = [f"w{n}" for n in range(60)]
    rows = [(n, " ".join(r.choices(words, k=r.randrange(40))) if n % 50 else None) for n in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=6))) for q in range(20)] + [(3, "w1 w2"), (30, ""), (31, "none")], "qid int, query string")
    df = lexical.bm25(docs, queries, 7)
    got = {(a.qid, a.doc_id, round(a.score, 5), a.rank) for a in df.collect()}
    assert "MapInArrow" in plan(df) and "Join" not in plan(df)
    twice = lexical.bm25(docs.union(docs), queries, 7)
    assert "MapInArrow" not in plan(twice)
    monkeypatch.setattr(lexical, "MOST_TERMS", 0)
    assert got == {(a.qid, a.doc_id, round(a.score, 5), a.rank) for a in lexical.bm25(docs, queries, 7).collect()} and len(got) == 140
    monkeypatch.undo()
    assert lexical.bm25(docs.limit(0), queries, 7).count() == 0


def test_merged_descriptions_are_told_apart_before_they_are_listed(spark, data):
    """In the order of their first places; a name's chunks are listed only where they are read."""
    said = ["entity|Oak|tree|tall", "entity|oak||old\nentity|OAK|wood|tall", "entity|oak||tall\nrelation|Oak|Elm|near\nentity|Elm||", "entity|oak|x|green\nentity|oak||"]
    lines = entity.cleaned(entity.parsed(spark.createDataFrame(list(enumerate(said)), "chunk_id int, output string")))
    e, _ = entity.merged(lines)
    assert {tuple(map(str, r)) for r in e.collect()} == {("oak", "Oak", "tree", "tall old green", "[0, 1, 2, 3]", "6"), ("elm", "Elm", "", "", "[2]", "1")}
    merge, prune = plan(graphs.ent_merge(spark, data)), plan(graphs.ent_prune(spark, data))
    assert "collect_list(chunk_id" not in merge + prune
    assert "collect_list(CASE" not in merge + prune and "collect_list(if" not in merge + prune
