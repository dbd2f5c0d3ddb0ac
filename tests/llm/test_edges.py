"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator; brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loomrank.llm import chat, fingerprint, jaccard_join, licences, packing, pii, quality, tokens, toxicity

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty kelp lagoon meadow north ocean prairie quarry river summit tundra".split()
KIND = "doc_id bigint, text string, lang string, key string, value string, shard int, score double, n_chars bigint"


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, wordless and very long texts, copies, a repeated row, other columns with clashing names."""
    texts = [
        (1, prose(1)), (2, prose(1)), (2, prose(1)), (3, prose(3) + " mail ann@example.org"), (4, None), (5, ""), (6, " \n\t"), (None, prose(9)), (None, None),
        (7, "!!! ??? ..."), (8, "x"), (9, prose(4, 30000)), (10, "é" * 70000), (11, prose(5) + " \U0001f600 end"), (12, prose(12)), (12, prose(13)),
    ]
    return spark.createDataFrame([(i, t, "en", "k", "v", 1, 0.5, len(t or "")) for i, t in texts], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (9, 1, 0), (None, 1, 1), (11, None, None), (12, 0, 1)], "doc_id bigint, quality int, toxic int")


def operators(labels):
    return {
        "packing": packing.pack_documents,
        "digests": fingerprint.digests,
        "like_pairs": fingerprint.like_pairs,
        "quality": lambda d: quality.quality(d, labels),
        "pii": pii.find_identifiers,
        "encode": tokens.encode,
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "licences": licences.scan_licences,
        "jaccard": jaccard_join.jaccard_classes,
        "jaccard_links": jaccard_join.jaccard_links,
        "counts": tokens.count_tokens,
    }


NAMES = ["packing", "digests", "like_pairs", "quality", "pii", "encode", "toxicity", "licences", "jaccard", "jaccard_links", "counts"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(odd, labels, name):
    rows = operators(labels)[name](odd).collect()
    if name in ("digests", "quality", "encode", "toxicity", "counts"):  # a row for each row
        assert len(rows) == odd.count()
    if name == "packing":
        packed = sorted(str(i) for r in rows for i in r.doc_ids)
        whole = {(i, a) for r in rows for i, a in zip(r.doc_ids, r.starts)}
        assert {i for i, _ in whole} == {None, 1, 2, 3, 8, 9, 10, 11, 12}
        assert packed.count("2") == 2 and packed.count("1") == 1
    if name == "jaccard":
        own = {(r.doc_id, r.set_id): (r.class_id, r.links) for r in rows}
        assert own[1, 1] == own[2, 1] == (1, 0)
        assert sorted(r.doc_id for r in rows) == [1, 2, 3, 8, 9, 10, 11, 12, 12]  # 12 has two texts
    if name == "jaccard_links":
        assert rows == []
    if name == "pii":
        assert [(r.doc_id, r.value, r.kind) for r in rows if r.doc_id == 3] == [(3, "ann@example.org", "email")]
    if name == "quality":
        assert all(r.probability == 0 and r.decision == "reject" for r in rows if r.doc_id in (4, 5))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(none, labels, name):
    assert operators(labels)[name](none).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    one = corpus_pipeline.keep_one_of_each(spark, odd, str(tmp_path))
    ids = [r.doc_id for r in one.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(12) == 1 and ids.count(None) == 2


def test_pipeline_stages_keep_columns_of_any_name(spark, labels, tmp_path):
    """Names that the stages use themselves, and names with dots and marks, pass through with their values."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ["a.b", "row_of_id", "place", "found_id", "found_spans", "spans", "c0", "c1", "fp", "root", "first", "h", "y", "count", "x`y"]
    rows = [(i, prose(i % 3, 80) + " mail ann@example.org", *range(len(names))) for i in (1, 2, 3, 4)] + [(4, prose(8, 50), *range(len(names)))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = out.collect()
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in kept) and (kept or name == "quality")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_masking(spark):
    docs = spark.createDataFrame([(1, "write to bob@example.org now", 28), (2, "nothing here", 12), (None, None, None)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.mask(docs, pii.find_identifiers(docs)).collect()}
    assert got == {1: ("write to [EMAIL] now", 20), 2: ("nothing here", 12), None: (None, None)}


def test_pii_inside_runs(spark):
    """Identifiers in brackets, lists, JSON, HTML and URLs, and secrets without a digit, are found and masked."""
    texts = {
        "password = correcthorse": "password = [SECRET]", "(bob@x.org)": "([EMAIL])", "a@x.org,b@y.org": "[EMAIL],[EMAIL]", "10.0.0.1,10.0.0.2": "[IP],[IP]",
        '{"email":"a@x.org"}': '{"email":"[EMAIL]"}', "<td>a@x.org</td>": "<td>[EMAIL]</td>", "see http://10.0.0.1:8080/ now": "see http://[IP]:8080/ now",
        '{"password":"correcthorse","n":1}': '{"password":"[SECRET]","n":1}', '{"phone":"+1 555 010 9999"}': '{"phone":"[PHONE]"}', '{"card":"4111111111111111"}': '{"card":"[CARD]"}',
        "version 1.2.3.4.5 of a@b": "version 1.2.3.4.5 of a@b", "no secret here, my tokens are words": "no secret here, my tokens are words",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.mask(docs, pii.find_identifiers(docs)).collect()}
    assert got == dict(enumerate(texts.values()))


def test_pii_discovers_unseen(spark):
    """Addresses that no rule knows stand where seeds stand and look like them."""
    rows = [(i, f"reach me at contact user{i}@example.org today") for i in range(30)] + [(100 + i, f"reach me at contact user2{i}@example.o2g today") for i in range(3)]
    found = pii.find_identifiers(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("not seed").collect()
    assert {r.doc_id for r in found} == {100, 101, 102} and {r.kind for r in found} == {"email"}




def grams(text: str, n: int = 5) -> set[str]:
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()


def brute_links(texts: list[str]) -> tuple[dict, dict]:
    """The links of distinct sets, told by their first text, and the set of each text."""
    sets = [frozenset(grams(t)) for t in texts]
    first: dict = {}
    for k, x in enumerate(sets):
        first.setdefault(x, k)
    want = {}
    for a, b in itertools.combinations(sorted(first.values()), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= jaccard_join.THRESHOLD:
            want[a, b] = round(j, 9)
    return want, {k: first[x] for k, x in enumerate(sets)}


def test_jaccard_recall(spark):
    """At least 0.98 of the links, none that isn't one, every index exact; blocks change nothing; classes follow from the links."""
    r = random.Random(5)
    texts = []
    for g in range(60):
        base = prose(1000 + g, r.randrange(20, 400)).split()
        for _ in range(r.randrange(1, 7)):
            texts.append(" ".join(w if r.random() > 0.04 else r.choice(WORDS) for w in base[r.randrange(5) :]))
    want, sets = brute_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    links = lambda **kw: {(x.set_a, x.set_b): round(x.jaccard, 9) for x in jaccard_join.jaccard_links(docs, **kw).collect()}
    got = links()
    assert all(want.get(k) == v for k, v in got.items())
    assert len(got) >= 0.98 * len(want) > 50
    assert links(block=7) == got
    label = {k: k for k in set(sets.values())}
    for _ in label:
        for a, b in got:
            label[a] = label[b] = min(label[a], label[b])
    rows = {x.doc_id: (x.set_id, x.class_id, x.links) for x in jaccard_join.jaccard_classes(docs).collect()}
    assert rows == {k: (s, label[s], sum(s in pair for pair in got)) for k, s in sets.items()}


def near_threshold() -> list[str]:
    """Copies with so many words changed that about half of the pairs still meet the threshold, of texts of many lengths."""
    r = random.Random(21)
    texts = []
    for g in range(250):
        base = prose(20000 + g, r.choice((12, 40, 130, 300, 900))).split()
        texts += [" ".join(w if r.random() > 0.065 else r.choice(WORDS) for w in base) for _ in range(3)]
    return texts


def test_jaccard_loses_no_link(spark):
    """Every link of pairs near the threshold is there, with its exact index, whatever the blocks."""
    texts = near_threshold()
    want, _ = brute_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block in (2048, 60):
        got = {(x.set_a, x.set_b): round(x.jaccard, 9) for x in jaccard_join.jaccard_links(docs, block=block).collect()}
        assert got == want and 200 < len(want) < 700


def test_jaccard_short_texts_of_shared_passages(spark):
    """Short texts made of passages that many texts share: no set size is missed."""
    r = random.Random(9)
    passages = [prose(7000 + k, r.randrange(8, 24)) for k in range(25)]
    texts = [" ".join(r.choice(passages) for _ in range(r.randrange(1, 5))) + " " + prose(9000 + k, r.randrange(1, 9)) for k in range(300)]
    want, _ = brute_links(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(x.set_a, x.set_b): round(x.jaccard, 9) for x in jaccard_join.jaccard_links(docs).collect()}
    assert all(want.get(k) == v for k, v in got.items()) and len(got) >= 0.99 * len(want) > 500


def test_tree_join_equals_brute_force():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        sets += [np.unique(base[rng.random(120) < p]) for p in (0.9, 0.7, 0.5)]
    sets.sort(key=len)
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.35}
    assert {(int(a), int(b)) for i, j, _ in jaccard_join.tree_join(sets, None, 0.35) for a, b in zip(i, j)} == want




def brute_lists(texts: list[str], seeds: list[int], most: int) -> dict:
    """(seed, text): score of the best of all texts, seeds apart, for each seed, by dictionaries."""
    words = [re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower()) for t in texts]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df: dict[str, int] = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for s in seeds:
        score = {}
        for d in set(range(n)) - set(seeds):
            x = 0.0
            for t in set(words[s]):
                tf = words[d].count(t)
                x += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[d]) / mean))
            score[d] = x
        out |= {(s, d): score[d] for d in sorted(score, key=lambda d: (-score[d], d))[:most] if score[d] > 0}
    return out


def brute_pack(texts: list[str], seeds: list[int], window: int, most: int) -> list[list[int]]:
    size = [len(t.split()) for t in texts]
    live, room, out = brute_lists(texts, seeds, most), {s: window - size[s] for s in seeds}, {s: [] for s in seeds}
    live = {k: v for k, v in live.items() if size[k[1]] <= room[k[0]]}
    while live:
        won: dict = {}
        for (s, d), x in live.items():
            won[d] = max(won.get(d, (-1, 0)), (round(x, 4), -s))
        for d, (x, s) in sorted(won.items(), key=lambda w: (-w[1][0], w[0])):
            if size[d] <= room[-s]:
                out[-s].append((-x, d))
                room[-s] -= size[d]
        used = {d for own in out.values() for _, d in own}
        live = {(s, d): x for (s, d), x in live.items() if d not in used and size[d] <= room[s]}
    return [[s, *(d for _, d in sorted(own))] for s, own in out.items()]


def test_packing_equals_brute_force(spark):
    """The lists come from the whole corpus, over several shards and blocks of seeds, and pieces go to seeds in turns."""
    texts = [prose(i % 37, 20 + i * 7 % 50) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    at = {r.uid: r.doc_id for r in packing.documents(docs).mapInArrow(packing._cut(128, 20, 8), packing.PIECES).collect()}
    order = [at[u] for u in sorted(at)]  # ties go by the order of the rows
    texts = [texts[i] for i in order]
    seeds = [k for k, i in enumerate(order) if i % 20 == 0]
    rows = packing.pack_documents(docs, window=128, most=6, seeds=5).collect()
    got = {tuple(r.doc_ids) for r in rows if r.kind == "retrieved"}
    assert got == {tuple(order[k] for k in w) for w in brute_pack(texts, seeds, 128, 6)}
    assert all(r.n_words <= 128 and sum(r.words) == r.n_words for r in rows)
    assert sorted(i for r in rows for i in r.doc_ids) == list(range(240))


def test_packing_search_memory_is_bounded_before_bounds_are_set(monkeypatch):
    """Long pieces are scored for all seeds of another group, in parts of a fixed size, with the same result as at once."""
    r = np.random.default_rng(1)
    n_seeds, vocabulary = 2000, 30_000
    own = [np.arange(100), np.arange(100, 200)]  # words that all texts of a group have
    words = [np.concatenate([own[k % 2], 200 + r.choice(vocabulary, 60, False)]).astype(np.uint64) for k in range(n_seeds)]
    df = np.where(np.arange(200 + vocabulary) < 200, 1000, 20)
    term = np.concatenate(words)
    q = packing.Queries(np.repeat(np.arange(n_seeds), 160), term, df[term], 2000)
    assert len(q.centre) == 2
    texts = [np.sort(np.concatenate([own[k % 2], 200 + r.choice(vocabulary, 1500, False)])).astype(np.uint64) for k in range(120)]
    terms = pa.array([((t << np.uint64(11)) | np.uint64(1)).tobytes() for t in texts], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000, 5120)), pa.array(np.full(120, 1600, np.int32)), terms], ["uid", "tail", "terms"])
    run = packing._search(type("Held", (), {"value": q}), 1600.0, 150)

    def found():
        tracemalloc.start()
        rows = sorted(x for b in run(iter([batch])) for x in zip(*(b.column(c).to_pylist() for c in ("seed", "uid"))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, peak

    rows, peak = found()
    monkeypatch.setattr(packing, "CELLS", 1 << 40, raising=False)
    at_once, more = found()
    assert rows == at_once and len(rows) > n_seeds * 60 and more - peak > 50e6


def test_packing_fills_small_lists_without_tables_for_turns(spark, monkeypatch):
    """Each file that an executor writes takes a process and memory: small lists are filled in one task, with the result of many turns."""
    r = random.Random(5)
    size = [r.randrange(1, 60) for _ in range(300)]
    pairs = [(20 * s, 1000 + u, r.randrange(1, 40) / 4, size[u]) for s in range(40) for u in r.sample(range(300), 32)]  # many ties
    lists = spark.createDataFrame(pairs, "seed bigint, uid bigint, score double, tail int").repartition(3)
    rooms = spark.createDataFrame([(20 * s, r.randrange(1, 250)) for s in range(40)], "seed bigint, room int")
    names, plain = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: names.append(name) or plain(df, name))
    got = sorted(map(tuple, packing.assigned(lists, rooms).collect()))
    assert not names
    assert got == sorted(map(tuple, packing.assigned(lists, rooms, few=len(pairs) - 1).collect())) and names.count("pack-taken") > 2
    room = dict(map(tuple, rooms.collect()))
    assert all(sum(x[3] for x in got if x[0] == s) <= room[s] for s in room) and len({x[1] for x in got}) == len(got) > 100


def test_packing_search_skips_other_groups_without_loss(spark, monkeypatch):
    """Texts of two vocabularies and mixed ones: seeds form groups, bounds drop pairs of a piece and a seed of another, and no list changes."""
    r = random.Random(3)
    other = [w[::-1] for w in WORDS]
    texts = []
    for i in range(400):
        words = [w for k in range(r.randrange(15, 90)) for w in (r.choice(WORDS), r.choice(WORDS) + str(r.randrange(60)))]
        if i % 2:
            swap = 1.0 if i % 10 else 0.5
            words = [other[0] + w if r.random() < swap and w[-1:].isdigit() else r.choice(other) if r.random() < swap else w for w in words]
        texts.append(" ".join(words))
    ids = [20 * i + (i % 3) for i in range(400)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").coalesce(1)
    pieces = packing.documents(docs).mapInArrow(packing._cut(2048, 20, 8), packing.PIECES).cache()
    at = {x.uid: ids.index(x.doc_id) for x in pieces.collect()}
    seeds = [k for k, i in enumerate(ids) if i % 20 == 0]
    want = brute_lists(texts, seeds, 4)
    made, plain = [], packing._grouped
    monkeypatch.setattr(packing, "_grouped", lambda *a: made.append(plain(*a)) or made[-1])
    got = {(at[x.seed], at[x.uid]): x.score for x in packing.neighbours(pieces, 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-2 for k in got)
    assert len(made[0]) == 2


def test_packing_long_document_whole(spark):
    text = prose(1, 1000)
    rows = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), window=300).collect()
    pieces = sorted((a, b) for r in rows for a, b in zip(r.starts, r.ends))
    assert "".join(text[a:b] for a, b in pieces) == text and sum(r.n_words for r in rows) == 1000


def test_packing_without_seeds_or_neighbours(spark):
    docs = spark.createDataFrame([(2 * i + 1, prose(i)) for i in range(50)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, window=256).collect()
    assert sorted(i for r in rows for i in r.doc_ids) == list(range(1, 100, 2)) and {r.kind for r in rows} == {"rest"}
    alone = packing.pack_documents(spark.createDataFrame([(20, "one two"), (1, "three four")], "doc_id bigint, text string")).collect()
    assert sorted((r.kind, tuple(r.doc_ids)) for r in alone) == [("rest", (1,)), ("retrieved", (20,))]


TRICKY = ["", " ", "a", "  two  spaces ", "tab\tnew\n\nline \r\n x", "don't we'll I'M", "x" * 5000, "1" * 3000, "é" * 3000, "a b c　d", "\U0001f600\U0001f468‍\U0001f469 ok", "<|endoftext|> plain", "ab12cd!!??" * 200, "\n" * 50 + "z", "\u0085 x y"]


def test_bpe_equals_library(spark):
    v = tokens.Vocabulary(tokens.VOCABULARY)
    texts = TRICKY + [prose(i, 200) for i in range(20)] + ["".join(random.Random(i).choices("ab 1.\n\té 'sX", k=400)) for i in range(60)]
    flat, at = tokens.encoded(pa.array(texts), v, {})
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == v.encode(t), repr(t[:60])
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc_id bigint, text string")
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs)).collect()}
    assert back == {**dict(enumerate(texts)), 999: None}


def test_counts_equal_whole_encoding(spark):
    v = tokens.Vocabulary(tokens.VOCABULARY)
    texts = [*TRICKY, prose(3, 3000), "y" * 9000 + " " + prose(4, 300), (" " * 700 + "q") * 20, "日本語テキスト" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = tokens.count_tokens(docs, huge=500, overlap=20).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: len(v.encode(t)) for k, t in enumerate(texts)}
    assert max(r.widened for r in rows) > 0 and max(r.chunks for r in rows) > 10




def test_like_pairs_equal_brute_force(spark):
    r = random.Random(8)
    texts = []
    for g in range(20):
        base = prose(g, 400).split()
        texts += [" ".join(w if r.random() > p else "zz" for w in base) for p in (0, 0, 0.002, 0.004)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = {x.doc_id: x for x in fingerprint.digests(docs).collect()}
    same = {}
    for i, x in own.items():
        same.setdefault((x.digest, x.q1_ratio, x.q2_ratio, x.length_code), []).append(i)
    want = {(min(g), i): 0 for g in same.values() for i in g if i != min(g)}
    arrays = lambda x: {c: np.array([x[c]]) for c in fingerprint._COLUMNS}
    for a, b in itertools.combinations(sorted(min(g) for g in same.values()), 2):
        d = int(fingerprint.difference(arrays(own[a]), arrays(own[b]))[0])
        if d <= fingerprint.MOST:
            want[a, b] = d
    assert {(x.doc_a, x.doc_b): x.difference for x in fingerprint.like_pairs(docs).collect()} == want
    assert any(v > 0 for v in want.values())


def test_like_pairs_query_covers_the_table(spark, data):
    """The registered query gives every pair of the table that brute force does, with the digests."""
    from loomrank.llm import registry

    own = {x.doc_id: x for x in registry.QUERIES["op2_quartile_digest"](spark, data).collect() if x.digest}
    same = {}
    for i, x in own.items():
        same.setdefault(tuple(x[c] for c in fingerprint._COLUMNS), []).append(i)
    least = sorted(min(g) for g in same.values())
    want = {(min(g), i): 0 for g in same.values() for i in g if i != min(g)}
    a, b = map(list, zip(*itertools.combinations(least, 2)))
    sides = [{c: np.array([own[i][c] for i in s]) for c in fingerprint._COLUMNS} for s in (a, b)]
    want |= {(i, j): int(d) for i, j, d in zip(a, b, fingerprint.difference(*sides)) if d <= fingerprint.MOST}
    got = {(x.doc_a, x.doc_b): (x.difference, x.digest_a, x.digest_b) for x in registry.QUERIES["op2_like_pairs"](spark, data).collect()}
    assert got == {(i, j): (d, own[i].digest, own[j].digest) for (i, j), d in want.items()} and want




def _held_out(spark, data: str, label: str):
    d = spark.read.parquet(f"{data}/documents.parquet").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").orderBy("doc_id").toPandas()
    return d[::2], d[1::2], d[1::2][label].to_numpy()


def test_quality_held_out(spark):
    fit, rest, y = _held_out(spark, "/root/testdata/sf0.01", "quality")
    p = quality.probabilities(pa.array(rest.text.tolist()), quality.train(fit.text.tolist(), fit.quality.tolist()))
    assert ((p >= 0.5) == y).mean() > 0.85 and (p[y == 1] < quality.REJECT).mean() < 0.05


def test_quality_calibrated_at_the_rates_of_all_labels(spark):
    """A sample with as many bad as good labels doesn't change the probabilities: 6 of 7 are good, and texts don't tell which."""
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(700)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(700)], "doc_id bigint, quality int")
    texts = pa.array([prose(i, 30) for i in range(5000, 5100)])
    for most in (80, 1200):
        assert abs(quality.probabilities(texts, quality.fit(docs, known, most)).mean() - 6 / 7) < 0.1


def test_toxicity_held_out(spark):
    """Some labels are wrong: of documents labelled toxic nearly a half have no toxic word; clean ones stay."""
    fit, rest, y = _held_out(spark, "/root/testdata/sf0.1", "toxic")
    m = toxicity.train(fit.text.tolist(), fit.toxic.tolist())
    toxic = toxicity.Scorer(m)(pa.array(rest.text.tolist()))[0] >= m.threshold
    assert toxic[y == 1].mean() > 0.5 and toxic[y == 0].mean() < 0.005


def test_toxic_dictionary_is_trained(spark):
    """Both dictionaries are zstandard's own, and hold what recurs on one side only."""
    r = random.Random(1)
    texts = [prose(i, 120) + (" you wretched gibbering toad " if i % 2 else " ") + prose(i + 5000, r.randrange(20, 60)) for i in range(400)]
    m = toxicity.train(texts, [i % 2 for i in range(400)])
    assert m.ordinary[:4] == m.toxic[:4] == b"7\xa40\xec" and b" toad" in m.toxic and b" toad" not in m.ordinary
    assert m.held_out[0] > 0.95 and m.held_out[1] < 0.05


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, prose(1)), (2, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.probability for r in quality.quality(docs, none).collect()} == {1: 1.0, 2: 0.0}
    assert not any(r.toxic for r in toxicity.toxicity(docs, none).collect())


def test_one_class_only(spark):
    docs = spark.createDataFrame([(1, prose(1)), (2, "")], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.probability for r in quality.quality(docs, one).collect()} == {1: 1.0, 2: 0.0}
    assert not any(r.toxic for r in toxicity.toxicity(docs, one).collect())




def test_licence_variants(spark):
    rows = [(1, "x licensed under the APACHE LICENSE version 2.0 y"), (2, "Licensed under the Apache Lice nse"), (3, "Released under the MIT License. " * 3), (4, "mit license")]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.licence) for r in got) == [(1, "Apache-2.0"), (3, "MIT"), (3, "MIT"), (3, "MIT")]


def test_reply_trees(spark):
    rows = [
        (1, "a", None, "user", "hi", 1.0), (1, "b", "a", "assistant", "x", 3.0), (1, "c", "a", "assistant", "y", 5.0), (1, "d", "c", None, None, None), (1, "b", "a", "assistant", "x", 3.0),
        (2, "a", "gone", "user", "orphan", 1.0), (2, "p", "q", "user", "cycle", 1.0), (2, "q", "p", "user", "cycle", 1.0), (3, "s", "s", "user", "self", 1.0), (None, "z", None, "user", "t", 1.0), (4, None, None, "user", "t", 1.0),
    ]
    m = spark.createDataFrame(rows, "tree bigint, message string, parent string, role string, text string, score double")
    got = {(r.tree, r.branch): (r.path, r.score) for r in chat.reply_paths(m, None).collect()}
    assert got == {(1, 1): ("a>c>d", 2.0), (1, 2): ("a>b", 2.0), (2, 1): ("a", 1.0), (3, 1): ("s", 1.0)}
    first = chat.reply_paths(m, 1).filter("tree = 1").first()
    assert first.conversation == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n<|im_start|>user\n<|im_end|>\n"


def test_chat_odd_turns(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, tree int"
    rows = [(1, 0, "user", "q", 9), (1, 1, "assistant", "a", 9), (1, 2, "assistant", "longer answer", 9), (2, 0, None, None, 9), (None, 1, "user", "x", 9), (3, None, "user", "x", 9), (1, 0, "user", "q", 9)]
    t = spark.createDataFrame(rows, kind)
    got = chat.reply_paths(chat.reply_parents(t), None).collect()
    assert sorted((r.tree, r.branch, r.n_messages) for r in got) == [(1, 1, 2), (1, 2, 2), (2, 1, 1)]
    assert chat.reply_paths(chat.reply_parents(t.limit(0))).count() == 0


def test_reply_trees_deep_and_long(spark):
    """Long chains, branches off them, and texts far beyond a few thousand characters, whole and ranked by their length."""
    rows = [(1, f"{k:04}", f"{k - 1:04}" if k else None, "user", f"t{k}", 1.0) for k in range(300)] + [(1, "x", "0150", "assistant", "z" * 100000, 9000.0)]
    m = spark.createDataFrame(rows, "tree bigint, message string, parent string, role string, text string, score double")
    got = {r.branch: r for r in chat.reply_paths(m, None).collect()}
    assert [got[1].n_messages, got[2].n_messages] == [152, 300] and got[2].path.split(">") == [f"{k:04}" for k in range(300)]
    assert len(got[1].conversation) > 100000
    turns = [(7, 0, "user", "q"), (7, 1, "assistant", "b" * 2500), (7, 2, "assistant", "a" * 9000)]
    best = chat.reply_paths(chat.reply_parents(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))).first()
    assert best.n_messages == 2 and "a" * 9000 in best.conversation
    spread = [(8, 5000 * k, "user" if k % 2 else "assistant", f"t{k}") for k in range(6)]
    one = chat.reply_paths(chat.reply_parents(spark.createDataFrame(spread, "conv_id bigint, turn bigint, role string, text string")), None).collect()
    assert [r.n_messages for r in one] == [6]


def test_decode_empty_table(spark):
    assert tokens.decode(spark.createDataFrame([], "doc_id bigint, ids array<int>")).count() == 0
