"""Lexical retrieval packing: training windows of documents that BM25 finds alike.

Pieces.  A document longer than ``window`` words is cut: full pieces are windows of their own, its last piece is packed.  Last
pieces are what is indexed, searched and packed; a document that ends with a full piece has none.

Search.  The seeds are the pieces of all documents whose id is divisible by ``SEED_EVERY``.  A seed's query is its
distinct words, and its neighbours are the ``NEIGHBOURS`` pieces of the whole corpus, seeds apart, with the best positive
BM25 score (ties: the earlier row).  Document frequencies, the number of pieces and their mean length are counted over the
whole corpus.  The search is exact: pieces are dealt to shards, each shard scores all its pieces for all seeds and gives
its best, and these are merged.  Seeds come in blocks of about ``SEEDS``, so what is broadcast is bounded.  Seeds that share
common words form groups, languages say.  In a shard a piece is scored for the seeds of its own group, common words by a
matrix product, the others by the inverted lists; it is scored for a seed of another group unless a bound on its score,
from the greatest weight of each word among the pieces at hand, shows that it can't be one of the seed's best.

Filling.  In turns each unused piece goes to the seed that scores it best, of those it still fits (ties: the earlier
seed), and each seed takes what it gets in order of score as long as it fits, until no seed can take any more.  Up to ``FEW``
neighbours one task takes all turns in memory; more are joined and written turn by turn, with the same result.  What no
seed took is packed in the order of a lexical key, the least hash among a piece's words of ``LONG`` letters or more (of all if it
has none), so that copies and documents with passages in common tend to meet: each into the first of ``OPEN`` windows that it fits.

A window is a row: kind ('whole', 'retrieved' or 'rest'), seed (its first document), ids, character range and words of
each piece, BM25 score of each (0 for the seed, and outside 'retrieved'), words in all.  Each document with words lies in the
windows exactly once, whole.

Nulls: a null, empty or wordless text is in no window.  A null id is packed and is no seed; repeated rows are packed each
by itself.  Very long texts are cut as said.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import FEW, discard, documents, small_batches, table, written
from ._text import Words, blocks, mix, release

WINDOW, LONG, SEED_EVERY, NEIGHBOURS, SEEDS, OPEN = 2048, 8, 20, 32, 8192, 32
K1, B = 1.2, 0.75
DENSE, TOGETHER, CELLS = 0.003, 64, 1 << 21
GROUPS, ALIKE, KINDS = 8, 0.5, 256
PIECES = "uid bigint, doc_id bigint, seed boolean, key bigint, n_words int, tail int, cuts array<int>, terms binary"
WINDOWS = "kind string, seed bigint, doc_ids array<bigint>, starts array<int>, ends array<int>, words array<int>, scores array<double>, n_words int"
_TF = np.uint64(2047)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers first[i] ... first[i] + size[i] - 1 of all i."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def _cut(window: int, every: int, long: int):
    """A row for each document with words.  ``terms``: of each distinct word of the last piece 53 bits of hash and 11 of count."""

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for batch in blocks(batches, most=1 << 20):
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                w = Words(part.column("text"))
                size = np.diff(w.first)
                n = len(size)
                tail = size % window
                at = _ranges(w.first[1:] - tail, tail)
                of = np.repeat(np.arange(n, dtype=np.uint64), tail)
                key = np.sort((of << np.uint64(53)) | (w.hash[at] >> np.uint64(11)))
                new = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
                tf = np.minimum(np.diff(new, append=len(key)), 2047).astype(np.uint64)
                key = key[new]
                edge = np.searchsorted(key >> np.uint64(53), np.arange(n + 1, dtype=np.uint64))
                terms = (key << np.uint64(11)) | tf
                low = np.zeros(n, np.uint64)
                some = np.flatnonzero(tail)
                if len(some):
                    h = mix(w.hash[at] ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(2)
                    h |= ((w.end[at] - w.start[at]) < long).astype(np.uint64) << np.uint64(62)  # long words first
                    low[some] = np.minimum.reduceat(h, np.concatenate([[0], np.cumsum(tail[some])[:-1]]))
                chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                begin = chars[w.offsets]
                cuts = []
                for i in range(n):
                    inner = w.start[w.first[i] + np.arange(window, size[i], window)] if size[i] > window else np.zeros(0, np.int64)
                    cuts.append(np.concatenate([[0], chars[inner] - begin[i], [begin[i + 1] - begin[i]]]).astype(np.int32))
                ids = part.column("doc_id")
                seed = (ids.fill_null(1).to_numpy() % every == 0) & (tail > 0)
                data = terms.tobytes()
                columns = [
                    pa.array(uid + np.arange(n)), ids, pa.array(seed), pa.array(low.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(tail.astype(np.int32)),
                    pa.array(cuts, pa.list_(pa.int32())), pa.array([data[8 * a : 8 * b] for a, b in zip(edge, edge[1:])], pa.binary()),
                ]
                uid += n
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "seed", "key", "n_words", "tail", "cuts", "terms"]).filter(pa.array(size > 0))

    return run


def _terms(column) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all rows, and how many each has."""
    size = np.array([len(x.as_buffer()) // 8 for x in column], np.int64)
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint64), size


def _counted(batches):
    """(term, n): in how many pieces of the split a word stands."""
    held, total = [], 0

    def flush():
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        for a in range(0, len(terms), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], ["term", "n"])

    for batch in batches:
        if batch.num_rows:
            held.append(_terms(batch.column("terms"))[0] >> np.uint64(11))
            total += len(held[-1])
            if total >= 1 << 22:
                yield from flush()
                held, total = [], 0
    if held:
        yield from flush()
    release()


def _exploded(batches):
    for batch in batches:
        if batch.num_rows:
            terms, size = _terms(batch.column("terms"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("uid").to_numpy(), size)), pa.array((terms >> np.uint64(11)).view(np.int64))], ["uid", "term"])


def _grouped(matrix: np.ndarray, groups: int) -> np.ndarray:
    """Directions of at most ``groups`` kinds of rows (languages, say): rows that stand for most others, then spherical means; alike ones are merged."""
    rows = matrix[matrix.any(1)]
    if not len(rows):
        return np.zeros((1, matrix.shape[1]), np.float32)
    rows = rows / np.linalg.norm(rows, axis=1)[:, None]
    some = rows[:: max(1, len(rows) // 512)]
    alike = rows @ some.T
    best, centre = np.zeros(len(rows), np.float32), []
    for _ in range(groups):
        gain = np.maximum(alike - best[:, None], 0).sum(0)
        k = int(np.argmax(gain))
        if gain[k] < 0.01 * len(rows):
            break
        centre.append(some[k])
        best = np.maximum(best, alike[:, k])
    centre = np.array(centre, np.float32)
    for _ in range(4):
        own = np.argmax(rows @ centre.T, 1)
        means = [rows[own == k].sum(0) for k in range(len(centre)) if (own == k).any()]
        centre = np.array([m / np.linalg.norm(m) for m in means], np.float32)
    kept: list[np.ndarray] = []
    size = np.bincount(np.argmax(rows @ centre.T, 1), minlength=len(centre))
    for k in np.argsort(-size, kind="stable"):
        if all(centre[k] @ c < ALIKE for c in kept):
            kept.append(centre[k])
    return np.array(kept, np.float32)


class Queries:
    """A block of seeds: ``uid``, and by word ``terms``, its weight ``idf`` and the seeds ``seed[at[v]:at[v + 1]]`` that have it.

    Seeds are numbered by group: group g has ``edge[g]`` to ``edge[g + 1]``, and the part of a word's list from ``cut[v, g]`` to ``cut[v, g + 1]``.
    Column ``slot[g][v]`` of the matrix of a group is for a word that is common there; ``words[first[s]:first[s + 1]]`` are those of seed s.
    """

    def __init__(self, uid: np.ndarray, term: np.ndarray, df: np.ndarray, n: int, groups: int = GROUPS):
        self.uid, own = np.unique(uid, return_inverse=True)
        s = len(self.uid)
        order = np.lexsort((own, term))
        own, term, df = own[order], term[order], df[order]
        new = np.flatnonzero(np.concatenate([term[:1] == term[:1], term[1:] != term[:-1]]))
        self.terms, at, df = term[new], np.append(new, len(term)), df[new]
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        v = np.repeat(np.arange(len(new)), np.diff(at))
        rate = np.diff(at) / max(1, s)
        self.common = np.flatnonzero(rate * (df / n) > DENSE)
        self.common = self.common[np.argsort(-rate[self.common], kind="stable")[:KINDS]]
        column = np.full(len(new), -1)
        column[self.common] = np.arange(len(self.common))
        matrix = np.zeros((s, len(self.common)), np.float32)
        some = column[v] >= 0
        matrix[own[some], column[v[some]]] = self.idf[v[some]]
        self.centre = _grouped(matrix, groups)
        group = np.argmax(matrix @ self.centre.T, 1)
        order = np.argsort(group, kind="stable")
        self.uid, place = self.uid[order], np.argsort(order, kind="stable")
        self.edge = np.searchsorted(group[order], np.arange(len(self.centre) + 1))
        own = place[own]
        order = np.lexsort((own, v))
        self.seed, v = own[order].astype(np.int32), v[order]
        self.cut = np.searchsorted(v * s + self.seed, np.arange(len(new))[:, None] * s + self.edge).astype(np.int32)
        share = np.diff(self.cut, axis=1) / np.maximum(np.diff(self.edge), 1)
        self.slot = [np.where(c, np.cumsum(c) - 1, -1).astype(np.int32) for c in (share * share > DENSE).T]
        order = np.lexsort((v, self.seed))
        self.words, self.first = v[order].astype(np.int32), np.searchsorted(self.seed[order], np.arange(s + 1))

    def matrix(self, g: int) -> np.ndarray:
        out = np.zeros((self.edge[g + 1] - self.edge[g], int(self.slot[g].max(initial=-1)) + 1), np.float32)
        v = np.flatnonzero(self.slot[g] >= 0)
        size = self.cut[v, g + 1] - self.cut[v, g]
        out[self.seed[_ranges(self.cut[v, g], size)] - self.edge[g], np.repeat(self.slot[g][v], size)] = 1
        return out


def _search(queries, mean: float, most: int):
    """The best pieces of a shard for each seed: (seed, uid, score, tail).

    The pieces of a batch are dealt to the groups of the seeds.  A piece is scored for all seeds of its own group, and for those of the
    others that ``TOGETHER`` pieces at once may still give one of the best: by the sum of the greatest weight of each word.
    """

    def run(batches):
        q: Queries = queries.value
        s, groups = len(q.uid), len(q.centre)
        matrices = [q.matrix(g) for g in range(groups)]
        elsewhere = [np.diff(q.cut[:, [0, -1]], axis=1)[:, 0] > q.cut[:, g + 1] - q.cut[:, g] for g in range(groups)]
        least = np.full(s, 1e-6, np.float32)
        begun: list = [[] for _ in range(groups)]  # the scores of the first pieces, whose best set the first bounds
        held, n_held = [], 0
        row = np.full(len(q.terms), -1, np.int32)  # of a word among those of the pieces at hand
        among = np.full(len(q.terms), -1)
        among[q.common] = np.arange(len(q.common))

        def best():
            """The best of what is held; sets the scores that newcomers must reach."""
            own, uid, score, tail = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((uid, -score, own))
            own = own[order]
            first = np.searchsorted(own, np.arange(s + 1))
            keep = np.arange(len(own)) - first[own] < most
            full = np.flatnonzero(np.diff(first) >= most)
            least[full] = score[order[first[full] + most - 1]]
            order = order[keep]
            return own[keep], uid[order], score[order], tail[order]

        def hold(seeds, score, uid, tail):
            nonlocal held, n_held
            bound = least[seeds]
            i, j = np.divmod(np.flatnonzero((score >= bound[:, None]).ravel()), score.shape[1])
            held.append((seeds[i].astype(np.int32), uid[j], score[i, j], tail[j]))
            n_held += len(i)
            if n_held > 2 * s * most:
                held = [best()]
                n_held = len(held[0][0])

        def begin(g):
            """Bounds for the seeds of a group from its first pieces."""
            parts, begun[g] = begun[g], None
            score, uid, tail = (np.concatenate([x[k] for x in parts], int(k == 0)) for k in range(3))
            own = np.arange(q.edge[g], q.edge[g + 1])
            if score.shape[1] >= most:
                least[own] = np.maximum(least[own], np.partition(score, score.shape[1] - most, 1)[:, score.shape[1] - most])
            hold(own, score, uid, tail)

        def inside(g, d, v, x, n):
            """Scores of n pieces for the seeds of their group."""
            slot = q.slot[g][v]
            common = slot >= 0
            right = np.zeros((matrices[g].shape[1], n), np.float32)
            right[slot[common], d[common]] = x[common]
            score = matrices[g] @ right
            d, v, x = d[~common], v[~common], x[~common]
            size = q.cut[v, g + 1] - q.cut[v, g]
            cell = (q.seed[_ranges(q.cut[v, g], size)] - np.int32(q.edge[g])) * np.int32(n) + np.repeat(d.astype(np.int32), size)
            np.add.at(score.reshape(-1), cell, np.repeat(x, size))
            return score

        def outside(g, d, v, x, n):
            """The seeds of other groups that these pieces may be among the best of, and their scores."""
            asked = np.flatnonzero(elsewhere[g][v])
            if not len(asked):
                return asked, None
            asked = asked[np.argsort(v[asked], kind="stable")]
            d, v, x = d[asked], v[asked], x[asked]
            new = np.flatnonzero(np.diff(v, prepend=-1))
            u, top = v[new], np.maximum.reduceat(x, new)
            bound = np.zeros(s)
            for a, b in ((0, g), (g + 1, groups)):
                if q.edge[b] > q.edge[a]:
                    size = q.cut[u, b] - q.cut[u, a]
                    bound += np.bincount(q.seed[_ranges(q.cut[u, a], size)], np.repeat(top, size), minlength=s)
            seeds = np.flatnonzero(bound >= np.maximum(least * 0.9999 - 1e-2, 1e-6))
            if not len(seeds):
                return seeds, None
            row[u] = np.arange(len(u))
            right = np.zeros((len(u), n), np.float32)
            right[row[v], d] = x
            score = np.empty((len(seeds), n), np.float32)
            step = max(1, CELLS // len(u))  # before bounds are set these may be all seeds
            for a in range(0, len(seeds), step):
                own = seeds[a : a + step]
                size = q.first[own + 1] - q.first[own]
                at = row[q.words[_ranges(q.first[own], size)]]
                matrix = np.zeros((len(own), len(u)), np.float32)
                matrix[np.repeat(np.arange(len(own)), size)[at >= 0], at[at >= 0]] = 1
                score[a : a + step] = matrix @ right
            row[u] = -1
            return seeds, score

        for batch in batches:
            if not batch.num_rows:
                continue
            uids, tails = batch.column("uid").to_numpy(), batch.column("tail").to_numpy()
            flat, size = _terms(batch.column("terms"))
            term, tf = flat >> np.uint64(11), (flat & _TF).astype(np.float64)
            v = np.minimum(np.searchsorted(q.terms, term), len(q.terms) - 1)
            hit = np.flatnonzero(q.terms[v] == term)
            doc, v, tf = np.repeat(np.arange(len(uids)), size)[hit], v[hit], tf[hit]
            weight = (q.idf[v] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tails[doc] / mean))).astype(np.float32)
            near = np.zeros((len(uids), len(q.common)), np.float32)
            some = among[v] >= 0
            near[doc[some], among[v[some]]] = q.idf[v[some]]
            kind = np.argmax(near @ q.centre.T, 1)
            place = np.empty(len(uids), np.int64)
            order = np.lexsort((-tails, kind))
            place[order] = np.arange(len(uids))
            uids, tails, kind, doc = uids[order], tails[order], kind[order], place[doc]
            order = np.argsort(doc, kind="stable")
            doc, v, weight = doc[order], v[order], weight[order]
            parts = []
            for g in range(groups):
                lo, hi = np.searchsorted(kind, [g, g + 1])
                parts += [(g, a, min(a + TOGETHER, hi)) for a in range(lo, hi, TOGETHER)]
            parts = [(g, lo, hi, *np.searchsorted(doc, [lo, hi])) for g, lo, hi in parts]
            for g, lo, hi, a, b in parts:
                if q.edge[g] == q.edge[g + 1]:
                    continue
                score = inside(g, doc[a:b] - lo, v[a:b], weight[a:b], hi - lo)
                if begun[g] is None:
                    hold(np.arange(q.edge[g], q.edge[g + 1]), score, uids[lo:hi], tails[lo:hi])
                    continue
                begun[g].append((score, uids[lo:hi], tails[lo:hi]))
                if sum(len(x[1]) for x in begun[g]) >= 4 * most:
                    begin(g)
            for g in range(groups):
                if begun[g] and sum(len(x[1]) for x in begun[g]) >= most:
                    begin(g)
            if groups > 1:
                for g, lo, hi, a, b in parts:
                    seeds, score = outside(g, doc[a:b] - lo, v[a:b], weight[a:b], hi - lo)
                    if len(seeds):
                        hold(seeds, score, uids[lo:hi], tails[lo:hi])
        for g in range(groups):
            if begun[g]:
                begin(g)
        if held:
            own, uid, score, tail = best()
            for a in range(0, len(own), 1 << 16):
                k = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(q.uid[own[k]]), pa.array(uid[k]), pa.array(np.round(score[k].astype(np.float64), 4)), pa.array(tail[k])], ["seed", "uid", "score", "tail"])
        release()

    return run


def neighbours(pieces: DataFrame, most: int = NEIGHBOURS, seeds: int = SEEDS) -> DataFrame:
    """(seed, uid, score, tail): the ``most`` best pieces of the whole corpus for each seed, by the rows' uid."""
    spark = pieces.sparkSession
    tails = pieces.filter("tail > 0")
    n, total, n_seeds = tails.agg(F.count("*"), F.sum("tail"), F.count(F.when(F.col("seed"), 1))).first()
    kind = "seed bigint, uid bigint, score double, tail int"
    if not n_seeds:
        return spark.createDataFrame([], kind)
    df = written(tails.select("terms").mapInArrow(_counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).filter("n > 1"), "pack-words")
    asked = tails.filter("seed").select("uid", "terms")
    n_blocks = math.ceil(n_seeds / seeds)
    rest = tails.filter("not seed").select("uid", "tail", "terms").coalesce(2 * spark.sparkContext.defaultParallelism)
    found = []
    for k in range(n_blocks):
        own = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)) == k)
        rows = own.mapInArrow(_exploded, "uid bigint, term bigint").join(df, "term").select("uid", "term", "n").toArrow()
        if not rows.num_rows:
            continue
        uid, term, count = (rows.column(c).to_numpy() for c in ("uid", "term", "n"))
        queries = spark.sparkContext.broadcast(Queries(uid, term.view(np.uint64), count, n))
        del rows, uid, term, count
        release()
        found.append(written(rest.mapInArrow(_search(queries, total / n, most), kind), "pack-found"))
        queries.destroy()
    if not found:
        return spark.createDataFrame([], kind)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("seed").orderBy(F.desc("score"), "uid")
    every = written(every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place"), "pack-lists")
    discard(df, *found)
    return every


def _fill(batches):
    """Of rows (seed, uid, score, tail, room), sorted by seed and score, those that fit one after another."""
    at, room = None, 0
    for batch in batches:
        keep = []
        for seed, tail, free in zip(*(batch.column(c).to_pylist() for c in ("seed", "tail", "room"))):
            if seed != at:
                at, room = seed, free
            keep.append(tail <= room)
            room -= tail if tail <= room else 0
        yield batch.select(["seed", "uid", "score", "tail"]).filter(pa.array(keep, pa.bool_()))


def _fill_all(batches):
    """All turns over rows (seed, uid, score, tail, room), which must be all that there are."""
    parts = [[b.column(c).to_numpy() for c in ("seed", "uid", "score", "tail", "room")] for b in batches if b.num_rows]
    if not parts:
        return
    seed, uid, score, tail, room = (np.concatenate(c) for c in zip(*parts))
    del parts
    names, at, seed = np.unique(seed, return_index=True, return_inverse=True)
    room = room[at].astype(np.int64)
    live = np.lexsort((seed, -score, uid))  # the first row of a piece, of those left, has the seed that it goes to
    while len(live):
        won = live[np.flatnonzero(np.diff(uid[live], prepend=uid[live[0]] - 1))]
        won = won[np.lexsort((uid[won], -score[won], seed[won]))]
        keep = []
        for k, s, n in zip(won.tolist(), seed[won].tolist(), tail[won].tolist()):
            if n <= room[s]:
                room[s] -= n
                keep.append(k)
        keep = np.array(keep, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[seed[keep]]), pa.array(uid[keep]), pa.array(score[keep]), pa.array(tail[keep])], ["seed", "uid", "score", "tail"])
        live = live[~np.isin(uid[live], uid[keep]) & (tail[live] <= room[seed[live]])]
    release()


def assigned(lists: DataFrame, rooms: DataFrame, few: int = FEW) -> DataFrame:
    """(seed, uid, score, tail) of the pieces that seeds take, from the lists and (seed, room); see the module's text."""
    live, taken = lists.join(rooms, "seed").filter("tail <= room"), []
    if lists.count() <= few:
        return live.select("seed", "uid", "score", "tail", "room").repartition(1).mapInArrow(_fill_all, "seed bigint, uid bigint, score double, tail int")
    last = None
    while True:
        live = written(live, "pack-live")
        if last is not None:
            discard(last)
        last = live
        if live.isEmpty():
            break
        best = F.max(F.struct("score", F.negate("seed").alias("least"), "seed", "tail", "room")).alias("b")
        won = live.groupBy("uid").agg(best).select("b.seed", "uid", "b.score", "b.tail", "b.room")
        won = won.repartition("seed").sortWithinPartitions("seed", F.desc("score"), "uid")
        taken.append(written(won.mapInArrow(_fill, "seed bigint, uid bigint, score double, tail int"), "pack-taken"))
        used = taken[-1].groupBy("seed").agg(F.sum("tail").cast("int").alias("used"))
        live = live.join(taken[-1].select("uid"), "uid", "left_anti").join(used, "seed", "left")
        live = live.withColumn("room", F.col("room") - F.coalesce("used", F.lit(0))).drop("used").filter("tail <= room")
    out = last.select("seed", "uid", "score", "tail")
    for t in taken:
        out = out.unionByName(t)
    return out


def _next(window: int):
    """Windows from pieces (doc_id, tail, start, end) in order: each into the first open window that it fits."""

    def run(batches):
        open_: list[list] = []  # [words, pieces]

        def rows(done):
            columns = list(zip(*[("rest", p[0][0], *map(list, zip(*p)), [0.0] * len(p), n) for n, p in done]))
            i32, i64 = pa.int32(), pa.int64()
            kinds = [pa.string(), i64, pa.list_(i64), pa.list_(i32), pa.list_(i32), pa.list_(i32), pa.list_(pa.float64()), i32]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "seed", "doc_ids", "starts", "ends", "words", "scores", "n_words"])

        for batch in batches:
            done = []
            for doc, start, end, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "end", "tail"))):
                here = next((w for w in open_ if w[0] + tail <= window), None)
                if here is None:
                    here = [0, []]
                    open_.append(here)
                    if len(open_) > OPEN:
                        full = max(range(len(open_) - 1), key=lambda k: open_[k][0])
                        done.append(open_.pop(full))
                here[0] += tail
                here[1].append((doc, start, end, tail))
                if here[0] == window:
                    open_.remove(here)
                    done.append(here)
            if done:
                yield rows(done)
        if open_:
            yield rows(open_)

    return run


def pack_documents(docs: DataFrame, window: int = WINDOW, every: int = SEED_EVERY, most: int = NEIGHBOURS, seeds: int = SEEDS, long: int = LONG) -> DataFrame:
    """Windows of all documents; see the module's text."""
    if min(window, every, most, seeds) < 1:
        raise ValueError("window, every, most and seeds must be positive")
    small_batches(docs.sparkSession)
    pieces = written(documents(docs).filter("text is not null").mapInArrow(_cut(window, every, long), PIECES), "pack-pieces")

    whole = pieces.filter(F.col("n_words") >= window).select("doc_id", "cuts", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_words") / window).cast("int") - 1)).alias("i"))
    one = lambda c, t: F.array(c).cast(f"array<{t}>")
    whole = whole.select(
        F.lit("whole").alias("kind"), F.col("doc_id").alias("seed"), one(F.col("doc_id"), "bigint").alias("doc_ids"), one(F.get("cuts", "i"), "int").alias("starts"),
        one(F.get("cuts", F.col("i") + 1), "int").alias("ends"), one(F.lit(window), "int").alias("words"), one(F.lit(0.0), "double").alias("scores"), F.lit(window).alias("n_words"),
    )

    tails = pieces.filter("tail > 0").select("uid", "doc_id", "seed", "key", "tail", F.element_at("cuts", -2).alias("start"), F.element_at("cuts", -1).alias("end"))
    lists = neighbours(pieces, most, seeds)
    rooms = tails.filter("seed").select(F.col("uid").alias("seed"), (F.lit(window) - F.col("tail")).alias("room"))
    taken = written(assigned(lists, rooms), "pack-taken")

    place = F.struct(F.negate("score").alias("worse"), "uid", "doc_id", "start", "end", "tail", "score")
    first = tails.filter("seed").select(F.col("uid").alias("of"), place_of_seed().alias("p"))
    others = taken.select("uid", F.col("seed").alias("of"), "score").join(tails.drop("seed"), "uid").select("of", place.alias("p"))
    p = F.col("p")
    found = first.unionByName(others).groupBy("of").agg(F.sort_array(F.collect_list("p")).alias("p"))
    found = found.select(
        F.lit("retrieved").alias("kind"), F.get(p["doc_id"], F.lit(0)).alias("seed"), p["doc_id"].alias("doc_ids"), p["start"].alias("starts"), p["end"].alias("ends"), p["tail"].alias("words"),
        p["score"].alias("scores"), F.aggregate(p["tail"], F.lit(0), lambda a, x: a + x).alias("n_words"),
    )

    rest = tails.filter("not seed").join(taken.select("uid"), "uid", "left_anti")
    rest = rest.repartitionByRange("key", "uid").sortWithinPartitions("key", "uid").select("doc_id", "start", "end", "tail").mapInArrow(_next(window), WINDOWS)
    return whole.unionByName(found).unionByName(rest)


def place_of_seed():
    """The seed's own place: before all others, as these have a positive score."""
    return F.struct(F.lit(-math.inf).alias("worse"), "uid", "doc_id", "start", "end", "tail", F.lit(0.0).alias("score"))


def op1_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
