"""Vector search: exact top-k for batches of queries, nearest neighbours of all rows, feedback and diversification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions import vectors as V
from loomrank.operators.lexical import best
from loomrank.sources.shared import small_batches, written

BLOCK, TILE, SPAN, BYTES = 4096, 512, 256, 32 << 20
#: what a product of unit vectors in single precision may be off by, several times over
SLACK = 2e-5


def _packed(rows: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(block, ids, data): the rows of each partition in blocks of at most ``size``; data are the vectors as bytes.

    Rows whose vector is null, holds nulls or isn't as long as the block's others stand in blocks of their own.
    """
    kinds = dict(rows.dtypes)
    double = kinds[vector] != "array<float>"
    size = size or BLOCK

    def pack(batches):
        part, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list] = {}

        def close(width):
            nonlocal made
            ids, data = zip(*held.pop(width))
            made += 1
            kind = pa.list_(ids[0].type)
            return pa.RecordBatch.from_arrays([pa.array([part + made]), pa.array([pa.concat_arrays(ids).to_pylist()], kind), pa.array([width], pa.int32()), pa.array([b"".join(data)], pa.binary())], ["block", "ids", "width", "data"])

        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            width = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).copy()
            flat = v.flatten()
            if flat.null_count:
                parents = pc.list_parent_indices(v).to_numpy()
                width[np.unique(parents[flat.is_null().to_numpy(zero_copy_only=False)])] = -1
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                own = v if len(at) == len(width) else v.take(pa.array(at))
                x = own.flatten().to_numpy(zero_copy_only=False) if w > 0 else np.zeros(0)
                x = x.astype(np.float64 if double else np.float32, copy=False)
                keys = ids.take(pa.array(at))
                start = 0
                while start < len(at):
                    have = sum(len(i) for i, _ in held.get(w, ()))
                    n = min(size - have, len(at) - start)
                    held.setdefault(w, []).append((keys.slice(start, n), x[start * w : (start + n) * w].tobytes() if w > 0 else b""))
                    start += n
                    if have + n == size:
                        yield close(w)
        for w in list(held):
            yield close(w)

    return rows.select(key, vector).mapInArrow(pack, f"block bigint, ids array<{kinds[key]}>, width int, data binary")


def _numbers(ids: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as they do."""
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist(), object)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds; numbers too large for digits stay."""
    y = np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5), x) / 10.0**digits
    return np.where(np.isfinite(y), y, x) + 0.0


def _by_worth(row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by row, then the highest score (NaN before all), then id (nulls first)."""
    if ids.dtype == object:
        at = {v: n for n, v in enumerate(sorted(set(ids.tolist()), key=lambda v: (v is not None, v)))}
        ids = np.array([at[v] for v in ids.tolist()])
    return np.lexsort((ids, np.where(np.isnan(score), -np.inf, -score), row))


class _Best:
    """The k best of what comes for each row of a block: at most 2 k a row are held besides what came last."""

    def __init__(self, n: int, k: int, floor: float):
        self.n, self.k, self.waiting, self.held = n, k, [], 0
        self.row, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        self.last, self.last_id = np.full(n, floor), None

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if self.last_id is not None:
            full, last = self.full[row], self.last[row]
            if ids.dtype != object and self.last_id.dtype != object:
                keep = ~full | ~(score <= last) | ((score == last) & (ids < self.last_id[row]))
            else:
                keep = ~full | ~(score < last)
            row, score, ids = row[keep], score[keep], ids[keep]
        if len(row):
            self.waiting.append((row, score, ids))
            self.held += len(row)
            if self.held >= self.n * self.k or self.last_id is None:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        if self.ids is not None:
            self.waiting.append((self.row, self.score, self.ids))
        row, score, ids = (np.concatenate(c) for c in zip(*self.waiting))
        order = _by_worth(row, score, ids)
        row = row[order]
        starts = np.searchsorted(row, np.arange(self.n))
        place = np.arange(len(row)) - starts[row]
        keep = place < self.k
        order = order[keep]
        self.row, self.score, self.ids, self.waiting, self.held = row[keep], score[order], ids[order], [], 0
        if self.last_id is None:
            self.last_id, self.full = np.zeros(self.n, self.ids.dtype), np.zeros(self.n, bool)
        elif self.ids.dtype != self.last_id.dtype:
            self.last_id = self.last_id.astype(object)
        end = place[keep] == self.k - 1
        self.full[self.row[end]] = True
        self.last[self.row[end]], self.last_id[self.row[end]] = np.where(np.isnan(self.score[end]), np.inf, self.score[end]), self.ids[end]


def _similar(x: "_Side", y: "_Side", best: _Best, digits: int) -> None:
    """Pairs of other ids whose cosine may be among the best: told in single precision, worked out in double."""
    room = np.empty(4 * TILE * TILE, np.float32)
    for j in range(0, len(y.unit), 4 * TILE):
        right, right32, names = y.unit[j : j + 4 * TILE], y.unit32[j : j + 4 * TILE], y.ids[j : j + 4 * TILE]
        for i in range(0, len(x.unit), TILE):
            left = x.unit[i : i + TILE]
            low = (best.last[i : i + TILE] - SLACK).astype(np.float32)
            near = np.matmul(x.unit32[i : i + len(left)], right32.T, out=room[: len(left) * len(right32)].reshape(len(left), -1)).reshape(len(left), -1, SPAN)
            a, span = np.nonzero(near.max(2) >= low[:, None])  # most spans hold nothing that is near enough
            if not len(a):
                continue
            at, b = np.nonzero(near[a, span] >= low[a, None])
            a, b = a[at], span[at] * SPAN + b
            if len(right) < len(right32):
                a, b = a[b < len(right)], b[b < len(right)]
            if len(a) > left.shape[0] * right.shape[0] // 16:
                score = (left @ right.T)[a, b]
            else:
                score = np.concatenate([np.einsum("ij,ij->i", left[a[s : s + 65536]], right[b[s : s + 65536]]) for s in range(0, max(len(a), 1), 65536)])
            score = _rounded(score, digits)
            keep = (score >= best.last[a + i]) & (x.ids[a + i] != names[b])
            best.add(a[keep] + i, score[keep], names[b[keep]])
    if best.held > 4 * best.n:
        best.settle()


def _scored(x: "_Side", y: "_Side", best: _Best, metric: str, digits: int) -> None:
    """Every pair of the two blocks, in double precision; no score where the vectors differ in length."""
    for i in range(0, len(x.ids), TILE):
        n = len(x.ids[i : i + TILE])
        for j in range(0, len(y.ids), TILE):
            names = y.ids[j : j + TILE]
            if x.width != y.width or x.width < 0:
                score = np.full((n, len(names)), -np.inf)
            elif metric == "cosine":
                score = _rounded(x.unit[i : i + TILE] @ y.unit[j : j + TILE].T, digits)
            elif metric == "ip":
                score = _rounded(x.m[i : i + TILE] @ y.m[j : j + TILE].T, digits)
            else:
                score = _rounded(np.array([-np.square(y.m[j : j + TILE] - v).sum(1) for v in x.m[i : i + TILE]]).reshape(n, len(names)), digits)
            if len(names) > best.k:
                # less than the k-th of the row can't be among the best
                worth = np.where(np.isnan(score), np.inf, score)
                low = np.maximum(np.partition(worth, len(names) - best.k, axis=1)[:, len(names) - best.k], best.last[i : i + n])
                a, b = np.nonzero(worth >= low[:, None])
            else:
                a, b = np.nonzero(np.ones(score.shape, bool))
            best.add(a + i, score[a, b], names[b])


class _Side:
    def __init__(self, ids: pa.Array, width: int, data: bytes, kind, single: bool):
        self.names, self.ids, self.width = ids, _numbers(ids), width
        if width >= 0:
            self.m = np.frombuffer(data, kind).reshape(len(ids), width).astype(np.float64)
            norm = np.linalg.norm(self.m, axis=1, keepdims=True)
            self.unit = self.m / np.where(norm > 0, norm, 1)
            if single:  # in whole spans; what isn't finite is near nothing
                self.unit32 = np.zeros((-(-len(ids) // SPAN) * SPAN, width), np.float32)
                self.unit32[: len(ids)] = np.where(np.isfinite(norm), self.unit, 0)


def _best_of_blocks(pairs: DataFrame, kinds: tuple, names: tuple, k: int, metric: str, digits: int, floor: float | None) -> DataFrame:
    """The k best of the right blocks' rows for each row of the left blocks, a partition at a time.

    With a floor, only pairs of other ids with a cosine of at least that; without, all pairs count.
    """
    left_kind, right_kind, left_bytes, right_bytes = kinds

    def run(batches):
        held: dict[int, tuple[_Side, _Best]] = {}
        kind = None
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column("block")[r].as_py(), batch.column("rb")[r].as_py()
                side = lambda ids, width, data, kind: _Side(batch.column(ids)[r].values, batch.column(width)[r].as_py(), batch.column(data)[r].as_buffer(), kind, floor is not None)  # noqa: B023, E731
                if a not in held:
                    x = side("ids", "width", "data", left_bytes)
                    held[a] = x, _Best(len(x.ids), k, -np.inf if floor is None else floor)
                x, best = held[a]
                y = side("rids", "rwidth", "rdata", right_bytes)
                kind = y.names.type
                if floor is None:
                    _scored(x, y, best, metric, digits)
                elif x.width == y.width >= 0:
                    _similar(x, y, best, digits)
        for x, best in held.values():
            best.settle()
            if best.ids is not None:
                score = pa.array(np.where(best.score == -np.inf, 0, best.score), mask=best.score == -np.inf)
                yield pa.RecordBatch.from_arrays([x.names.take(pa.array(best.row)), pa.array(best.ids, kind), score], list(names))

    return pairs.mapInArrow(run, f"{names[0]} {left_kind}, {names[1]} {right_kind}, {names[2]} double")


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right.select(F.col("block").alias("rb"), F.col("ids").alias("rids"), F.col("width").alias("rwidth"), F.col("data").alias("rdata")))


def _bytes(kind: str):
    return np.float32 if kind == "array<float>" else np.float64


def search(items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """(qid, id, score, rank) of items (id, vector) for queries (qid, qv): every pair is scored.  L2 scores are negated squares.

    A block of queries and one of items are one matrix product, of which a task keeps the k best a query.
    """
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"no such metric: {metric}")
    i, q = dict(items.dtypes), dict(queries.dtypes)
    pairs = _both(_packed(queries.hint("rebalance"), "qid", "qv"), _packed(items, "id", "vector"))
    kinds = q["qid"], i["id"], _bytes(q["qv"]), _bytes(i["vector"])
    small_batches(items.sparkSession)
    return best(_best_of_blocks(pairs, kinds, ("qid", "id", "score"), k, metric, digits, None), k, "id")


def overscan(items: DataFrame, queries: DataFrame, k: int, dims: int, factor: int = 4) -> DataFrame:
    """Two stages: k * factor candidates by the first dims coordinates, ranked anew by the whole vectors."""
    short = items.select("id", V.truncated(F.col("vector"), dims).alias("vector"))
    first = search(short, queries.select("qid", V.truncated(F.col("qv"), dims).alias("qv")), k * factor).select("qid", "id")
    pairs = first.join(items, "id").join(queries, "qid")
    return best(pairs.select("qid", "id", F.round(V.cosine(F.col("vector"), F.col("qv")), 6).alias("score")), k, "id")


def feedback(items: DataFrame, queries: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """(qid, qv): each query vector plus weight times the mean of its k nearest, at unit length."""
    near = search(items, queries, k).join(items, "id").select("qid", F.posexplode("vector").alias("d", "x"))
    centre = near.groupBy("qid", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = centre.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centre"))
    moved = F.zip_with("qv", "centre", lambda a, c: a.cast("double") + F.lit(weight) * c)
    return queries.join(centre, "qid").select("qid", V.unit(moved).alias("qv"))


def _matrix(rows):
    ids = np.array([r["id"] for r in rows])
    m = np.array([r["vector"] for r in rows], np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return ids, m / np.where(n > 0, n, 1)


def neighbours(items: DataFrame, k: int = 12, floor: float = 0.5, blocks: int | None = None) -> DataFrame:
    """(src, dst, sim): of each item its k nearest others with a cosine of at least floor.  Exact.

    Every pair is looked at: the work grows as the square of the items.  They are packed in blocks of about 4,096, as
    bytes, once; a task holds a few blocks, meets those of its share of the table with them one at a time in matrix
    products of single precision, and works out in double what may be among the k best by the bound of what it holds.
    """
    spark, kind = items.sparkSession, dict(items.dtypes)
    small_batches(spark)
    rows = items.filter("id is not null and vector is not null").select("id", "vector")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    blocks = blocks or max(1, -(-n // BLOCK), min(2 * cores, -(-n // 256)))
    place = lambda x, parts: (x % parts).cast("int")
    packed = written(_packed(rows.repartitionById(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "id", "vector", 2 * BLOCK), "vector-blocks")
    # a task holds up to 4 blocks and reads a share of at most 32 MB of all
    lefts, rights = max(min(blocks, 2 * cores), -(-blocks // 4)), max(1, -(-n * width * (4 if kind["vector"] == "array<float>" else 8) // BYTES))
    own = F.shiftright("block", 32)
    pairs = _both(packed.repartitionById(lefts, place(own, lefts)).hint("shuffle_replicate_nl"), packed.repartitionById(rights, place(own, rights)))
    kinds = kind["id"], kind["id"], _bytes(kind["vector"]), _bytes(kind["vector"])
    found = _best_of_blocks(pairs, kinds, ("src", "dst", "sim"), k, "cosine", 6, floor)
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def centroids(items: DataFrame, lists: int, rounds: int = 8, sample: int = 20000, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means on a bounded sample of the items (those whose ids hash least)."""
    rows = items.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("id", "vector").collect()
    if not rows:
        return np.zeros((0, 0))
    _, x = _matrix(rows)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def search_by_lists(items: DataFrame, queries: DataFrame, k: int, lists: int = 32, probes: int = 8, centres: np.ndarray | None = None) -> DataFrame:
    """Approximate ``search``: items are filed under their nearest centroid, a query looks into its ``probes`` nearest lists."""
    c = centroids(items, lists) if centres is None else centres

    def files(most: int, key: str):
        def run(batches):
            for batch in batches:
                v = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
                if batch.num_rows:
                    near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :most]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.repeat(np.arange(len(v)), near.shape[1]))), pa.array(near.ravel())], [key, "list"])

        return run

    filed = items.select("id", F.col("vector").alias("v")).mapInArrow(files(1, "id"), f"id {dict(items.dtypes)['id']}, list bigint").join(items, "id")
    asked = queries.select("qid", F.col("qv").alias("v")).mapInArrow(files(probes, "qid"), f"qid {dict(queries.dtypes)['qid']}, list bigint").join(queries, "qid")
    pairs = filed.join(asked, "list")
    return best(pairs.select("qid", "id", F.round(V.cosine(F.col("vector"), F.col("qv")), 6).alias("score")), k, "id")


def diversified(ranked: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """(qid, id, score, place): maximal marginal relevance over candidates (qid, id, score, vector).

    Only with more than k candidates and trade strictly between 0 and 1; else the order stays.  The pool is the 4k best;
    relevance is the score over the pool's highest, redundancy the highest dot product with what is chosen, at least 0;
    the first of equals is taken.  Scores stay as they are.
    """
    pool = best(ranked, 4 * k, "id")

    def run(batch):
        rows = batch.sort_by("rank")
        ids, score = rows.column("id").to_pylist(), np.array(rows.column("score").to_pylist())
        v = np.array(rows.column("vector").to_pylist(), np.float64)
        n = len(ids)
        if n <= k or not 0 < trade < 1:
            chosen = list(range(min(k, n)))
        else:
            rel = score / score.max() if score.max() > 0 else score
            worst, free, chosen = np.zeros(n), np.ones(n, bool), []
            for _ in range(k):
                value = np.where(free, trade * rel - (1 - trade) * worst, -np.inf)
                at = int(np.argmax(np.round(value, 9)))
                chosen.append(at)
                free[at] = False
                worst = np.maximum(worst, v @ v[at])
        return pa.table({"qid": [rows.column("qid")[0].as_py()] * len(chosen), "id": [ids[i] for i in chosen], "score": [float(score[i]) for i in chosen], "place": list(range(1, len(chosen) + 1))})

    kinds = dict(ranked.dtypes)
    return pool.groupBy("qid").applyInArrow(run, f"qid {kinds['qid']}, id {kinds['id']}, score double, place bigint")
