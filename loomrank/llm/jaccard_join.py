"""N-gram Jaccard join by signature trees.

Every document is the set of its word n-grams (all its words as one gram when it has fewer than n).  Equal sets are one;
sets are linked that have a Jaccard index of at least ``threshold``, and linked sets form classes.

1. All grams of all distinct sets are dealt by hash, and their sets counted.  A gram that only one set holds can't add to
   any overlap, so sets of which less than ``threshold`` is shared have no partner and leave here, before any pair is looked at.
2. The rest meet by prefixes: of two sets with an index of at least t, at least one gram is common to the first
   n - ceil(t n) + 1 of each, grams being in the order of how many sets hold them.  Grams with the same sets as another are
   dropped.  Of the sets of a gram, pairs stay whose sizes and bitmaps (``BITS`` bits a set) allow an overlap large enough; sets
   that such pairs connect are one group.
3. The shared grams of the sets of a group, sent once, are the leaves of a signature tree: inner nodes hold the OR of the
   token bitmaps and the range of the sizes, a dual traversal drops node pairs whose largest possible overlap is too small, and
   leaf pairs that are left are verified exactly.

Keys and groups of more than ``block`` sets are cut into blocks that meet pairwise, so no task holds more than two
blocks.  No step is approximate: every pair that meets the threshold is found (but for collisions of 64-bit hashes).

Nulls: a null id or a null, empty or wordless text takes no part.  Rows with the same id and set count once; an id with
several sets has a row for each.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, documents, id_filter, passes, small_batches, table, written
from ._text import Words, blocks, mix, release

N, THRESHOLD, BLOCK, FANOUT = 5, 0.35, 2048, 8
BITS = 2048
FLUSH, SETS = 1 << 21, 4096
TINY = 8

DEALT = "bucket int, flush bigint, grams binary, sets binary"
COUNTED = "flush bigint, grams binary, held binary, sets binary"
LIVE = "fp bigint, n int, grams binary, held binary, bitmap binary"


def gram_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    w = Words(texts)
    h, out = w.hash, []
    with np.errstate(over="ignore"):
        grams = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            grams = mix(grams * np.uint64(31) + h[k : len(h) - n + 1 + k])
        for a, b in zip(w.first, w.first[1:]):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                short = h[a : a + 1].copy()
                for k in range(a + 1, b):
                    short = mix(short * np.uint64(31) + h[k : k + 1])
                out.append(mix(short + np.uint64(b - a)))
            else:
                out.append(h[:0])
    return out


def prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Size and fingerprint of each set."""
    size = np.array([len(s) for s in sets], np.int32)
    with np.errstate(over="ignore"):
        fp = np.array([mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], np.uint64)
        return size, mix(fp + size.astype(np.uint64)).view(np.int64)


def _printed(n: int):
    def run(batches):
        for batch in blocks(batches):
            size, fp = prints(gram_sets(batch.column("text"), n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"]).filter(pa.array(size > 0))

    return run


def _dealt(n: int, only):
    """Rows of ``DEALT``: of up to ``SETS`` sets, a flush, the grams of a bucket: 12 bits of a gram are the bucket's, the other 52 stand before the set's number."""

    def flush(held, at):
        fp, size = (np.concatenate(c) for c in list(zip(*held))[:2])
        sets = [x for h in held for x in h[2]]
        first = np.sort(np.unique(fp, return_index=True)[1])
        fp, size = fp[first], size[first]
        g = np.concatenate([sets[k] for k in first])
        row = np.repeat(np.arange(len(first), dtype=np.uint64), size)
        order = np.argsort(g, kind="stable")
        g, row = g[order], row[order]
        cut = np.searchsorted(g >> np.uint64(52), np.arange(4097, dtype=np.uint64))
        data = ((g << np.uint64(12)) | row).tobytes()
        some = np.flatnonzero(np.diff(cut))
        own = np.concatenate([fp, size.astype(np.int64)]).tobytes()
        for a in range(0, len(some), 1024):
            k = some[a : a + 1024]
            columns = [pa.array(k.astype(np.int32)), pa.array(np.full(len(k), at)), pa.array([data[8 * cut[b] : 8 * cut[b + 1]] for b in k], pa.binary()), pa.array([own if b == some[0] else None for b in k], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "flush", "grams", "sets"])

    def run(batches):
        held, grams, count, at = [], 0, 0, TaskContext.get().partitionId() << 32
        for batch in blocks(batches):
            batch = batch.filter(pa.array(passes(only, batch.column("doc_id").to_numpy())))
            for lo in range(0, batch.num_rows, 1024):
                sets = [x for x in gram_sets(batch.column("text").slice(lo, 1024), n) if len(x)]
                if not sets:
                    continue
                size, fp = prints(sets)
                if held and count + len(sets) > SETS:
                    yield from flush(held, at)
                    held, grams, count, at = [], 0, 0, at + 1
                held.append((fp, size, sets))
                grams, count = grams + int(size.sum()), count + len(sets)
                if grams >= FLUSH:
                    yield from flush(held, at)
                    held, grams, count, at = [], 0, 0, at + 1
        if held:
            yield from flush(held, at)
        release()

    return run


def _counted(batches):
    """Rows of ``COUNTED``: the grams of a flush that other sets hold too, before the number of the own set, and how many hold each."""
    for group in _tasks(batches, "bucket"):
        flush, blobs = group.column("flush").to_numpy(), group.column("grams").to_pylist()
        size = np.array([len(x) // 8 for x in blobs])
        data = np.frombuffer(b"".join(blobs), np.uint64)
        del blobs
        order = np.argsort(data >> np.uint64(12), kind="stable")
        g = data[order] >> np.uint64(12)
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        many = np.empty(len(data), np.uint32)
        many[order] = np.repeat(np.diff(np.append(cut, len(g))), np.diff(np.append(cut, len(g))))
        bucket = np.uint64(group.column("bucket")[0].as_py())
        keep = many > 1
        row = np.repeat(np.arange(len(size)), size)[keep]
        edge = np.searchsorted(row, np.arange(len(size) + 1))
        g, number, many = ((data[keep] >> np.uint64(12)) | (bucket << np.uint64(52))), (data[keep] & np.uint64(4095)).astype(np.uint32), many[keep]
        held = (many.astype(np.uint64) << np.uint64(12)) | number
        get = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())  # noqa: B023, E731
        out = pa.RecordBatch.from_arrays([pa.array(flush), get(g), get(held), group.column("sets").combine_chunks()], ["flush", "grams", "held", "sets"])
        for a in range(0, out.num_rows, 1024):
            yield out.slice(a, 1024)
    release()


def _live(t: float):
    """Rows of ``LIVE`` for the sets of which others share enough, shared grams in the order of how many sets hold them."""

    def run(batches):
        for group in _tasks(batches, "flush"):
            own = next(x for x in group.column("sets").to_pylist() if x is not None)
            fp, n = np.frombuffer(own, np.int64).reshape(2, -1)
            g, held = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint64) for c in ("grams", "held"))
            row, held = (held & np.uint64(4095)).astype(np.int64), held >> np.uint64(12)
            order = np.lexsort((g, held, row))
            g, held = g[order], held[order]
            edge = np.searchsorted(row[order], np.arange(len(n) + 1))
            keep = np.flatnonzero(np.diff(edge) >= np.maximum(t * n - 1e-9, 1))
            for lo in range(0, len(keep), 512):
                k = keep[lo : lo + 512]
                columns = [pa.array(fp[k]), pa.array(n[k].astype(np.int32))]
                columns += [pa.array([x[edge[i] : edge[i + 1]].tobytes() for i in k], pa.binary()) for x in (g, held.astype(np.uint32))]
                columns.append(pa.array([bitmap(g[edge[i] : edge[i + 1]]).tobytes() for i in k], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["fp", "n", "grams", "held", "bitmap"])
        release()

    return run


def bitmap(grams: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, bool)
    out[((grams >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out)


def _keys(t: float):
    """(fp, key): the shared grams of each set's prefix."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, n = (batch.column(c).to_numpy() for c in ("fp", "n"))
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("grams")]
            most = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1 - (n - np.array([len(g) for g in sets]))  # grams of one set come first
            sets = [g[: max(0, int(m))] for g, m in zip(sets, most)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, [len(g) for g in sets])), pa.array(np.concatenate(sets))], ["fp", "key"])

    return run


class Tree:
    """Levels from the root down; the last holds the sets.  Children of node i are i*FANOUT ... of the next level.

    A level has the bitmaps, the least number of grams here, what bitmaps may lack at most, the most grams here, and the
    least and largest size of the whole sets, which may have more grams than are here.
    """

    def __init__(self, sets: list[np.ndarray], bits: int, whole: np.ndarray):
        leaf = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s >> np.uint64(7)) & np.uint64(bits - 1)
            np.bitwise_or.at(leaf[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        count = np.array([len(s) for s in sets])
        self.levels = [(leaf, count, count - np.bitwise_count(leaf).sum(1), count, whole, whole)]
        while len(self.levels[0][0]) > 1:
            b, least, lost, count, lo, hi = self.levels[0]
            cut = np.arange(0, len(b), FANOUT)
            up, down = np.maximum.reduceat, np.minimum.reduceat
            self.levels.insert(0, (np.bitwise_or.reduceat(b, cut), down(least, cut), up(lost, cut), up(count, cut), down(lo, cut), up(hi, cut)))


def needed(total, t: float):
    """Least overlap of two sets of ``total`` grams together at Jaccard index t."""
    return t / (1 + t) * total


def _possible(x, y, i, j, t: float) -> np.ndarray:
    """Which node pairs may hold a pair of sets with Jaccard index t: by size range, then by shared bits."""
    (bx, nx, cx, mx, lx, hx), (by, ny, cy, my, ly, hy) = x, y
    keep = np.flatnonzero((hx[i] >= t * ly[j] - 1e-9) & (hy[j] >= t * lx[i] - 1e-9))
    out = []
    for part in np.array_split(keep, max(1, len(keep) * bx.shape[1] // (1 << 18))):
        a, b = i[part], j[part]
        most = np.bitwise_count(bx[a] & by[b]).sum(1, dtype=np.int64) + np.minimum(cx[a], cy[b])
        most = np.minimum(most, np.minimum(mx[a], my[b]))
        out.append(part[most >= needed(lx[a] + ly[b], t) - 1e-9])
    return np.concatenate(out)


def _verified(x: list, y: list, i: np.ndarray, j: np.ndarray, t: float, wx: np.ndarray, wy: np.ndarray):
    """Exact overlap of the pairs that are left, as arrays of a piece each; i is sorted."""
    tokens = np.unique(np.concatenate(x + ([] if y is x else y)))
    ids = [np.searchsorted(tokens, s) for s in y]
    sy = np.array([len(s) for s in y])
    flag = np.zeros(len(tokens), np.int32)
    cut = np.flatnonzero(np.diff(i, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(i)]):
        own = np.searchsorted(tokens, x[i[a]])
        flag[own] = 1
        for lo in range(a, b, 1024):
            js = j[lo : min(b, lo + 1024)]
            size = sy[js]
            both = np.add.reduceat(flag[np.concatenate([ids[k] for k in js])], np.concatenate([[0], np.cumsum(size)[:-1]]))
            total = wx[i[a]] + wy[js]
            jac = both / np.maximum(total - both, 1)
            ok = jac >= t
            if ok.any():
                yield np.full(ok.sum(), i[a]), js[ok], jac[ok]
        flag[own] = 0


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, t: float, whole=None):
    """Arrays (i, j, index) of pieces of the pairs of two lists of sorted hash arrays, none empty, or of one with itself (i < j).

    ``whole``: the sizes of the sets, where the lists hold only grams that others share.
    """
    wx, wy = whole or (np.array([len(s) for s in left]), np.array([len(s) for s in right or left]))
    if right is None and len(left) <= TINY:
        i, j = np.triu_indices(len(left), 1)
        if len(i):
            yield from _verified(left, left, i, j, t, wx, wx)
        return
    most = max(map(len, left + (right or [])), default=0)
    bits = min(1 << 14, max(256, 1 << int(4 * most).bit_length()))
    x = Tree(left, bits, wx)
    y = Tree(right, bits, wy) if right is not None else x
    i, j = np.zeros(1, np.int32), np.zeros(1, np.int32)
    dx, dy = 0, 0
    while True:
        keep = _possible(x.levels[dx], y.levels[dy], i, j, t)
        i, j = i[keep], j[keep]
        if not len(i) or (dx == len(x.levels) - 1 and dy == len(y.levels) - 1):
            break
        if dx < len(x.levels) - 1:
            dx += 1
            i = (i[:, None] * FANOUT + np.arange(FANOUT, dtype=np.int32)).ravel()
            j = np.repeat(j, FANOUT)
            ok = i < len(x.levels[dx][0])
            i, j = i[ok], j[ok]
        if dy < len(y.levels) - 1:
            dy += 1
            j = (j[:, None] * FANOUT + np.arange(FANOUT, dtype=np.int32)).ravel()
            i = np.repeat(i, FANOUT)
            ok = j < len(y.levels[dy][0])
            i, j = i[ok], j[ok]
        if right is None:
            ok = i <= j
            i, j = i[ok], j[ok]
    if right is None:
        ok = i < j
        i, j = i[ok], j[ok]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    if len(i):
        yield from _verified(left, left if right is None else right, i, j, t, wx, wx if right is None else wy)


def components(n: int, links) -> np.ndarray:
    """The least of the nodes 0 to n that links connect to each, from an iterable of arrays (a, b)."""
    label = np.arange(n)
    for a, b in links:
        while True:
            x, y = label[a], label[b]
            low = np.minimum(x, y)
            if (x == y).all():
                break
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _tasks(batches, by: str = "task"):
    """Tables of one task each from batches sorted by task."""
    kept, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(by).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if kept and task[a] != at:
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
            kept.append(batch.slice(a, b - a))
            at = task[a]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _sides(group: pa.Table, column: str, kind):
    """Fingerprint, size, rows of the two sides by size (the right one None if the left meets itself) and the sets."""
    fp, size, part = (group.column(c).to_numpy() for c in ("fp", "n", "side"))
    once = np.unique(fp, return_index=True)[1]  # a set that several flushes hold
    data = group.column(column).combine_chunks()
    order = once[np.lexsort((fp[once], size[once]))]
    x, y = order[part[order] == 0], order[part[order] == 1]
    get = lambda k: np.sort(np.frombuffer(data[int(k)].as_buffer(), kind)) if kind == np.uint64 else np.frombuffer(data[int(k)].as_buffer(), kind)
    return fp, size, x, None if group.column("same")[0].as_py() else y, get


def _joined(t: float):
    def run(batches):
        for group in _tasks(batches):
            fp, n, x, y, get = _sides(group, "grams", np.uint64)
            z = x if y is None else y
            if not len(x) or not len(z):
                continue
            kept, held = [], 0

            def pairs(pieces):
                i, j, s = (np.concatenate(c) for c in zip(*pieces))
                a, b = fp[x[i]], fp[z[j]]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], ["fp_a", "fp_b", "jaccard"])

            for piece in tree_join([get(k) for k in x], None if y is None else [get(k) for k in y], t, (n[x], n[z])):
                kept.append(piece)
                held += len(piece[0])
                if held >= 1 << 16:
                    yield pairs(kept)
                    kept, held = [], 0
            if kept:
                yield pairs(kept)
        release()

    return run


def _near(t: float):
    """(fp, key): the sets of each task that pairs connect whose sizes and bitmaps allow a Jaccard index of t share a key."""

    def run(batches):
        for group in _tasks(batches):
            fp, n, x, y, get = _sides(group, "bitmap", np.uint8)
            z = x if y is None else y
            if not len(x) or not len(z):
                continue
            bits = np.stack([get(k) for k in range(len(fp))]).view(np.uint64)
            lost = group.column("shared").to_numpy() - np.bitwise_count(bits).sum(1, dtype=np.int64)
            sizes, other, lost_z, links = n[z], bits[z], lost[z], []
            for place, k in enumerate(x):
                lo = max(np.searchsorted(sizes, t * n[k] - 1e-6), place + 1 if y is None else 0)
                hi = np.searchsorted(sizes, n[k] / t + 1e-6, "right")
                if lo >= hi:
                    continue
                most = np.bitwise_count(other[lo:hi] & bits[k]).sum(1, dtype=np.int64) + np.minimum(lost[k], lost_z[lo:hi])
                near = z[lo + np.flatnonzero(most >= needed(n[k] + sizes[lo:hi], t) - 1e-6)]
                if len(near):
                    links.append((np.full(len(near), k), near))
            tops = components(len(fp), links)
            keep = np.flatnonzero(np.bincount(tops, minlength=len(fp))[tops] > 1)
            task = group.column("task")[0].as_py()
            with np.errstate(over="ignore"):
                key = mix(fp[tops[keep]].view(np.uint64) * np.uint64(31) + np.uint64(task & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(key)], ["fp", "key"])
        release()

    return run


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, fp, size of the key's group, ...) with task, side and same: blocks of a group meet pairwise."""
    rows = rows.withColumn("parts", F.ceil(F.col("size") / block)).withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    task = F.xxhash64("key", "parts", F.least("own", "other"), F.greatest("own", "other"))
    return rows.withColumns({"task": task, "side": (F.col("own") > F.col("other")).cast("int"), "same": F.col("own") == F.col("other")}).drop("parts", "own", "other", "size", "key")


def _by_task(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("task", "side", "same", "fp", "n", *columns).repartition("task").sortWithinPartitions("task")


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are written and gone, which it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected(met: DataFrame) -> DataFrame:
    """(fp, root) of rows (fp, key): root is the least fp that shared keys connect it to."""
    label, old = met.select("fp", F.col("fp").alias("root")).distinct(), None
    while True:
        of_key = met.join(label, "fp").groupBy("key").agg(F.min("root").alias("root"))
        near = met.join(of_key, "key").groupBy("fp").agg(F.min("root").alias("root"))
        step = near.join(label.withColumnRenamed("root", "old"), "fp")
        up = label.select(F.col("fp").alias("root"), F.col("root").alias("up"))
        step = written(step.join(up, "root").select("fp", F.col("up").alias("root"), "old"), "jaccard-labels")
        if old is not None:
            discard(old)
        label, old = step.select("fp", "root"), step
        if step.filter("root <> old").isEmpty():
            return label


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all documents with words, and (fp_a < fp_b, jaccard) of the similar pairs of distinct sets."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = documents(docs).filter("doc_id is not null and text is not null")
    members = written(docs.mapInArrow(_printed(n), "doc_id bigint, fp bigint").distinct(), "jaccard-members")
    reader = members.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))

    dealt = docs.mapInArrow(_dealt(n, id_filter(reader, "doc_id")), DEALT)
    counted = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, COUNTED)
    live = counted.repartition("flush").sortWithinPartitions("flush").mapInArrow(_live(threshold), LIVE)
    live = written(live, "jaccard-live")
    del dealt, counted
    drop_shuffles(spark)
    keys = written(live.mapInArrow(_keys(threshold), "fp bigint, key bigint").distinct(), "jaccard-keys")
    who = [F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"w{k}") for k in range(2)]
    groups = keys.groupBy("key").agg(F.count("*").alias("size"), *who).filter("size > 1")
    groups = groups.groupBy("size", "w0", "w1").agg(F.min("key").alias("key"))
    meets = written(keys.join(groups.select("key", "size"), "key"), "jaccard-meets")
    del groups
    discard(keys)
    drop_shuffles(spark)

    maps = live.select("fp", "n", "bitmap", (F.octet_length("grams") / 8).cast("int").alias("shared"))
    met = _by_task(_in_blocks(meets, block).join(maps, "fp"), "bitmap", "shared")
    met = written(met.mapInArrow(_near(threshold), "fp bigint, key bigint").distinct(), "jaccard-met")
    discard(meets)
    drop_shuffles(spark)
    root = connected(met)
    sized = root.withColumnRenamed("root", "key").join(root.groupBy(F.col("root").alias("key")).agg(F.count("*").alias("size")), "key")
    routed = _in_blocks(sized, block).join(live.select("fp", "n", "grams"), "fp")
    pairs = written(_by_task(routed, "grams").mapInArrow(_joined(threshold), "fp_a bigint, fp_b bigint, jaccard double"), "jaccard-pairs")
    discard(live, met)
    return members, pairs


def _labelled(pairs: DataFrame) -> DataFrame:
    """(v, root): root is the least set that links connect a linked set v to."""
    both = pairs.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    both = both.union(both.select("b", "a"))
    label, last = both.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct(), None
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        new = label.join(near, label.v == near.a).select("v", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = label.select(F.col("v").alias("root"), F.col("root").alias("up"))  # pointer jump
        new = written(new.join(up, "root").select("v", F.least("root", "up").alias("root"), "old"), "jaccard-labels")
        if last is not None:
            discard(last)
        label, last = new.select("v", "root"), new
        if new.filter("root <> old").isEmpty():
            return label


def grouped(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, fp, root): root is the least set fingerprint that links connect a document's set to."""
    members, pairs = similar_sets(docs, **kw)
    label = _labelled(pairs)
    return members.join(label.withColumnRenamed("v", "fp"), "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def jaccard_classes(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, set_id, class_id, links) of every document with words.

    ``set_id`` is the least id with the same set, ``class_id`` the least id in the class, ``links`` the number of other
    sets that are similar to the document's.
    """
    members, pairs = similar_sets(docs, **kw)
    label = _labelled(pairs)
    links = pairs.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    sets = members.groupBy("fp").agg(F.min("doc_id").alias("set_id"))
    sets = sets.join(links, "fp", "left").join(label.withColumnRenamed("v", "fp"), "fp", "left")
    sets = written(sets.select("fp", "set_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "fp").alias("root")), "jaccard-classes")
    classes = sets.groupBy("root").agg(F.min("set_id").alias("class_id"))
    return members.join(sets.join(classes, "root"), "fp").select("doc_id", "set_id", "class_id", "links")


def jaccard_links(docs: DataFrame, **kw) -> DataFrame:
    """(set_a < set_b, jaccard): every pair of similar sets, each told by the least id that has it."""
    members, pairs = similar_sets(docs, **kw)
    sets = members.groupBy("fp").agg(F.min("doc_id").alias("set_id"))
    a, b = sets.toDF("fp_a", "a"), sets.toDF("fp_b", "b")
    pairs = pairs.join(a, "fp_a").join(b, "fp_b").filter("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b")).agg(F.max("jaccard").alias("jaccard"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its set, its class and the number of its links."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links themselves, between sets."""
    return jaccard_links(table(spark, sf_dir, "documents"))


_SETS_SQL = """
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
      FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS k
      FROM d WHERE len(w) > 0),
u AS (SELECT k, row_number() OVER () AS sid, min(doc_id) AS set_id FROM s GROUP BY k),
g AS (SELECT sid, unnest(k) AS g FROM u),
c AS (SELECT a.sid AS sa, b.sid AS sb, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.sid <> b.sid GROUP BY ALL),
p AS (SELECT sa, sb, x.set_id AS a, y.set_id AS b, c / (len(x.k) + len(y.k) - c) AS jaccard
      FROM c JOIN u x ON x.sid = sa JOIN u y ON y.sid = sb WHERE c / (len(x.k) + len(y.k) - c) >= 0.35)"""

SQL = {
    "op9_jaccard_join": _SETS_SQL
    + """,
r AS (SELECT sid, sid AS other FROM u UNION SELECT r.sid, p.sb FROM r JOIN p ON p.sa = r.other),
t AS (SELECT r.sid, min(u.set_id) AS class_id FROM r JOIN u ON u.sid = r.other GROUP BY r.sid),
n AS (SELECT sa AS sid, count(*) AS links FROM p GROUP BY sa)
SELECT DISTINCT s.doc_id, u.set_id, t.class_id, coalesce(n.links, 0) AS links
FROM s JOIN u ON u.k = s.k JOIN t ON t.sid = u.sid LEFT JOIN n ON n.sid = u.sid""",
    "op9_jaccard_links": _SETS_SQL + "\nSELECT a AS set_a, b AS set_b, max(jaccard) AS jaccard FROM p WHERE a < b GROUP BY ALL",
}
