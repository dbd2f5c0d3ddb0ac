"""Vector codec: seeded rotation, Lloyd-Max scalar codes, one-bit residual signs, asymmetric estimates, two-stage search."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.functions import vectors as V
from loomrank.operators.lexical import best

CODE = "codes binary, norm float, res_norm float, signs bigint"


class Xoshiro:
    """xoshiro256** seeded by splitmix64."""

    def __init__(self, seed: int):
        self.mask = (1 << 64) - 1
        self.state = []
        for _ in range(4):
            seed = (seed + 0x9E3779B97F4A7C15) & self.mask
            z = seed
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & self.mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & self.mask
            self.state.append(z ^ (z >> 31))

    def next(self) -> int:
        rot = lambda x, k: ((x << k) | (x >> (64 - k))) & self.mask
        s = self.state
        out = rot((s[1] * 5) & self.mask, 7) * 9 & self.mask
        t = (s[1] << 17) & self.mask
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = rot(s[3], 45)
        return out

    def signs(self, n: int) -> np.ndarray:
        return np.array([1.0 if self.next() & 1 == 0 else -1.0 for _ in range(n)])


@functools.cache
def codebook(bits: int) -> tuple[np.ndarray, float, float]:
    """Levels of the best scalar quantiser of N(0, 1), its squared error, and the mean square of its output."""
    if not 1 <= bits <= 8:
        raise ValueError("bits must be from 1 to 8")
    x = (np.arange(1 << 16) + 0.5) / (1 << 15) * 9 - 9
    p = np.exp(-x * x / 2)
    p /= p.sum()
    mass, first = np.concatenate([[0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(p * x)])
    levels = np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), mass[1:], x)
    for _ in range(20000):
        cut = np.concatenate([[0], np.searchsorted(x, (levels[1:] + levels[:-1]) / 2), [len(x)]])
        m = mass[cut[1:]] - mass[cut[:-1]]
        new = np.where(m > 0, (first[cut[1:]] - first[cut[:-1]]) / np.where(m > 0, m, 1), levels)
        moved, levels = abs(new - levels).max(), new
        if moved < 1e-10:
            break
    q = levels[np.searchsorted((levels[1:] + levels[:-1]) / 2, x)]
    return levels, float((p * (x - q) ** 2).sum()), float((p * q * q).sum())


class Codec:
    def __init__(self, dim: int, bits: int = 4, residual: int = 32, rounds: int = 3, seed: int = 1):
        if not 0 <= residual <= 64:
            raise ValueError("residual must be from 0 to 64")
        rng = Xoshiro(seed)
        self.inner, self.bits, self.m = dim, bits, residual
        self.dim = 1 << max(0, (dim - 1).bit_length())
        self.flips = [rng.signs(self.dim) for _ in range(rounds)]
        self.levels, self.mse, self.power = codebook(bits)
        self.cuts = (self.levels[1:] + self.levels[:-1]) / 2
        self.project = rng.signs(residual * self.dim).reshape(residual, self.dim) if residual else np.zeros((0, self.dim))

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        n, h = self.dim, 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        return x / math.sqrt(n)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.dim))
        out[:, : self.inner] = x
        for f in self.flips:
            out = self._hadamard(out * f)
        return out

    def encode(self, x: np.ndarray):
        """(codes, norm, residual norm, signs) of rows."""
        r = self.rotate(np.asarray(x, np.float64))
        norm = np.linalg.norm(r, axis=1)
        z = r * (math.sqrt(self.dim) / np.where(norm > 0, norm, 1))[:, None]
        codes = np.searchsorted(self.cuts, z).astype(np.uint8)
        res = np.where(norm[:, None] > 0, z - self.levels[codes], 0)
        bit = (res @ self.project.T >= 0).astype(np.uint64) << np.arange(self.m, dtype=np.uint64)
        return codes, norm, np.linalg.norm(res, axis=1), np.where(norm > 0, bit.sum(1, dtype=np.uint64), np.uint64(0))

    def decode(self, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        y = self.levels[codes] * (norm / math.sqrt(self.dim))[:, None]
        for f in reversed(self.flips):
            y = self._hadamard(y) * f
        return y[:, : self.inner]

    def estimate(self, q: np.ndarray, codes, norm, res_norm, signs, unbiased: bool = False):
        """Inner products of queries (rows of q) and codes: the low-variance estimate for ranking, or the unbiased one."""
        rq = self.rotate(np.asarray(q, np.float64))
        main = rq @ self.levels[codes].T / math.sqrt(self.dim)
        if not unbiased or not self.m:
            return main / self.power * norm
        s = np.where((np.asarray(signs, np.uint64)[:, None] >> np.arange(self.m, dtype=np.uint64)) & np.uint64(1), 1.0, -1.0)
        return (main + (rq @ self.project.T) @ s.T * (math.sqrt(math.pi / 2) / self.m) * res_norm / math.sqrt(self.dim)) * norm

    def bytes_per_vector(self) -> int:
        return (self.dim * self.bits + 7) // 8 + 4 + (12 if self.m else 0)


def encoded(items: DataFrame, codec: Codec) -> DataFrame:
    """(id, codes, norm, res_norm, signs) of items (id, vector)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c, n, r, s = codec.encode(np.array(batch.column("vector").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in c]), pa.array(n, pa.float32()), pa.array(r, pa.float32()), pa.array(s.view(np.int64))], ["id", "codes", "norm", "res_norm", "signs"])

    return items.select("id", "vector").mapInArrow(run, f"id {dict(items.dtypes)['id']}, {CODE}")


def code_search(codes: DataFrame, items: DataFrame, queries: DataFrame, codec: Codec, k: int, overscan: int = 4) -> DataFrame:
    """Two stages: the k * overscan best by codes in each batch, then of these the k best by the whole vectors."""
    kind = {**dict(codes.dtypes), **dict(queries.dtypes)}
    packed = queries.agg(F.collect_list(F.struct("qid", "qv")).alias("q"))  # one row with the batch of queries, joined to each code

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = batch.column("q")[0].as_py()
            q = np.array([r["qv"] for r in asked])
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            est = codec.estimate(q, c, *(np.array(batch.column(n).to_pylist()) for n in ("norm", "res_norm")), np.array(batch.column("signs").to_pylist(), np.int64).view(np.uint64))
            top = np.argsort(-est, axis=1, kind="stable")[:, : k * overscan]
            i = np.repeat(np.arange(len(q)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array([asked[x]["qid"] for x in i]), batch.column("id").take(pa.array(top.ravel())), pa.array(est[i, top.ravel()])], ["qid", "id", "score"])

    first = codes.crossJoin(packed).mapInArrow(run, f"qid {kind['qid']}, id {kind['id']}, score double")
    near = best(first, k * overscan, "id").select("qid", "id")
    pairs = near.join(items, "id").join(queries, "qid")
    return best(pairs.select("qid", "id", F.round(V.cosine(F.col("vector"), F.col("qv")), 6).alias("score")), k, "id")


def codec_error(items: DataFrame, codec: Codec) -> DataFrame:
    """One row (mse, cosine): mean squared error a standardised coordinate, and mean cosine of vectors and their decodings."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("vector").to_pylist())
                c, n, r, _ = codec.encode(x)
                y = codec.decode(c, n)
                cos = (x * y).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(r * r / codec.dim), pa.array(cos)], ["e", "c"])

    return items.select("vector").mapInArrow(run, "e double, c double").agg(F.avg("e").alias("mse"), F.avg("c").alias("cosine"))


def rank_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, overlap): the part of ranking a's ids that b has."""
    n = a.groupBy("qid").agg(F.count("*").alias("n"))
    both = a.select("qid", "id").join(b.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("both"))
    return n.join(both, "qid", "left").select("qid", (F.coalesce("both", F.lit(0)) / F.col("n")).alias("overlap"))


