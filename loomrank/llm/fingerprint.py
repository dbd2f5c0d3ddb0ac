"""Quartile bucket digest of documents, and the pairs of like digests.

Digest of a text's UTF-8 bytes: every five bytes in a row give six triplets; each is hashed to one of 128 buckets and
counted.  A bucket's code is 0 to 3 by the quartile of the counts it lies in.  With the codes go the length on a scale
of steps of 1.3 and the ratios of the first and second quartile to the third, in sixteenths.

Difference of two digests, between 0 and ``TOP``: for each bucket the distance of the codes, 3 steps counting 6; the
distance of the ratios, round the sixteen, one step counting 1 and more 12 a step; of the lengths likewise; cut off at
``TOP``.

Pairs with a difference up to ``most`` are found exactly.  Digests that are equal form a group, told by its least id:
the pair (least id, other id) with difference 0 stands for all pairs within it, and the pairs of least ids for all
pairs between groups.  Between groups, the 128 codes are cut into ``most`` + 1 bands: if two digests differ by at most
``most``, one band at least is equal, so equal bands (with equal-enough lengths) bring together all pairs there are.

Nulls: a null id or a text of fewer than ``LEAST`` bytes, null or empty included, has no digest and no pair (such
rows are given with a null digest and zeros by ``digests``).  Rows with one id and different texts may pair with others but not
with each other.  Repeated rows count once in pairs.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, small_batches, table, written
from ._text import blocks, utf8

LEAST = 50
TOP = 400
MOST = 12
SCHEMA = "doc_id bigint, digest string, q1 int, q2 int, q3 int, q1_ratio int, q2_ratio int, length_code int"
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))


_A, _B, _C, _K, _MUL = 7919, 104729, 1299709, 15485863, 1327217885


def bucket(a, b, c, k: int):
    """The bucket of bytes a, b, c as triplet number k: bits 24 to 30 of a product below 2**60."""
    return ((a * _A + b * _B + c * _C + k * _K) * _MUL >> 24) & 127


def counts(data: np.ndarray) -> np.ndarray:
    """How often each of the 128 buckets is hit."""
    n = len(data) - 4
    out = np.zeros(128, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        d = data[lo : hi + 4].astype(np.int64)
        a, b, c = d * (_A * _MUL), d * (_B * _MUL), d * (_C * _MUL)
        m = hi - lo
        for k, (x, y, z) in enumerate(_TRIPLETS):
            h = a[x : m + x] + b[y : m + y]
            h += c[z : m + z]
            h += k * _K * _MUL
            h >>= 24
            h &= 127
            out += np.bincount(h, minlength=128)
    return out


def length_code(n: int) -> int:
    code, edge = 0, 1
    while edge < n:
        edge = edge * 13 // 10 + 1
        code += 1
    return code


def digest(data: np.ndarray):
    """(hex codes, q1, q2, q3, first ratio, second ratio, length code), or None if the text is too short."""
    if len(data) < LEAST:
        return None
    c = counts(data)
    s = np.sort(c)
    q1, q2, q3 = int(s[31]), int(s[63]), int(s[95])
    code = (c > q1).astype(int) + (c > q2) + (c > q3)
    text = "".join("0123456789abcdef"[4 * a + b] for a, b in zip(code[0::2], code[1::2]))
    return text, q1, q2, q3, q1 * 100 // max(q3, 1) % 16, q2 * 100 // max(q3, 1) % 16, length_code(len(data))


def _emit(batches):
    for batch in blocks(batches):
        data, offsets = utf8(batch.column("text"))
        rows = [digest(data[a:b]) or (None,) + (0,) * 6 for a, b in zip(offsets, offsets[1:])]
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.string(), *[pa.int32()] * 6]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "digest", "q1", "q2", "q3", "q1_ratio", "q2_ratio", "length_code"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """The digest of every row; see the module's text."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_emit, SCHEMA)


_HEX = np.full(128, 0, np.int8)
for _i, _c in enumerate("0123456789abcdef"):
    _HEX[ord(_c)] = _i
_CODE = np.array([0, 1, 2, 6])


def header_difference(a, b, ring: int | None):
    d = np.abs(a - b)
    if ring:
        d = np.minimum(d, ring - d)
    return np.where(d <= 1, d, 12 * d)


def difference(a, b) -> np.ndarray:
    """Bounded difference of two arrays of digests: dictionaries with the columns of ``digests``."""
    codes = []
    for x in (a["digest"], b["digest"]):
        hexa = _HEX[np.frombuffer("".join(x).encode(), np.uint8).reshape(len(x), 64)]
        codes.append(np.concatenate([hexa >> 2, hexa & 3], 1))
    total = _CODE[np.abs(codes[0] - codes[1])].sum(1)
    total = total + header_difference(a["q1_ratio"], b["q1_ratio"], 16) + header_difference(a["q2_ratio"], b["q2_ratio"], 16)
    return np.minimum(TOP, total + header_difference(a["length_code"], b["length_code"], None))


_COLUMNS = ("digest", "q1_ratio", "q2_ratio", "length_code")


def _compare(most: int):
    """Batches of candidate pairs to those within ``most``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                get = lambda side: {c: batch.column(f"{side}_{c}").to_numpy(zero_copy_only=False) for c in _COLUMNS}
                d = difference(get("a"), get("b"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_a"), batch.column("doc_b"), pa.array(d.astype(np.int32))], ["doc_a", "doc_b", "difference"]).filter(pa.array(d <= most))

    return run


def _compare_kept(most: int):
    """As ``_compare``, with the digests."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                get = lambda side: {c: batch.column(f"{side}_{c}").to_numpy(zero_copy_only=False) for c in _COLUMNS}
                d = difference(get("a"), get("b"))
                columns = [batch.column("doc_a"), batch.column("doc_b"), pa.array(d.astype(np.int32)), batch.column("a_digest"), batch.column("b_digest")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_a", "doc_b", "difference", "digest_a", "digest_b"]).filter(pa.array(d <= most))

    return run


def like_pairs(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_a < doc_b, difference) within and between groups of equal digests; see the module's text."""
    if not 0 <= most < 64:
        raise ValueError("most must be from 0 to 63")
    all_ = written(digests(docs).filter("doc_id is not null and digest is not null").drop("q1", "q2", "q3"), "digests")
    groups = written(all_.groupBy(*_COLUMNS).agg(F.min("doc_id").alias("least")), "digest-groups")
    equal = all_.join(groups, list(_COLUMNS)).filter("doc_id > least").select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(0).alias("difference")).distinct()
    edge = [64 * k // (most + 1) for k in range(most + 2)]
    bands = [F.struct(F.lit(k).alias("k"), F.substring("digest", a + 1, b - a).alias("part")) for k, (a, b) in enumerate(zip(edge, edge[1:]))]
    near = F.array(F.col("length_code"), F.col("length_code") + 1) if most >= 1 else F.array("length_code")
    banded = groups.select("least", *_COLUMNS, F.explode(F.array(*bands)).alias("band"))
    # lengths may differ by one: each meets its own length and the next; a pair at a distance of 0 meets at its own
    left = banded.select("*", F.explode(near).alias("at"))
    x = left.select(F.xxhash64("band.k", "band.part", "at").alias("key"), F.struct("least", *_COLUMNS, F.col("band.k").alias("k")).alias("x"))
    y = banded.select(F.xxhash64("band.k", "band.part", "length_code").alias("key"), F.struct("least", *_COLUMNS, F.col("band.k").alias("k")).alias("y"))
    ring = lambda c: F.least(F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")), 16 - F.abs(F.col(f"x.{c}") - F.col(f"y.{c}"))) <= max(1, most // 12)
    pairs = x.join(y, "key").filter((F.col("x.k") == F.col("y.k")) & ((F.col("x.length_code") < F.col("y.length_code")) | (F.col("x.least") < F.col("y.least"))) & (F.col("x.least") != F.col("y.least")))
    pairs = pairs.filter(ring("q1_ratio") & ring("q2_ratio"))
    sides = [F.col(f"{s}.{c}").alias(f"{t}_{c}") for s, t in (("x", "a"), ("y", "b")) for c in _COLUMNS]
    cross = pairs.select(F.col("x.least").alias("doc_a"), F.col("y.least").alias("doc_b"), *sides).mapInArrow(_compare(most), "doc_a bigint, doc_b bigint, difference int")
    cross = cross.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "difference")
    return equal.union(cross).groupBy("doc_a", "doc_b").agg(F.min("difference").alias("difference"))


def with_digests(pairs: DataFrame, docs: DataFrame, most: int = MOST) -> DataFrame:
    """``pairs`` with digest_a and digest_b, of rows that share an id those that differ least."""
    own = digests(docs).filter("doc_id is not null and digest is not null").select("doc_id", *_COLUMNS).distinct()
    side = lambda t: own.select(F.col("doc_id").alias(f"doc_{t}"), *(F.col(c).alias(f"{t}_{c}") for c in _COLUMNS))
    both = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b")
    names = [f"{t}_{c}" for t in "ab" for c in _COLUMNS]
    seen = both.select("doc_a", "doc_b", *names).mapInArrow(_compare_kept(most), "doc_a bigint, doc_b bigint, difference int, digest_a string, digest_b string")
    best = seen.groupBy("doc_a", "doc_b").agg(F.min(F.struct("difference", "digest_a", "digest_b")).alias("best"))
    return best.select("doc_a", "doc_b", "best.difference", "best.digest_a", "best.digest_b")


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents."""
    return digests(table(spark, sf_dir, "documents"))


def op2_like_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of like digests over all documents, with both digests."""
    docs = table(spark, sf_dir, "documents")
    return with_digests(like_pairs(docs), docs)


def _sql() -> str:
    triplets = ", ".join(f"((b{x} * {_A} + b{y} * {_B} + b{z} * {_C} + {k * _K}) * {_MUL} >> 24) & 127" for k, (x, y, z) in enumerate(_TRIPLETS))
    edges, edge = [1], 1
    while edge < 1 << 40:
        edge = edge * 13 // 10 + 1
        edges.append(edge)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(text) AS raw FROM documents),
b AS (SELECT r, unnest(list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS v,
      generate_subscripts(regexp_extract_all(hex(raw), '..'), 1) AS i FROM d WHERE octet_length(raw) >= {LEAST}),
f AS (SELECT r, v AS b0, lead(v, 1) OVER w AS b1, lead(v, 2) OVER w AS b2, lead(v, 3) OVER w AS b3, lead(v, 4) OVER w AS b4
      FROM b WINDOW w AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, unnest([{triplets}]) AS k FROM f WHERE b4 IS NOT NULL),
c AS (SELECT r, list(n ORDER BY k) AS c FROM (SELECT x.r, x.k, count(h.k) AS n
      FROM (SELECT r, unnest(range(128)) AS k FROM d WHERE octet_length(raw) >= {LEAST}) x LEFT JOIN h ON h.r = x.r AND h.k = x.k GROUP BY ALL) GROUP BY r),
q AS (SELECT r, c, list_sort(c)[32] AS q1, list_sort(c)[64] AS q2, list_sort(c)[96] AS q3 FROM c),
t AS (SELECT *, list_transform(c, lambda x: CAST(x > q1 AS INT) + CAST(x > q2 AS INT) + CAST(x > q3 AS INT)) AS s FROM q)
SELECT doc_id, array_to_string(list_transform(range(1, 65), lambda i: '0123456789abcdef'[4 * s[2 * i - 1] + s[2 * i] + 1]), '') AS digest,
  CAST(coalesce(q1, 0) AS INT) AS q1, CAST(coalesce(q2, 0) AS INT) AS q2, CAST(coalesce(q3, 0) AS INT) AS q3,
  CAST(coalesce(q1 * 100 // greatest(q3, 1) % 16, 0) AS INT) AS q1_ratio,
  CAST(coalesce(q2 * 100 // greatest(q3, 1) % 16, 0) AS INT) AS q2_ratio,
  CASE WHEN t.r IS NOT NULL THEN CAST(len(list_filter({edges}, lambda e: e < octet_length(raw))) AS INT) ELSE 0 END AS length_code
FROM d LEFT JOIN t USING (r)"""


SQL = {"op2_quartile_digest": _sql()}
