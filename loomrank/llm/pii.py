"""Personal and secret identifiers by bootstrapped contextual extraction.

1. Candidates: runs without white space that hold a digit or '@', over the whole text.  Neighbouring runs of digits and
   telephone marks are one candidate, as in ``+1 (555) 010-9999``.  Of ``name=value`` and ``name = "value"`` the value
   is the candidate and the name goes to its left context.  Where a strict rule matches inside a run, as in JSON, HTML,
   URLs and lists, the match is a candidate and so is each part of the run beside it; values of names like
   ``password`` are candidates without a digit too.
2. Seeds: candidates that strict rules know, such as mail addresses, dotted quads, numbers with a Luhn digit, numbers
   with a country code, well-known key prefixes, and values of names like ``password``.
3. Patterns: a candidate's shapes (letters, digits and marks in order, with run lengths and without), and the words to
   its left and right with the coarse shape.  An edge joins a pattern with each distinct value it meets.
4. Spark scores the graph of patterns and values in turns: a pattern's confidence in a kind is the mean score of its
   values, with ``PRIOR`` values of score 0 added; a value's score is the best confidence of its patterns, and 1 for
   seeds.  Only patterns of ``SUPPORT`` values take part.  After ``ROUNDS`` turns values with a score of ``ACCEPT`` are
   found, seeds and unseen ones alike, wherever they stand.

Counts cover every candidate of every document; the graph is written in the shared folder between turns.

Result: (doc_id, start, end, kind, value, score, seed), start and end in characters of the text, one row for each place.

Nulls: a null or empty text has no rows.  A null id stays null, repeated rows are read each by itself (their values
count once in the graph), an empty table gives an empty result; other columns, whatever their names, are not read and pass
through ``mask``.  Ties between kinds go to
the first by name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, small, small_batches, table, written
from ._text import blocks, utf8

ROUNDS, SUPPORT, PRIOR, ACCEPT = 3, 3, 1.0, 0.5
PLACES = "doc_id bigint, start int, end int, value string, kind string, patterns array<string>"
SPANS = "doc_id bigint, start int, end int, kind string, value string, score double, seed boolean"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
RULES: list[tuple[str, re.Pattern]] = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")),
    ("ip", re.compile(rf"{_OCTET}(?:\.{_OCTET}){{3}}")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}")),
    ("secret", re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}")),
]
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}")
_NAMES = re.compile(r"(?:^|[^a-z])(?:password|passwd|pwd|secret|token|api_?key|access_?key)$")
#: the rules as they stand within a text
_INSIDE = [
    re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{RULES[0][1].pattern})(?![A-Za-z0-9-]|\.[A-Za-z0-9])"),
    re.compile(rf"(?<![\w.])(?:{RULES[1][1].pattern})(?!\w|\.\w)"),
    re.compile(rf"(?<![\w+])(?:{RULES[2][1].pattern})(?!\w|[.-]\d)"),
    re.compile(rf"(?<![A-Za-z0-9])(?:{RULES[3][1].pattern})(?![A-Za-z0-9])"),
]
_CARD_INSIDE = re.compile(rf"(?<![\w.+-]){_CARD.pattern}(?![\w-]|\.\d)")
_NAME = r"(?:password|passwd|pwd|secret|token|api_?key|access_?key)"
_NAMED = re.compile(rf"""(?i)(?<![a-z])({_NAME})["']?\s*(?::=|=|:)\s*(?:"([^"\s]{{8,}})"|'([^'\s]{{8,}})'|([^\s"'<>{{}}]{{8,}}))""")
_ENDS = "*&$%#!.,;:?\"')]}>|"
_NUMBERISH = re.compile(r"[+(]*\d[\d().+/-]*")
_RUN = re.compile(r"[A-Z]+|[a-zß-ÿ]+|\d+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def seed_kind(value: str, left: str) -> str | None:
    """The kind that strict rules give a value, if any."""
    for kind, rule in RULES:
        if rule.fullmatch(value):
            return kind
    if _CARD.fullmatch(value) and luhn(re.sub(r"\D", "", value)):
        return "card"
    if len(value) >= 8 and _NAMES.search(left):
        return "secret"
    return None


def shape(value: str, fine: bool) -> str:
    """Runs of capitals, small letters and digits as A, a and 9, with their lengths if ``fine``; marks as they are."""
    out = []
    for run in _RUN.findall(value):
        c = run[0]
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        out.append(k + (str(len(run)) if fine and k in "9Aa" else ""))
    return "".join(out)


def coarse(value: str) -> str:
    """The kinds of characters and the length's power of two: for values whose runs vary, as of hex digits."""
    kinds = "".join(k for k, test in (("A", str.isupper), ("a", str.islower), ("9", str.isdigit)) if any(map(test, value)))
    marks = "".join(sorted({c for c in value if not c.isalnum()}))
    if not marks and kinds in ("a9", "9") and re.fullmatch("[0-9a-f]+", value):
        kinds = "x"
    return f"{kinds}{marks}:{len(value)}" if len(value) <= 64 else f"{kinds}{marks}:{len(value).bit_length()}*"


def patterns_of(value: str, left: str, right: str) -> list[str]:
    c, runs = coarse(value), shape(value, False)
    general = ["S" + runs] if len(runs) > 3 else []  # of one or two runs the lengths tell all
    return [*general, "F" + shape(value, True), "C" + c, "L" + left + "|" + c, "R" + right + "|" + c]


def _hits(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))


def _part(run: str) -> bool:
    """Whether a run may be part of a number written in groups."""
    return bool(_NUMBERISH.fullmatch(run)) and sum(map(str.isdigit, run)) <= 7


def _inside(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of each place that a strict rule takes, apart from cards; the earlier and longer ones first."""
    found = [(*m.span(), "") for rule in _INSIDE for m in rule.finditer(text)]
    for m in _NAMED.finditer(text):
        a, b = m.span(m.lastindex)
        while m.lastindex == 4 and b > a and text[b - 1] in _ENDS:
            b -= 1
        if b - a >= 8:
            found.append((a, b, m.group(1).lower()))
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _pieces(text: str, spans: list[list[int]], inside: list[tuple[int, int, str]]):
    """(start, end, name, whether a rule took it) of the places in ``inside`` and of what they leave of the spans."""
    left, k = [], 0
    for a, b, _ in spans:
        while k and inside[k - 1][1] > a:
            k -= 1
        while k < len(inside) and inside[k][0] < b:
            x, y, _ = inside[k]
            if y > a:
                if x > a:
                    left.append((a, x))
                a = max(a, y)
            k += 1
        if a < b:
            left.append((a, b))
    out = [(a, b, name, True) for a, b, name in inside]
    for a, b in left:
        for m in _CARD_INSIDE.finditer(text, a, b):
            if luhn(re.sub(r"\D", "", m.group())):
                if m.start() > a:
                    out.append((a, m.start(), "", False))
                out.append((*m.span(), "", True))
                a = m.end()
        if a < b:
            out.append((a, b, "", False))
    return sorted(out)


def candidates(text: str):
    """(start, end, value, name or left, left, right) of each candidate of a text."""
    spans: list[list[int]] = []  # start, end, start of the last run
    for m in re.finditer(r"[0-9@]\S*", text):
        a = m.start()
        if spans and a < spans[-1][1]:
            continue
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        if spans and a - spans[-1][1] == 1 and text[a - 1] == " " and _part(text[a:b].rstrip(".,;:!?*&$%#")) and _part(text[spans[-1][2] : spans[-1][1]]) and sum(map(str.isdigit, text[spans[-1][0] : b])) < 20:
            spans[-1][1:] = b, a
        else:
            spans.append([a, b, a])
    for a, b, name, sure in _pieces(text, spans, _inside(text)):
        if sure and not name:
            eq = re.search(r"([\w.-]*[A-Za-z][\w.-]*)\s*[=:]\s*[\"']?$", text[max(0, a - 80) : a])
            name = eq.group(1).lower() if eq and not eq.group().endswith(" ") else ""
        elif not sure:
            eq = re.match(r"(?=[\w.-]*?[A-Za-z])([\w.-]++)\s*[=:]\s*(?=\S)", text[a:b])
            if eq and eq.end() < b - a:
                name, a = eq.group(1).lower(), a + eq.end()
            while b > a and text[b - 1] in _ENDS:
                if text[b - 1] == ")" and "(" in text[a:b]:
                    break
                b -= 1
            while a < b and text[a] in "\"'[{<*&$%#!,;:|" or (a < b and text[a] == "(" and ")" not in text[a:b]):
                a += 1
        value = text[a:b]
        if not value or not (sure or any(c.isdigit() or c == "@" for c in value)):
            continue
        before = text[max(0, a - 80) : a].rstrip("\"'").split()
        after = text[b : b + 40].split()
        if not name and len(before) >= 2 and before[-1].strip("\"'") in ("=", ":", ":="):
            name = before[-2].lower().strip("\"'")
        left = name + "=" if name else before[-1].lower().strip("\"'*&$%#!.,;") if before else "^"
        yield a, b, value, name or left, left, (after[0].lower() if after else "$")


def _places(batches):
    for batch in blocks(batches):
        data, offsets = utf8(batch.column("text"))
        named = pc.fill_null(pc.match_substring_regex(batch.column("text"), _NAME, ignore_case=True), False).to_numpy(zero_copy_only=False)
        hit = np.union1d(np.searchsorted(offsets, _hits(data), "right") - 1, np.flatnonzero(named))
        rows = []
        for i in hit.tolist():
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
            for a, b, value, name, left, right in candidates(text):
                rows.append((i, a, b, value, seed_kind(value, name), patterns_of(value, left, right)))
        if rows:
            i, a, b, value, kind, patterns = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(i)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value), pa.array(kind, pa.string()), pa.array(patterns, pa.list_(pa.string()))],
                ["doc_id", "start", "end", "value", "kind", "patterns"],
            )


def scored_values(places: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, prior: float = PRIOR) -> DataFrame:
    """(value, kind, score) from the graph of patterns and values; ``places`` has value, kind (of seeds) and patterns."""
    value = F.xxhash64("value").alias("v")
    seeds = written(places.filter("kind is not null").groupBy(value).agg(F.min("kind").alias("kind")), "pii-seeds")
    edges = places.select(value, F.explode("patterns").alias("p")).select("v", F.xxhash64("p").alias("p")).distinct()
    size = edges.groupBy("p").agg(F.count("*").alias("size")).filter(F.col("size") >= support)
    edges = written(edges.join(size, "p"), "pii-graph")
    score = seeds.withColumn("score", F.lit(1.0))
    best = Window.partitionBy("v").orderBy(F.desc("score"), "kind")
    for _ in range(rounds):
        trust = edges.join(score, "v").groupBy("p", "kind", "size").agg(F.sum("score").alias("sum"))
        trust = trust.select("p", "kind", (F.col("sum") / (F.col("size") + prior)).alias("score"))
        found = edges.join(trust, "p").groupBy("v", "kind").agg(F.max("score").alias("score"))
        known = seeds.select("v", "kind", F.lit(1.0).alias("score"))
        all_ = found.join(seeds.select("v"), "v", "left_anti").unionByName(known)
        score = written(all_.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k"), "pii-scores")
    return score


def find_identifiers(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, prior: float = PRIOR, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, start, end, kind, value, score, seed); see the module's text."""
    small_batches(docs.sparkSession)
    places = written(documents(docs).filter("text is not null").mapInArrow(_places, PLACES), "pii-places")
    score = scored_values(places, rounds, support, prior).filter(F.col("score") >= accept)
    found = places.withColumnRenamed("kind", "own").withColumn("v", F.xxhash64("value")).join(score, "v")
    return found.select("doc_id", "start", "end", "kind", "value", F.round("score", 6).alias("score"), F.col("own").isNotNull().alias("seed"))


def _masked(names: list[str]):
    """Masks column number k as c<k>, in the place of ``names``; spans come last."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names))]
            at = names.index("text")
            text, spans = columns[at].to_pylist(), batch.column(len(names)).to_pylist()
            for i, own in enumerate(spans):
                if own and text[i] is not None:
                    parts, end = [], 0
                    for s in own:
                        if s["start"] >= end and text[i][s["start"] : s["end"]] == s["value"]:
                            parts += [text[i][end : s["start"]], f"[{s['kind'].upper()}]"]
                            end = s["end"]
                    text[i] = "".join(parts) + text[i][end:]
            columns[at] = pa.array(text, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([len(t) if t is not None else None for t in text]).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(names))])

    return run


def mask(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the identifiers of ``found`` replaced by ``[KIND]`` in text, n_chars counted again; all rows and columns stay.

    Rows that share an id are masked at the places where their own text holds the value.  Columns may have any names.
    """
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind", "value"))).alias("spans"))
    spans = written(spans, "pii-spans")
    own = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    joined = own.join(small(spans, 1 << 17), own[f"c{docs.columns.index('doc_id')}"].eqNullSafe(spans["doc_id"]), "left").drop("doc_id")
    return joined.mapInArrow(_masked(docs.columns), own.schema).toDF(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_identifiers(table(spark, sf_dir, "documents"))
