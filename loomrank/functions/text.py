"""Text expressions: Spark columns, all built in, that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: function words that every passage has
STOPWORDS = tuple("will with were was to they those these this their the that or on of not its it is in he has from for by but be at as are and an a".split())
SPACE = r"\s\x{85}\p{Z}"


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more, without function words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)), F.lower)
    return F.filter(found, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOPWORDS))


def fields(text: Column) -> Column:
    """Runs without white space, Unicode white space included."""
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def one_line(text: Column) -> Column:
    return F.array_join(fields(text), " ")


def first_words(text: Column, n: int) -> Column:
    """The first n words, with an ellipsis if there are more."""
    words = fields(text)
    return F.when(F.size(words) <= n, text).otherwise(F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("...")))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def line_slice(text: Column, first: int | None, last: int | None) -> Column:
    """Lines first to last, counted from 1, both included; bounds outside the text are moved to its edges."""
    lines = F.split(text, "\n")
    size = F.size(lines)
    a = F.greatest(F.lit(1), F.lit(first or 1))
    b = F.least(size, F.lit(last)) if last else size
    return F.when(a > b, F.lit("")).otherwise(F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n"))


def byte_clip(text: Column, budget: int) -> Column:
    """The longest prefix of whole characters within a budget of bytes."""
    # a character has at most 4 bytes: of the prefixes of budget/4 .. budget characters the longest that fits
    whole = F.octet_length(text) <= budget
    raw = F.substring(F.encode(text, "UTF-8"), 1, budget)
    cut = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "(?:[\\u00C0-\\u00FF]|[\\u00E0-\\u00FF][\\u0080-\\u00BF]|[\\u00F0-\\u00FF][\\u0080-\\u00BF]{2})$", "")
    last = F.substring(F.encode(text, "UTF-8"), budget + 1, 1)
    inside = F.hex(last).rlike("^[89AB]")
    return F.when(whole, text).when(inside, F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")).otherwise(F.decode(raw, "UTF-8"))


def snippet(text: Column, budget: int) -> Column:
    """White space collapsed, at most budget bytes, cut at the last space if it lies in the second half."""
    line = one_line(text)
    head = byte_clip(line, budget)
    stem = F.regexp_extract(head, "^(.*) ", 1)
    return F.when(F.octet_length(line) <= budget, line).otherwise(F.concat(F.when(F.octet_length(stem) > budget // 2, stem).otherwise(head), F.lit("...")))


def metadata(meta: Column, keys: list[str]) -> Column:
    """``k: v, k: v`` of the keys that a JSON object has."""
    parts = [F.when(F.get_json_object(meta, f"$.{k}").isNotNull(), F.concat(F.lit(f"{k}: "), F.get_json_object(meta, f"$.{k}"))) for k in keys]
    return F.concat_ws(", ", *parts)


def answer_words(text: Column) -> Column:
    """Words of an answer, lower-cased, without marks and articles."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    return F.filter(words, lambda t: ~t.isin("a", "an", "the"))


def answer_sentences(text: Column, most: int = 8) -> Column:
    """Sentences of four words or more, at most ``most`` of them."""
    marked = F.regexp_replace(text, r"([.!?])(?=[ \n]|$)", "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), lambda x: F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+$", ""))
    return F.slice(F.filter(parts, lambda x: F.size(fields(x)) >= 4), 1, most)


def depends_on_history(query: Column) -> Column:
    """Whether a message is short or points back at what was said."""
    words = "it its they them their that those these this he she his her one ones".split()
    padded = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    return (F.size(fields(query)) <= 4) | padded.rlike(" (?:" + "|".join(words) + ") ")
