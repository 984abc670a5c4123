"""Column builders: the tokenizer, line snippets and identifiers. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = r"[a-zA-Z0-9\p{IsAlphabetic}\p{N}]+"
TOKEN = r"[a-zA-Z0-9\p{IsAlphabetic}\p{N}](?:[a-zA-Z0-9_\-\p{IsAlphabetic}\p{N}]*[a-zA-Z0-9\p{IsAlphabetic}\p{N}])?"
NAME = r"[\p{IsAlphabetic}\p{N}_]+"
CAMEL = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"


def words(text: Column) -> Column:
    """array<string>: the raw tokens of a text in order, without marks at either end. A token of marks only does not count."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def source_tokens(text: Column) -> Column:
    """array<struct<s,line>>: the raw tokens of a text in order, with 1-based lines."""
    of_line = lambda line, n: F.transform(words(line), lambda t: F.struct(t.alias("s"), (n + 1).cast("int").alias("line")))
    return F.flatten(F.transform(F.split(text, "\n", -1), of_line))


def variants(token: Column) -> Column:
    """The lower-cased token, then its snake, kebab and camel parts that differ from what came before."""
    cut = "[_-]|" + CAMEL
    parts = F.array_remove(F.split(F.lower(F.regexp_replace(token, cut, "\n")), "\n", -1), "")
    return F.when(token.rlike(cut), F.array_distinct(F.concat(F.array(F.lower(token)), parts))).otherwise(F.array(F.lower(token)))


def bag(text: Column) -> Column:
    """The distinct terms of a text of any length, without their places. Sigma and dotted I are lower-cased by what stands beside them, so texts with these are cut first."""
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(text, CAMEL, "\n")), F.lit(PART), F.lit(0))
    return F.when(text.rlike("[\u0130\u03a3]"), terms(text)).otherwise(F.array_distinct(F.concat(words(F.lower(text)), parts)))


def may_have(text: Column, terms: list[str]) -> Column:
    """True for every text with one of the terms, and for others in which one stands within a word; reads the text once per term."""
    plain = lambda x: F.translate(x, "\u03c2", "\u03c3")
    few = [t for t in terms if not any(o != t and o in t for o in terms)]
    low = plain(F.lower(text)) if any(c in t for t in few for c in "\u03c2\u03c3") else F.lower(text)
    hits = [F.contains(low, F.lit(t.replace("\u03c2", "\u03c3"))) for t in few]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def terms(text: Column) -> Column:
    """The distinct terms of a short text: all variants of all tokens."""
    return F.array_distinct(F.flatten(F.transform(source_tokens(text), lambda t: variants(t["s"]))))


def trimmed(text: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def snippet(content: Column, line: Column) -> Column:
    """The trimmed line of that number from 1; null if there is none."""
    body = F.regexp_replace(content, "\r?\n$", "")
    found = F.when((line >= 1) & (F.length(content) > 0), F.get(F.split(body, "\r?\n", -1), (line - 1).cast("int")))
    return trimmed(found)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME), F.lit(0))
