"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, copyright lines taken out,
equivalent spellings made one, everything but letters and digits made single
spaces. The SHA-256 of the form is looked up by a hash join in the table of
known texts' digests, which is as small as the list of known texts and therefore
sent to every task. Entire documents are looked up; so is each entire line that
speaks of a licence, for one-line notices. All of it is DataFrame functions, a
single pass without a shuffle.

What is not found so is looked up in a second form, of which copyright
statements alone are taken out, not their lines: from the mark, over a year, to
the end of the sentence or line or the start of a known text. The digest given
is that of the form that was found, else of the first.

Defined results: each document has a row of scope ``text``, whose license_id is
null if its text is no known one; each known line has a further row of scope
``line``. Null text is the empty text; a text that is empty in its canonical form
is never a known one; repeated rows give their rows each; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

#: A line that says this may be a notice. Each known notice does.
MENTION = "(?i)licen[cs]e|public domain|copyright"
COPYRIGHT = "(?m)^[^\\n]*(copyright (\\(c\\)|©|[0-9])|\\(c\\) [0-9]|©|all rights reserved)[^\\n]*$"

#: A copyright statement in lower case. Periods within words, and after initials and the like, end no sentence; up to 200 characters stand before and after the year.
_SHORT = "\\b(?:\\p{L}|inc|ltd|corp|co|llc|jr|al)"
_SAID = f"(?:[^\\n.]|\\.(?=[^\\s])|(?<={_SHORT})\\.)"
_YEAR = "(?:(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])|<year>|\\[year\\]|\\[yyyy\\])"
_START = "permission is hereby granted|permission to use|permission is granted|redistribution and use|(?:dual[ -])?licen[cs]ed under|released under|this (?:project|work|software|program|file) is|spdx-|all rights reserved"
STATEMENT = f"(?:(?:copyright|\\(c\\)|©){_SAID}{{0,200}}?{_YEAR}{_SAID}{{0,200}}?(?:(?<!{_SHORT})\\.(?=\\s|$)|(?=\\n|$)|(?=\\b(?:{_START}))))|all rights reserved\\.?"


def canonical(text: Column, without: str = COPYRIGHT) -> Column:
    """Words with two spaces between, so that neighbouring spellings don't share one, until the spellings are made one."""
    out = F.regexp_replace(F.lower(text), without, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^\\p{L}\\p{N}]+", "  "), F.lit(" "))
    for ours, theirs in SPELLINGS:
        out = F.replace(out, F.lit(_spaced(theirs)), F.lit(_spaced(ours)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: Column, without: str = COPYRIGHT) -> Column:
    return F.sha2(canonical(text, without), 256)


def known(spark, texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(scope, digest, license_id): a row per known text; those known by digest alone are among them if texts is not given."""
    rows = [("text", k, v) for k, v in (TEXTS if texts is None else texts).items()] + [("line", k, v) for v, k in (NOTICES if notices is None else notices).items()]
    out = spark.createDataFrame(rows, "scope string, license_id string, body string").select("scope", digest(F.col("body")).alias("digest"), "license_id")
    if texts is None:
        out = out.union(spark.createDataFrame([("text", d, k) for d, k in DIGESTS.items()], out.schema))
    return out.dropDuplicates(["scope", "digest"])


def scan(docs: DataFrame, doc: str = "doc_id", text: str = "text", registry: DataFrame | None = None) -> DataFrame:
    """(doc, scope, line, digest, license_id); line counts from 1, 0 for the whole text."""
    registry = known(docs.sparkSession) if registry is None else registry
    body = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    unit = lambda scope, line, part: F.struct(F.lit(scope).alias("scope"), line.cast("int").alias("line"), part.alias("part"))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x, i: unit("line", i + 1, x)), lambda u: u["part"].rlike(MENTION))
    units = F.concat(F.array(unit("text", F.lit(0), F.col("t"))), F.when(F.col("t").rlike(MENTION), lines).otherwise(F.slice(lines, 1, 0)))
    rows = body.select("doc", F.explode(units).alias("u")).select("doc", "u.scope", "u.line", F.col("u.part").alias("part"))
    second = F.when(F.lower("part").rlike(STATEMENT), digest(F.col("part"), STATEMENT))
    rows = rows.select("doc", "scope", "line", digest(F.col("part")).alias("digest"), second.alias("second"))
    other = registry.select("scope", F.col("digest").alias("second"), F.col("license_id").alias("other_id"))
    found = rows.join(F.broadcast(registry), ["scope", "digest"], "left").join(F.broadcast(other), ["scope", "second"], "left")
    by_second = F.col("license_id").isNull() & F.col("other_id").isNotNull()
    found = found.withColumns({"digest": F.when(by_second, F.col("second")).otherwise(F.col("digest")), "license_id": F.coalesce("license_id", "other_id")})
    found = found.where((F.col("scope") == "text") | F.col("license_id").isNotNull())
    return found.select(F.col("doc").alias(doc), "scope", "line", "digest", "license_id")


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{COPYRIGHT}', ' ', 'g')"
    out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for ours, theirs in SPELLINGS:
        out = f"replace({out}, '{_spaced(theirs)}', '{_spaced(ours)}')"
    return f"trim(replace({out}, '  ', ' '))"


def _sql_values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join([f"('text', {quote(k)}, {quote(v)})" for k, v in TEXTS.items()] + [f"('line', {quote(k)}, {quote(v)})" for v, k in NOTICES.items()])


ORACLE_SQL = f"""
WITH known AS (SELECT DISTINCT scope, license_id, sha256({_sql_canonical("body")}) AS digest FROM (VALUES {_sql_values()}) AS v(scope, license_id, body)),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
units AS (SELECT doc_id, 'text' AS scope, 0 AS line, coalesce(text, '') AS part FROM documents
  UNION ALL SELECT doc_id, 'line' AS scope, line, part FROM lines WHERE regexp_matches(part, '{MENTION}')),
d AS (SELECT doc_id, scope, line::INTEGER AS line, sha256({_sql_canonical("part")}) AS digest FROM units)
SELECT doc_id, scope, line, digest, license_id FROM d LEFT JOIN known USING (scope, digest) WHERE scope = 'text' OR license_id IS NOT NULL
"""
