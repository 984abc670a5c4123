"""Quality rules as a bitmask ledger.

``ledger`` reads each text once: it measures, evaluates every rule and stores
the outcome of rule i as bit i of ``fail_bits``, beside the measurements. A
policy is a named mask of rules, so a policy's verdict, another version of it,
and the effect of leaving a rule out are bit operations on the ledger and never
go back to the texts. Everything is DataFrame functions; no shuffle before the
ablation's counts, which are over distinct masks.

Three-word windows are told apart by a 64-bit hash chained over the words; two
different windows of one text are taken for equal with a chance of about
windows^2 / 2^65.

Defined results: null and empty text have no words, fail the base rules and are
not kept; repeated rows (ids too) give a row each; extra columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Rules in the order of their bits: name and condition of failure over the measurements.
RULES: list[tuple[str, Column | str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("upper_case", "100 * n_upper > 30 * word_chars"),
    ("no_letters", "2 * n_plain_words < n_words"),
    ("exclamations", "100 * n_exclamations > 30 * n_words"),
]
BASE = ("few_words", "repeated_windows")
#: Versions of the policy: the rules that each applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "duplicate_lines", "word_length", "no_letters"),
    "v2": (*BASE, "symbols", "duplicate_lines", "word_length", "no_letters", "upper_case", "exclamations"),
}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << [n for n, _ in RULES].index(rule)


def mask(rules: Iterable[str]) -> int:
    return sum(bit(r) for r in set(rules))


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def ledger(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, measurements, fail_bits), a row per row of docs."""
    body = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    split = body.select("doc", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _without(F.col("t"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _without(F.col("t"), "\\p{Lu}").cast("long").alias("n_upper"),
        F.size(F.filter("w", lambda x: x.rlike("\\p{L}"))).cast("long").alias("n_plain_words"),
        F.size(F.filter("w", lambda x: x.endswith("!!"))).cast("long").alias("n_exclamations"),
        windows.alias("windows"),
    )
    # Equal windows are neighbours once sorted; a window is repeated if a neighbour is equal. Their places, in order, cover 3 words each.
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = counted.withColumn("s", F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform("s", lambda x, k: F.when((F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]), x["i"])),
        lambda x: x.isNotNull(),
    )
    at = placed.withColumn("at", F.array_sort(twice)).drop("windows", "s")
    gaps = F.zip_with(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(F.lit(0))
    measured = at.withColumn("n_repeat_words", covered.cast("long")).drop("at")
    bits = sum((F.when(F.expr(c) if isinstance(c, str) else c, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, c) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long")).withColumnRenamed("doc", doc)


def verdict(rules: Iterable[str]) -> Column:
    """Whether a ledger's row passes all of the rules."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(rules))) == 0


def apply_policy(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """ledger with ``base_failed`` and ``kept`` under a version of the policy."""
    return ledger.withColumn("base_failed", ~verdict(BASE)).withColumn("kept", verdict((*BASE, *POLICIES[version])))


def ablation(ledger: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(policy, rule, failed, only, kept_without): rows that fail a rule, those failing it alone, and those kept if it is left out."""
    masks = ledger.groupBy("fail_bits").count()  # a row per distinct mask
    out = None
    for name, rules in (policies or POLICIES).items():
        own = F.col("fail_bits").bitwiseAND(F.lit(mask(rules)))
        for r in rules:
            one = masks.agg(
                F.coalesce(F.sum(F.when(own.bitwiseAND(F.lit(bit(r))) != 0, F.col("count"))), F.lit(0)).alias("failed"),
                F.coalesce(F.sum(F.when(own == bit(r), F.col("count"))), F.lit(0)).alias("only"),
                F.coalesce(F.sum(F.when(own.bitwiseAND(F.lit(mask(rules) ^ bit(r))) == 0, F.col("count"))), F.lit(0)).alias("kept_without"),
            ).select(F.lit(name).alias("policy"), F.lit(r).alias("rule"), "failed", "only", "kept_without")
            out = one if out is None else out.union(one)
    return out


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
p AS (SELECT rid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM p),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS q FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS wc,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper,
        len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_plain, len(list_filter(w, lambda x: x LIKE '%!!')) AS n_excl
      FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_upper > 30 * word_chars OR 2 * n_plain < n_words OR 100 * n_excl > 30 * n_words) AS kept
FROM b
"""
