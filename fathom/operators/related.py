"""Files related to one file, by its symbols, its name and rare shared terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import FILE_TERM_WEIGHT, GENERIC_SYMBOLS, MAX_SHARED_TERMS, RELATED_LIMIT, RELATED_PRIOR, SYMBOL_KINDS, SYMBOL_WEIGHT
from .index import Index

COLUMNS = ["doc_id", "relative_path", "category", "score", "confidence", "symbols", "file_terms", "shared_terms"]


def source_id(index: Index, path: str) -> int:
    """The document at that path, both normalised; the first in order if several are."""
    wanted = paths.normalized(F.regexp_replace(F.lit(path), r"\\", "/"))
    row = index.corpus.where(paths.normalized(F.col("relative_path")) == wanted).orderBy(paths.order(F.col("relative_path"))).select("doc_id").first()
    if row is None:
        raise ValueError(f"no such file in the corpus: {path}")
    return row.doc_id


def related(index: Index, path: str, digits: int | None = None) -> DataFrame:
    """COLUMNS of all related files, unordered."""
    source = source_id(index, path)
    pairs = index.pairs
    is_source = F.col("doc_id") == source
    own = index.symbols_where(is_source).where(is_source & (F.col("visibility") != "Private") & ~F.lower("name").isin(*GENERIC_SYMBOLS))
    first = F.get(text.source_tokens(F.col("name")), 0)["s"]
    names = own.select(F.lower(first).alias("term"), "name", F.struct("line", paths.ordinal(F.col("kind"), SYMBOL_KINDS).alias("k"), "name").alias("o")).where("term is not null")
    names = names.groupBy("term").agg(F.max_by("name", "o").alias("name"))
    stem = index.corpus.where(is_source).select(F.explode(text.terms(paths.stem(F.col("relative_path")))).alias("term"))
    n = index.corpus.agg(F.count(F.lit(1)).alias("n_docs"))
    mine = pairs.where(is_source & (F.length("term") >= 3)).select("term")
    rare = pairs.join(F.broadcast(mine), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, 6))
    weighed = rare.crossJoin(F.broadcast(n)).select("term", F.log(1 + F.col("n_docs") / F.col("df")).alias("w"))
    # One document's symbols, its stem and its rare terms: a small table, which every other document meets once.
    no_name, no_weight = F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("w")
    evidence = names.select("term", "name", no_weight, F.lit("symbol").alias("by")).union(stem.select("term", no_name, no_weight, F.lit("stem"))).union(weighed.select("term", no_name, "w", F.lit("shared")))
    hits = pairs.where(~is_source).join(F.broadcast(evidence), "term")
    of = lambda by, x: F.sort_array(F.collect_list(F.when(F.col("by") == by, x)))
    met = hits.groupBy("doc_id").agg(
        of("symbol", F.struct("term", "name")).alias("s"), of("stem", F.col("term")).alias("file_terms"), of("shared", F.struct((-F.col("w")).alias("order"), "term", "w")).alias("t")
    )
    met = met.withColumn("t", F.slice("t", 1, MAX_SHARED_TERMS))
    total = F.when(F.size("t") > 0, F.aggregate("t", F.lit(0.0), lambda a, x: a + x["w"]))
    met = met.select("doc_id", F.col("s.name").alias("symbols"), "file_terms", F.col("t.term").alias("shared_terms"), total.alias("w"))
    met = met.where((F.size("symbols") > 0) | (F.size("file_terms") > 0) | (F.size("shared_terms") >= 2))
    met = met.join(index.corpus.select("doc_id", "relative_path", "category"), "doc_id")
    s, f, t = F.size("symbols"), F.size("file_terms"), F.size("shared_terms")
    score = s * SYMBOL_WEIGHT + f * FILE_TERM_WEIGHT + F.coalesce("w", F.lit(0.0)) + paths.category_value(F.col("category"), RELATED_PRIOR)
    confidence = F.when((s > 0) & ((f > 0) | (t >= 2)), "High").when((s > 0) | (f > 0) | (t >= 3), "Medium").otherwise("Low")
    return met.withColumns({"score": F.round(score, digits) if digits is not None else score, "confidence": confidence}).select(*COLUMNS)


def ranked(index: Index, path: str, limit: int | None = RELATED_LIMIT, digits: int | None = None) -> DataFrame:
    """The best related files in order."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    found = related(index, path, digits).orderBy(F.desc("score"), paths.order(F.col("relative_path")))
    return found.limit(limit) if limit else found
