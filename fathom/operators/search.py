"""Ranked search: BM25 plus boosts for file names, paths, symbols and categories."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import B, CATEGORY_ALIASES, FILE_NAME_BOOST, K1, PATH_BOOST, SEARCH_PRIOR, SYMBOL_BOOST
from .index import Index

COLUMNS = ["doc_id", "relative_path", "category", "line", "score", "bm25", "file_name", "path", "exact_symbol", "category_boost", "matched_terms", "snippet"]


@dataclass
class Filters:
    """Applied after ranking over the whole corpus: any of a list, all of the kinds."""

    categories: Iterable[str] = ()
    path: str | None = None
    extensions: Iterable[str] = ()
    limit: int | None = None
    active: bool = field(init=False)

    def __post_init__(self):
        self.categories = tuple(dict.fromkeys(CATEGORY_ALIASES.get(c.strip().lower(), c) for c in self.categories))
        self.path = (self.path or "").strip().lower() or None
        self.extensions = tuple(dict.fromkeys(e for e in (x.strip().lstrip(".").lower() for x in self.extensions) if e))
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit must be at least 1")
        self.active = bool(self.categories or self.path or self.extensions or self.limit)

    def apply(self, results: DataFrame) -> DataFrame:
        if self.categories:
            results = results.where(F.col("category").isin(*self.categories))
        if self.path:
            results = results.where(F.contains(F.lower("relative_path"), F.lit(self.path)))
        if self.extensions:
            results = results.where(F.coalesce(F.lower(paths.extension(F.col("relative_path"))).isin(*self.extensions), F.lit(False)))
        return results


def query_groups(spark: SparkSession, query: str) -> list[list[str]]:
    """The distinct terms of each token of a query, by the corpus's own tokenizer."""
    one = spark.createDataFrame([(query,)], "q string").select(F.transform(text.source_tokens(F.col("q")), lambda t: text.variants(t["s"])).alias("g"))
    return [sorted(set(g)) for g in one.first().g]


def exact_names(query: str, names: Column) -> Column:
    """Whether a symbol's name stands in the query between characters that aren't part of names."""
    found = F.array_contains(text.identifiers(F.lit(query)), names)
    literal = F.rlike(F.lit(query), F.concat(F.lit(rf"(?<!{text.NAME[:-1]})\Q"), names, F.lit(rf"\E(?!{text.NAME[:-1]})")))
    return F.when(names.rlike(f"^{text.NAME}$"), found).otherwise(literal)


def symbols_named(index: Index, query: str) -> DataFrame:
    """The symbols whose exact names stand in the query. A named symbol's file holds the name, so other files aren't parsed; an <anonymous> one has none to look for."""
    words = index.spark.createDataFrame([(query,)], "q string").select(text.identifiers(F.col("q")).alias("w")).first().w
    held = F.lit(True) if "<anonymous>" in query else reduce(lambda a, b: a | b, (F.contains(F.col("content"), F.lit(w)) for w in dict.fromkeys(words)), F.lit(False))
    return index.symbols_where(held).where(exact_names(query, F.col("name")))


def bm25(tf: Column, df: Column, length: Column, n_docs: Column, avg_len: Column) -> Column:
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))
    return F.when((n_docs == 0) | (avg_len == 0), 0.0).otherwise(idf * weight)


def _groups_in(groups: list[list[str]], terms: Column) -> Column:
    hit = lambda g: F.arrays_overlap(terms, F.array(*map(F.lit, g))).cast("int")
    return F.coalesce(sum((hit(g) for g in groups), F.lit(0)), F.lit(0)).cast("double")


def search(index: Index, query: str, match_all: bool = False) -> DataFrame:
    """All results, unordered: COLUMNS. Empty for a query without terms."""
    spark = index.spark
    groups = query_groups(spark, query)
    wanted = sorted({t for g in groups for t in g})
    hits = index.frequencies_of(wanted)
    # A row per query term: its document frequency and the groups it is in. It reads all columns of hits, so that both use one exchange.
    of = F.create_map(*(x for t in wanted for x in (F.lit(t), F.array(*(F.lit(i) for i, g in enumerate(groups) if t in g))))) if wanted else F.create_map().cast("map<string,array<int>>")
    df = hits.groupBy("term").agg(F.sum(F.when((F.col("tf") > 0) & F.col("first_line").isNotNull(), 1)).alias("df"))
    rolled = hits.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "df"))).alias("m"), F.min("first_line").alias("line"))
    if match_all:
        rolled = rolled.where(F.size(F.array_distinct(F.flatten(F.transform("m", lambda x: F.element_at(of, x["term"]))))) == len(groups))
    # Other texts can't be results, so their words aren't counted and they aren't carried to the join.
    docs = index.documents if index.saved else index.documents.where(text.may_have(F.col("content"), wanted))
    met = rolled.join(docs, "doc_id").crossJoin(F.broadcast(index.stats))
    part = lambda x: bm25(x["tf"], x["df"], F.col("token_count"), F.col("n_docs"), F.col("avg_len"))
    met = met.withColumns({"matched_terms": F.col("m.term"), "bm25": F.aggregate("m", F.lit(0.0), lambda a, x: a + part(x))})
    names = symbols_named(index, query).groupBy("doc_id").agg(F.countDistinct("name").alias("names"))
    met = met.join(names, "doc_id", "left")
    factors = met.withColumns({
        "file_name": _groups_in(groups, text.terms(paths.stem(F.col("relative_path")))) * FILE_NAME_BOOST,
        "path": _groups_in(groups, text.terms(paths.parent(F.col("relative_path")))) * PATH_BOOST,
        "exact_symbol": F.coalesce("names", F.lit(0)) * SYMBOL_BOOST,
        "category_boost": paths.category_value(F.col("category"), SEARCH_PRIOR),
        "snippet": text.snippet(F.col("content"), F.col("line")),
    })
    total = F.col("bm25") + F.col("file_name") + F.col("path") + F.col("exact_symbol") + F.col("category_boost")
    return factors.withColumn("score", total).select(*COLUMNS)


def ordered(results: DataFrame) -> list[Column]:
    return [F.desc("score"), paths.order(F.col("relative_path"))]


def ranked(index: Index, query: str, match_all: bool = False, filters: Filters | None = None, digits: int | None = None) -> DataFrame:
    """(rank, *COLUMNS), filtered, limited and in order. digits: decimals to which scores are rounded before they are compared."""
    filters = filters or Filters()
    results = filters.apply(search(index, query, match_all))
    if digits is not None:
        results = results.withColumns({c: F.round(c, digits) for c in ("score", "bm25")})
    if filters.limit:
        results = results.orderBy(*ordered(results)).limit(filters.limit)
    rank = F.row_number().over(Window.orderBy(*ordered(results)))
    return results.withColumn("rank", rank).select("rank", *COLUMNS).orderBy("rank")


