"""The inverted index as a bundle of DataFrames over one corpus.

documents(doc_id, relative_path, content) is all that is needed; the rest is
derived lazily, or read back from saved tables. Nothing is collected: corpus
statistics stay one-row tables, and postings can be read term by term.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import CATEGORIES, LABELS
from .symbols import extract_symbols


class Index:
    TABLES = ("documents", "postings", "term_df", "symbols", "parse_failures")

    def __init__(self, corpus: DataFrame, category: str | None = None):
        """category: a column with the category where the path isn't to give it."""
        role = F.col(category) if category else paths.category(F.col("relative_path"))
        self.corpus = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "relative_path", role.alias("category"), "content")
        self.spark: SparkSession = corpus.sparkSession
        self.saved = False

    @cached_property
    def documents(self) -> DataFrame:
        """(doc_id, relative_path, category, content, token_count); texts of null have no tokens."""
        n = F.regexp_count(F.col("content"), F.lit(text.TOKEN))
        return self.corpus.withColumn("token_count", F.when(F.col("content").isNull(), 0).otherwise(n).cast("long"))

    @cached_property
    def _keyed(self) -> bool:
        """Whether no two documents share a doc_id: then all postings of a document come from one row, and need no exchange."""
        return self.corpus.groupBy("doc_id").count().where("count > 1").isEmpty()

    @cached_property
    def tokens(self) -> DataFrame:
        """(doc_id, term, position from 0, line from 1); the variants of a token share both."""
        return self._tokens_of(self.corpus)

    def _tokens_of(self, docs: DataFrame) -> DataFrame:
        raw = docs.select("doc_id", F.posexplode(text.source_tokens(F.col("content"))).alias("position", "t"))
        return raw.select("doc_id", "position", F.col("t.line").alias("line"), F.explode(text.variants(F.col("t.s"))).alias("term")).select("doc_id", "term", "position", "line")

    @cached_property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, positions, lines, first_line)"""
        if self._keyed:
            return self._postings_in_rows()
        return self._gathered(self.tokens)

    @staticmethod
    def _gathered(tokens: DataFrame) -> DataFrame:
        places = F.array_sort(F.collect_list(F.struct("position", "line")))
        return tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), places.alias("p"), F.min("line").alias("first_line")).select(
            "term", "doc_id", "tf", F.col("p.position").alias("positions"), F.col("p.line").alias("lines"), "first_line"
        )

    def _postings_in_rows(self) -> DataFrame:
        """The same where each document is one row: its places sorted by term, and cut where the term changes."""
        of_token = lambda t, i: F.transform(text.variants(t["s"]), lambda v: F.struct(v.alias("term"), i.alias("position"), t["line"].alias("line")))
        places = F.sort_array(F.flatten(F.transform(text.source_tokens(F.col("content")), of_token)))
        term = lambda i: F.get("s", i)["term"]
        cuts = F.filter(F.sequence(F.lit(0), F.size("s")), lambda i: (i == 0) | (i == F.size("s")) | (term(i) != term(i - 1)))

        def group(at, k):
            end = F.get("cuts", k + 1)
            run = F.sequence(at, end - 1)
            each = lambda name: F.transform(run, lambda i: F.get("s", i)[name])
            first = F.get("s", at)
            return F.struct(first["term"].alias("term"), (end - at).cast("long").alias("tf"), each("position").alias("positions"), each("line").alias("lines"), first["line"].alias("first_line"))

        cut = self.corpus.select("doc_id", places.alias("s")).where(F.size("s") > 0).select("doc_id", "s", cuts.alias("cuts"))
        groups = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), group)
        return cut.select("doc_id", F.explode(groups).alias("g")).select("g.term", "doc_id", "g.tf", "g.positions", "g.lines", "g.first_line")

    @cached_property
    def frequencies(self) -> DataFrame:
        """(term, doc_id, tf, first_line): postings without their places, which need no gathering."""
        return self._counted(self.tokens)

    @staticmethod
    def _counted(tokens: DataFrame) -> DataFrame:
        return tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.min("line").alias("first_line"))

    def frequencies_of(self, terms: list[str]) -> DataFrame:
        """The frequencies of some terms. Texts in which none of them stands are not cut into tokens."""
        if self.saved:
            return self.frequencies.where(F.col("term").isin(*terms))
        docs = self.corpus.where(text.may_have(F.col("content"), terms))
        if self.corpus.where("doc_id is null").isEmpty():
            docs = docs.where("doc_id is not null")  # as a join on doc_id adds it: plans that join these rows share their exchange with those that count them
        return self._counted(self._tokens_of(docs).where(F.col("term").isin(*terms)))

    @cached_property
    def pairs(self) -> DataFrame:
        """(term, doc_id), distinct: frequencies without counts, which a document's row gives alone."""
        if self.saved or not self._keyed:
            return self.frequencies.select("term", "doc_id")
        return self.corpus.select(F.explode(text.bag(F.col("content"))).alias("term"), "doc_id")

    @cached_property
    def term_df(self) -> DataFrame:
        """(term, df)"""
        return self.pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    @cached_property
    def stats(self) -> DataFrame:
        """One row: n_docs, total_tokens, avg_len (0 without documents)."""
        return self.documents.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_len"))

    @cached_property
    def _parsed(self) -> DataFrame:
        return extract_symbols(self.corpus)

    @cached_property
    def symbols(self) -> DataFrame:
        """(doc_id, line, kind, name, visibility, parent)"""
        return self._symbols_of(extract_symbols(self.corpus, failures=False))

    @staticmethod
    def _symbols_of(parsed: DataFrame) -> DataFrame:
        return parsed.where("failure is null").select("doc_id", "line", "kind", "name", "visibility", "parent")

    def symbols_where(self, cond: Column) -> DataFrame:
        """The symbols of the documents for which cond holds, perhaps of others too; no other file is parsed. cond is on columns of the corpus."""
        return self.symbols if self.saved else self._symbols_of(extract_symbols(self.corpus.where(cond), failures=False))

    @cached_property
    def parse_failures(self) -> DataFrame:
        """(doc_id, path, message)"""
        return self._parsed.where("failure is not null").join(self.corpus.select("doc_id", F.col("relative_path").alias("path")), "doc_id").select("doc_id", "path", F.col("failure").alias("message"))

    def postings_for(self, term: str) -> DataFrame:
        if self.saved:
            return self.postings.where(F.col("term") == term).orderBy("doc_id")
        tokens = self._tokens_of(self.corpus.where(text.may_have(F.col("content"), [term])))
        return self._gathered(tokens.where(F.col("term") == term)).orderBy("doc_id")

    def lines_of(self, term: str | None) -> DataFrame:
        """(doc_id, line) of a term's tokens."""
        docs = self.corpus.where(text.may_have(F.col("content"), [term] if term else []))
        return self._tokens_of(docs).where(F.col("term") == F.lit(term)).select("doc_id", "line")

    def category_counts(self) -> DataFrame:
        """(ordinal, category, label, files) for every category, those without files too."""
        known = self.spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(zip(CATEGORIES, LABELS, strict=True))], "ordinal int, category string, label string")
        counts = self.corpus.groupBy("category").agg(F.count(F.lit(1)).alias("files"))
        return known.join(counts, "category", "left").select("ordinal", "category", "label", F.coalesce("files", F.lit(0)).cast("long").alias("files"))

    def summary(self) -> DataFrame:
        """One row: files, symbols, unique_terms, posting_entries, tokens, avg_len."""
        df = self.term_df.agg(F.count(F.lit(1)).alias("unique_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("posting_entries"))
        n = self.symbols.agg(F.count(F.lit(1)).alias("symbols"))
        one = self.stats.crossJoin(F.broadcast(df)).crossJoin(F.broadcast(n))  # one row each
        return one.select(F.col("n_docs").alias("files"), "symbols", "unique_terms", "posting_entries", F.col("total_tokens").alias("tokens"), "avg_len")

    def save(self, folder: str) -> None:
        """Writes the tables as Parquet; postings lie sorted by term, so that a term's row groups are found by their statistics."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
        for name in ("documents", "term_df", "symbols", "parse_failures"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        docs = spark.read.parquet(f"{folder}/documents")
        out = cls(docs, "category")
        out.saved = True
        out.documents = docs
        out.postings = spark.read.parquet(f"{folder}/postings")
        out.frequencies = out.postings.select("term", "doc_id", "tf", "first_line")
        out.term_df = spark.read.parquet(f"{folder}/term_df")
        out.symbols = spark.read.parquet(f"{folder}/symbols")
        out.parse_failures = spark.read.parquet(f"{folder}/parse_failures")
        return out
