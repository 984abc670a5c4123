"""A pipeline over the documents table, from raw texts to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it
kept, and returns the columns of documents; the last returns the packing.

- language ID: a text without a letter, or whose best language has a score below
  one half, goes. The model learns from the stage's own labelled rows that are
  not held out; if there is none, every text with a letter stays.
- line dedup: lines that an earlier line nearly equals are taken out of the
  texts; a document of which that leaves no word goes.
- SimHash near-dedup: of each class of near-duplicates the document with the
  smallest id stays; texts whose five-word shingles have a Jaccard similarity of
  0.8 or more are near-duplicates. Links of fingerprints are verified by it; an
  exact join finds the pairs whose fingerprints differ in more bits.
- secret scans: the spans found are replaced in the texts; no document goes.
- packing: where each piece of each document lies in which sequence.

n_chars follows the text where a stage changes it. Nulls, ties, repeated rows
and empty tables are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import langid, linededup, packing, secretscan, simhash


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    return langid.known_language(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linededup.dedup(docs, emptied=False).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secretscan.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]
#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{n}")
    return docs
