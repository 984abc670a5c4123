"""Tables as corpora: (doc_id, relative_path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, relative_path string, content string"


def synthetic_path() -> Column:
    """A path for rows of the documents table that have none, from doc_id, lang and source alone."""
    return F.expr(
        "concat(element_at(array('src','tests','docs','examples','config',lang), cast(1 + doc_id % 6 as int)), '/', source, '/doc_', doc_id, '.',"
        " element_at(array('rs','md','txt','toml','json'), cast(1 + doc_id % 5 as int)))"
    )


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", synthetic_path().alias("relative_path"), F.col("text").alias("content"))


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A corpus of (path, content) pairs, numbered from 0 in that order."""
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rows)], SCHEMA)
