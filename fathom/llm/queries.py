"""The registered queries of the training-data operators, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, linededup, packing, quality, secretscan, sharding, simhash, topk
from .common import table, written


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 100 = 0"), 10).select("query_id", "rank", "vec_id", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(written(sharding.measured(table(spark, sf_dir, "documents")), "measured"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(secretscan.scan(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op3_line_dedup": linededup.ORACLE_SQL,
    "op4_quality_rules": quality.ORACLE_SQL,
    "op10_license_scan": licenses.ORACLE_SQL,
}
