"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobscope.llm import chat_perspectives, decontaminate, licenses, line_dedup, media_ts, order_minhash, pieces, sharding, spelling, token_counts, token_planes, toxicity, vector_codes
from jobscope.llm.common import table
from jobscope.store import new_path


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_perspectives.perspective_table(table(spark, sf_dir, "conversations"))


def op2_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.digest_table(table(spark, sf_dir, "documents"))


def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_count_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-planes")
    token_planes.write_token_planes(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_planes.read_documents(spark, path)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_table(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_table(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"), sharding.SHARDS)


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_media_ts": op2_media_ts,
    "op3_spaced_seeds": op3_spaced_seeds,
    "op4_prefix_counts": op4_prefix_counts,
    "op5_licenses": op5_licenses,
    "op6_token_planes": op6_token_planes,
    "op7_pieces": op7_pieces,
    "op8_order_minhash": op8_order_minhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_best_fit_shards": op11_best_fit_shards,
    "op12_annular_codes": op12_annular_codes,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op1_chat_perspectives": chat_perspectives.ORACLE,
    "op3_spaced_seeds": decontaminate.ORACLE,
    "op5_licenses": licenses.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_best_fit_shards": sharding.ORACLE,
    "op12_annular_codes": vector_codes.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
