"""The queries of this package's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zedweave.llm import ann, licences, mixing, oracles, packing, pii, quality, sharding, simhash, token_files, warc


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, 0)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 4).select("doc_id", "fingerprint", "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("removed_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_vector_bins": op1, "op2_pack_harmonic": op2, "op3_mix_sources": op3, "op4_licence_index": op4, "op5_warc_round_trip": op5,
    "op6_simhash_trie": op6, "op7_kmeans_tree": op7, "op8_token_files": op8, "op9_pii_anchors": op9, "op10_line_frequency": op10,
}

#: The other queries depend on placement, sampling, tokenizers, fingerprints, search or spans that SQL can't derive; the tests hold them
#: against brute force.
ORACLE_SQL: dict[str, str] = {"op4_licence_index": oracles.licence_index(), "op5_warc_round_trip": oracles.round_trip(), "op10_line_frequency": oracles.line_frequency()}
