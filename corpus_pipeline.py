"""From raw documents to packed sequences of tokens, in five stages.

Each stage takes whatever its predecessor kept and treats nulls, empty and very long texts, ties, repeated rows, an empty table and
further columns as the operator that it calls states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zedweave.llm import mixing, packing, pii, quality, simhash
from zedweave.llm.common import Scratch, temporary
from zedweave.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail go, among them null, empty and short texts; boilerplate lines of the others too. Repeated rows stay as
    often as they stand; all columns are returned. See quality.keep_good."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, Jaccard 0.8 at least) stays: that of the smallest id, null
    ids last, one of repeated rows. Null texts are empty. All columns are returned. See simhash.keep_one."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks stand in place of personal data; null texts stay null. Rows and columns are returned as they are else. See
    pii.redact."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null texts have no words; null is a source; repeated rows are
    taken one by one. All columns are returned. See mixing.mix_sources."""
    return mixing.mix_sources(docs, keep=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. A null text is its end id alone; repeated rows are documents of their
    own; long texts are cut into pieces. See packing.pack_documents."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), cache=200_000)  # workers of other stages wait beside its own


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("personal data", personal_data), ("mix", mix), ("pack", pack)]

#: Tokenization, fingerprint components and sampling aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES:
        with temporary():
            docs = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
