"""The queries ``opN_…``: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.contamination import contained_items
from presslake.llm.conversation_repair import repaired
from presslake.llm.merkle import manifest
from presslake.llm.fm_dedup import without_repeats
from presslake.llm.licenses import licence_scan
from presslake.llm.mixing import mixed
from presslake.llm.packed_ids import packed_documents
from presslake.llm.quality_ledger import judged, ledger
from presslake.llm.simhash_links import near_duplicates
from presslake.llm.suffix_dedup import without_repeated_bytes
from presslake.llm.token_counts import encoded_lengths, length_histogram
from presslake.llm.toxicity import toxicity
from presslake.llm.warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(_table(spark, sf_dir, "documents")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).drop("copies", "text_hash")


def op3_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_bytes(_table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(ledger(_table(spark, sf_dir, "documents"))).select("doc_id", *columns, "failures", "policy_version")


def op10_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(_table(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = [
        op1_token_counts, op2_source_mixing, op3_fm_index_dedup, op4_benchmark_decontamination, op5_toxicity, op6_warc_writer,
        op7_suffix_array_dedup, op8_simhash_near_dedup, op9_quality_rules, op10_packed_token_ids,
        op11_merkle_manifest, op12_conversation_repair, op13_license_scan,
    ]
    return {f.__name__: f for f in found}
