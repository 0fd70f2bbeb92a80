"""Exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.encoding import default_tokenizer, encoder
from presslake.llm.staging import ready_for_python, written

#: Lengths of one block of the suffix sums.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """One row ``n_tokens`` per row of ``docs``; null and empty texts have 0 tokens."""
    path = tokenizer or default_tokenizer()
    ready_for_python(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts = encoder(path).encode(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct ``n_tokens``: ``n_docs``, and what a context limit of that many tokens needs.

    * ``tokens``: tokens of documents of exactly this length;
    * ``docs_from``, ``tokens_from``: documents of this length or more, and their tokens (suffix sums);
    * ``total_docs``, ``total_tokens``: of all documents;
    * ``truncated_tokens``: tokens that remain if every document is cut at this length;
    * ``rank_below``: documents that are shorter, so that quantile q is the largest length with
      ``rank_below <= q * (total_docs - 1)``.

    The documents are counted first, so what follows has a row per length, not per document.
    Suffix sums are taken within blocks of lengths and over the few block sums, so no task sees
    all lengths. An empty table gives no rows.
    """
    counts = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "length-histogram")
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("total_docs"),
        F.sum("block_tokens").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(blocks, "block")
        .withColumn("docs_from", F.sum("n_docs").over(within) + F.col("later_docs"))
        .withColumn("tokens_from", F.sum("tokens").over(within) + F.col("later_tokens"))
        .select(
            "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", "total_docs", "total_tokens",
            (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
            (F.col("total_docs") - F.col("docs_from")).alias("rank_below"),
        )
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens kept at any context limit, and how many documents it cuts; one row."""
    longer = F.col("n_tokens") > limit
    kept: Column = F.sum(F.when(longer, limit * F.col("n_docs")).otherwise(F.col("tokens")))
    return histogram.agg(
        F.lit(limit).cast("long").alias("limit"),
        F.coalesce(kept, F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("cut_docs"),
    )


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The length at rank floor(q * (documents - 1)); one row, null for an empty table."""
    return histogram.where(F.col("rank_below") <= F.floor(F.lit(q) * (F.col("total_docs") - 1))).agg(
        F.max("n_tokens").alias("n_tokens")
    )
