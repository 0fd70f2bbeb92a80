"""First-wins de-duplication that holds when one key owns much of the data.

The winner of a key is found on narrow rows by a partial aggregate, so a hot key
leaves each task as one row. Wide rows are then matched by their own unique row
key and never gathered by the hot one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Row keys of up to this many rows (8 to 40 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000
# Buckets of a stored fingerprint index: files per write, and tasks of a join against it.
FINGERPRINT_BUCKETS = 64


def first_by_fingerprint(df: DataFrame, order: list[str]) -> DataFrame:
    """``fingerprint`` and the order columns of its earliest row."""
    first = F.min(F.struct(*order)) if len(order) > 1 else F.min(order[0])
    firsts = df.groupBy("fingerprint").agg(first.alias("_first"))
    if len(order) == 1:
        return firsts.withColumnRenamed("_first", order[0])
    return firsts.select("fingerprint", *[F.col(f"_first.{c}").alias(c) for c in order])


def first_wins(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``df`` that come first among those of their fingerprint. The
    order columns together must identify a row and hold no nulls."""
    return df.join(first_by_fingerprint(df, order).select(*order), order, "left_semi")


def canonical_mentions(stored: DataFrame) -> DataFrame:
    """Read view in which the earliest stored row of a fingerprint stands, for rows
    gathered from several tables."""
    return first_wins(stored, ["created_at", "batch_id", "ordinal"])


def write_fingerprint_index(stored: DataFrame, table: str, buckets: int = FINGERPRINT_BUCKETS) -> DataFrame:
    """Appends the stored rows' fingerprints, with ``published_at`` for the dated filter, to a
    catalog table bucketed and sorted by fingerprint, and returns that table.

    A join on the fingerprint then finds the stored side already partitioned as it needs, so
    only the batch is shuffled; the rows are dealt to their bucket before the write, so that a
    write adds one file per bucket.
    """
    rows = stored.select("fingerprint", "published_at").where(F.col("fingerprint").isNotNull())
    (rows.repartition(buckets, "fingerprint").write.bucketBy(buckets, "fingerprint").sortBy("fingerprint")
     .mode("append").format("parquet").saveAsTable(table))
    return stored.sparkSession.table(table)


def already_stored(firsts: DataFrame, stored: DataFrame, firsts_rows: int | None = None) -> DataFrame:
    """Fingerprints of the batch that are stored already.

    The stored side is only scanned for its fingerprint column. A batch of known,
    small size is sent to that scan instead of shuffling the whole table. Given the index of
    ``write_fingerprint_index``, a larger batch is shuffled to the index's buckets and the index
    is read in place.
    """
    probe = firsts.select("fingerprint")
    if firsts_rows is not None and firsts_rows <= BROADCAST_ROWS:
        probe = F.broadcast(probe)
    return stored.select("fingerprint").join(probe, "fingerprint", "left_semi").distinct()


def not_stored(firsts: DataFrame, stored: DataFrame, firsts_rows: int | None = None) -> DataFrame:
    """Rows of ``firsts`` whose fingerprint is not stored yet: one anti-join, or for
    a batch that may be broadcast a scan of the stored side that moves only hits."""
    if firsts_rows is not None and firsts_rows <= BROADCAST_ROWS:
        stored = already_stored(firsts, stored, firsts_rows)
    return firsts.join(stored.select("fingerprint"), "fingerprint", "left_anti")


def fingerprint_groups(df: DataFrame) -> DataFrame:
    """One row: distinct fingerprints, groups above one row, rows beyond the first."""
    sizes = df.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("distinct_fingerprints"),
        F.count_if(F.col("n") > 1).alias("repeated_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_collapsed"),
    )


def within_batch_duplicates(normalized: DataFrame) -> DataFrame:
    return fingerprint_groups(normalized).select(F.col("rows_collapsed").alias("within_batch"))


def strategy_counts(normalized: DataFrame) -> DataFrame:
    return (
        normalized.where(F.col("fingerprint").isNotNull())
        .groupBy(F.col("fingerprint_strategy").alias("strategy")).agg(F.count("*").alias("count"))
    )
