"""Figures for an overview page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def key_figures(stored: DataFrame, matching: Column) -> DataFrame:
    """Total, rows meeting the filter, distinct sources, undated rows: one scan."""
    return stored.agg(
        F.count("*").alias("total"),
        F.count_if(matching).alias("matching"),
        F.count_distinct("source").alias("sources"),
        F.count_if(F.col("published_at").isNull()).alias("undated"),
    )


def share_of_maximum(buckets: DataFrame) -> DataFrame:
    """Adds ``share``: whole percent of the largest count, halves rounded up."""
    largest = buckets.agg(F.max("count")).scalar()
    share = F.floor(F.col("count") / largest * 100 + F.lit(0.5)).cast("int")
    return buckets.withColumn("share", share)
