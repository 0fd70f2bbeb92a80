"""Counts over the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslake.functions.dates import utc_day

RECENT_DAYS = 14


def count_by_source(stored: DataFrame) -> DataFrame:
    """``group, label, count``; the label is the smallest spelling in binary order.

    Rows are hashed down to spellings first: a minimum of text next to the rows
    would force every task to sort them.
    """
    spellings = stored.groupBy("source", "source_raw").agg(F.count("*").alias("n"))
    return (
        spellings.groupBy(F.col("source").alias("group"))
        .agg(F.min("source_raw").alias("label"), F.sum("n").alias("count"))
        .orderBy(F.desc("count"), F.asc("group"))
    )


def count_by_day(stored: DataFrame) -> DataFrame:
    """``group, count`` per UTC day of the dated rows; only groups are formatted."""
    return _days(stored.where(F.col("published_at").isNotNull())).select(utc_day(F.col("day")).alias("group"), "count").orderBy("group")


def _days(stored: DataFrame) -> DataFrame:
    """Rows per UTC day, the undated ones under null."""
    return stored.groupBy(F.to_date("published_at").alias("day")).agg(F.count("*").alias("count"))


def missing_dates(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count_if(F.col("published_at").isNull()).alias("missing_published_at"))


def stats(stored: DataFrame, group_by: str) -> tuple[DataFrame, DataFrame | None]:
    """Buckets, and the number of undated rows when grouping by day."""
    if group_by == "source":
        return count_by_source(stored), None
    if group_by == "day":
        # One scan: the day groups (one row a calendar day, a few thousand at most) are
        # brought to the driver once and read twice from there, with nothing left cached.
        days = stored.sparkSession.createDataFrame(_days(stored).collect(), "day date, count long")
        buckets = days.where("day IS NOT NULL").select(utc_day(F.col("day")).alias("group"), "count").orderBy("group")
        missing = days.agg(F.coalesce(F.sum(F.when(F.col("day").isNull(), F.col("count"))), F.lit(0)).alias("missing_published_at"))
        return buckets, missing
    raise ValueError("group_by must be one of: 'source', 'day'")


def recent_days(day_counts: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """The last days that have rows, ascending; gaps are not filled."""
    return day_counts.orderBy(F.desc("group")).limit(days).orderBy("group")
