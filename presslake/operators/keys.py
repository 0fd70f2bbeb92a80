"""Surrogate keys and ingest time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def with_ids(df: DataFrame, last_id: int, created_at: datetime | Column) -> DataFrame:
    """``id`` follows the order of the batch after ``last_id``.

    Only the order of ids is promised, so the position in the batch serves as it
    is: no sort and no count. Rows left out as duplicates leave gaps, as they do
    in a database sequence.
    """
    stamp = created_at if isinstance(created_at, Column) else F.lit(created_at).cast("timestamp")
    return df.withColumns({"id": F.col("ordinal") + (last_id + 1), "created_at": stamp})
