"""Result rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslake.functions.dates import iso_utc
from presslake.schema import LISTING_COLUMNS


def listing(stored: DataFrame) -> DataFrame:
    return stored.select(*LISTING_COLUMNS)


def export_rows(stored: DataFrame) -> DataFrame:
    """Listing columns with times as ISO text and nulls kept, as ``json``."""
    rows = listing(stored).withColumns({
        "published_at": iso_utc(F.col("published_at")), "created_at": iso_utc(F.col("created_at")),
    })
    body = F.to_json(F.struct(*LISTING_COLUMNS), {"ignoreNullFields": "false"})
    return rows.select("id", body.alias("json"))
