"""Source names folded to a comparison key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.text import collapse_ws, null_if_empty, with_clean_text


def strip_address_prefix(c: Column) -> Column:
    """Spelling without a leading ``scheme://`` and one ``www.``."""
    bare = F.regexp_replace(collapse_ws(c), r"\A[a-zA-Z][a-zA-Z0-9+.\-]*://", "")
    return F.regexp_replace(bare, r"(?i)\Awww\.", "")


def source_key(bare: Column) -> Column:
    """Key of a spelling without prefix. A name that reads like a host (two or
    more non-empty labels before any slash) is known by its first label."""
    host = F.substring_index(bare, "/", 1)
    host_like = host.rlike(r"\A[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z0-9-]+\z") & ~host.contains("..")
    label = F.when(host_like, F.substring_index(bare, ".", 1)).otherwise(bare)
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def fold_source(c: Column) -> Column:
    return source_key(strip_address_prefix(c))


def with_source(df: DataFrame, spelling: str, key_out: str = "source", raw_out: str = "source_raw") -> DataFrame:
    """Adds key and cleaned spelling; both are null if nothing usable is left."""
    df = with_clean_text(df, {"_spelling": spelling})
    df = df.withColumn("_bare", strip_address_prefix(F.col("_spelling")))
    df = df.withColumn(key_out, null_if_empty(source_key(F.col("_bare"))))
    df = df.withColumn(raw_out, F.when(F.col(key_out).isNotNull(), F.col("_spelling")))
    return df.drop("_spelling", "_bare")
