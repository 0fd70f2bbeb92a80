"""The rules a stored table must meet, counted in one pass plus one group-by."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslake.operators.dedup import fingerprint_groups


def constraint_violations(stored: DataFrame) -> DataFrame:
    """One row per rule with the number of rows that break it."""
    required = ["id", "fingerprint", "source", "source_raw", "raw", "created_at"]
    rules = {
        "fingerprint_length": F.octet_length("fingerprint") != 32,
        "source_not_blank": F.length(F.trim("source")) == 0,
        "engagement_natural": F.col("engagement") < 0,
        **{f"{name}_not_null": F.col(name).isNull() for name in required},
    }
    counts = stored.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])
    per_rule = counts.select(F.inline(pairs))
    unique = fingerprint_groups(stored).select(
        F.lit("fingerprint_unique").alias("rule"), F.col("rows_collapsed").alias("violations")
    )
    return per_rule.unionByName(unique)
