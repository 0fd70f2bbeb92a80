"""Engagement counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.text import WS, trim_ws

INT_MAX = 2_147_483_647

# Shorthand suffixes, and the accepted groupings of digits.
SUFFIX_FACTORS = {"k": 1_000, "rb": 1_000, "ribu": 1_000, "jt": 1_000_000, "juta": 1_000_000}
PLAIN_COUNT = r"\A(?:\d+|\d{1,3}(?:,\d{3})+|\d{1,3}(?:\.\d{3})+|\d{1,3}(?: \d{3})+)\z"
SUFFIXED_COUNT = rf"(?i)\A(\d+)(?:[.,](\d+))?{WS}*(k|rb|ribu|jt|juta)\z"


def _as_count(number: Column) -> Column:
    return F.when((number >= 0) & (number <= INT_MAX), number.cast("int"))


def count_from_number(c: Column) -> Column:
    """Whole, non-negative JSON numbers that fit an INT; everything else null."""
    return F.when((c >= 0) & (c <= INT_MAX) & (F.rint(c) == c), c.cast("int"))


def parse_count(trimmed: Column) -> Column:
    """Count written as text; ``trimmed`` should be a stored column."""
    plain = F.regexp_replace(trimmed, "[,. ]", "").try_cast("bigint")
    factors = F.create_map(*[F.lit(x) for k, v in SUFFIX_FACTORS.items() for x in (k, float(v))])
    factor = F.try_element_at(factors, F.lower(F.regexp_extract(trimmed, SUFFIXED_COUNT, 3)))
    whole = F.regexp_extract(trimmed, SUFFIXED_COUNT, 1).cast("double")
    digits = F.regexp_extract(trimmed, SUFFIXED_COUNT, 2)
    # Digits beyond the 300th are far below what a double can tell apart.
    leading = F.substring(digits, 1, 300)
    share = F.when(digits == "", F.lit(0.0)).otherwise(leading.cast("double") / F.pow(F.lit(10.0), F.length(leading).cast("double")))
    scaled = whole * factor + F.floor(share * factor + F.lit(0.5))
    return F.when(trimmed.rlike(PLAIN_COUNT), _as_count(plain)).when(
        trimmed.rlike(SUFFIXED_COUNT), _as_count(scaled)
    )


def with_count(df: DataFrame, text: str, number: str | None, out: str = "engagement") -> DataFrame:
    df = df.withColumn("_trimmed", trim_ws(F.col(text)))
    value = parse_count(F.col("_trimmed"))
    if number is not None:
        value = F.coalesce(value, count_from_number(F.col(number)))
    return df.withColumn(out, value).drop("_trimmed")
