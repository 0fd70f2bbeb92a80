"""From a raw JSON value to one typed input per concept.

Every alias is typed, chosen or not: one alias of a wrong type rejects the
record. Among the usable aliases (present, not null, not empty text) the first
in order of preference wins, before any cleaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.variants import number_text, script_type_sql
from presslake.schema import CHECKED_FIELDS, COUNT_ALIASES, DATE_ALIASES, TEXT_ALIASES

# Reasons given for a refused record.
NOT_AN_OBJECT = "Record must be a JSON object"
BAD_TYPE = "Invalid input"
NO_SOURCE = "source is required and must contain at least one alphanumeric character"
NO_TEXT = "record must contain a title or content"

CONCEPTS = {**TEXT_ALIASES, "published": DATE_ALIASES, "engagement": COUNT_ALIASES}
_TEXT_FIELDS = {alias for aliases in TEXT_ALIASES.values() for alias in aliases}



def _wrong_type(field: str) -> str:
    allowed = "'string', 'number', 'null'" + (", 'boolean'" if field in _TEXT_FIELDS else "")
    return f"_type_{field} NOT IN ({allowed})"


def _first_usable(aliases: list[str], value: str) -> Column:
    """``value`` (with ``{}`` for the alias) of the first usable alias."""
    cases = [f"WHEN _type_{a} <> 'null' AND NOT (_type_{a} = 'string' AND _text_{a} = '') THEN {value.format(a)}" for a in aliases]
    return F.expr(f"CASE {' '.join(cases)} END")


def with_types(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``_type_<alias>`` and ``_text_<alias>`` (strings and booleans) for
    every alias, and ``_fields``, the record as a map (null if it is no object). The
    record is taken apart once; every alias is then looked up in the map."""
    df = df.withColumn("_fields", F.expr(f"try_cast({raw} AS MAP<STRING, VARIANT>)"))
    df = df.withColumns({f"_type_{f}": F.expr(script_type_sql(f"schema_of_variant(_fields['{f}'])")) for f in CHECKED_FIELDS})
    return df.withColumns({
        f"_text_{f}": F.expr(f"CASE WHEN _type_{f} IN ('string', 'boolean') THEN CAST(_fields['{f}'] AS STRING) END")
        for f in CHECKED_FIELDS
    })


def with_inputs(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``type_reason`` and per concept ``in_<concept>`` (text), plus
    ``in_published_number`` and ``in_engagement_number`` (double)."""
    df = with_types(df, raw)
    refused = ", ".join(f"CASE WHEN {_wrong_type(f)} THEN '{f}: {BAD_TYPE}' END" for f in CHECKED_FIELDS)
    number = "CASE WHEN _type_{0} = 'number' THEN CAST(_fields['{0}'] AS DOUBLE) END"
    df = df.withColumns({
        "type_reason": F.when(F.col("_fields").isNull(), F.lit(NOT_AN_OBJECT)).otherwise(F.expr(f"coalesce({refused})")),
        **{f"_words_{name}": _first_usable(aliases, "_text_{}") for name, aliases in CONCEPTS.items()},
        **{f"_number_{name}": _first_usable(aliases, number) for name, aliases in CONCEPTS.items()},
    })
    df = df.drop("_fields", *[f"_{kind}_{f}" for kind in ("type", "text") for f in CHECKED_FIELDS])
    df = df.withColumns({
        **{f"in_{n}": F.coalesce(F.col(f"_words_{n}"), number_text(f"_number_{n}")) for n in CONCEPTS},
        "in_published_number": F.col("_number_published"),
        "in_engagement_number": F.col("_number_engagement"),
    })
    return df.drop(*[f"_{kind}_{n}" for kind in ("words", "number") for n in CONCEPTS])


def reject_reason() -> Column:
    """Why a record is refused, or null. Reads the columns of ``normalize``."""
    return F.coalesce(
        F.col("type_reason"),
        F.when(F.col("source").isNull(), F.lit(NO_SOURCE)),
        F.when(F.col("title").isNull() & F.col("content").isNull(), F.lit(NO_TEXT)),
    )
