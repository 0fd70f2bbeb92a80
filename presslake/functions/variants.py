"""Reading JSON values held in VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def script_type_sql(type_name: str) -> str:
    """JSON type of a ``schema_of_variant`` text, in the words of a script."""
    # Numbers are typed BIGINT, DECIMAL(…), DOUBLE or FLOAT.
    return (
        f"CASE substring({type_name}, 1, 2) WHEN 'ST' THEN 'string' WHEN 'VO' THEN 'null' WHEN 'BO' THEN 'boolean'"
        " WHEN 'AR' THEN 'object' WHEN 'OB' THEN 'object'"
        " WHEN 'BI' THEN 'number' WHEN 'DE' THEN 'number' WHEN 'DO' THEN 'number' WHEN 'FL' THEN 'number' END"
    )


def number_text(column: str) -> Column:
    """A double column, given by name, the way a script prints it: no trailing
    zeros, plain digits from 1e-6 up to 1e21, exponents beyond."""
    return F.expr(
        f"CASE WHEN {column} = 0 THEN '0'"
        f" WHEN abs({column}) < 1e-6 OR abs({column}) >= 1e21 THEN"
        rf" lower(regexp_replace(regexp_replace(CAST({column} AS STRING), r'\.0E', 'E'), 'E(?=[0-9])', 'E+'))"
        f" WHEN {column} = rint({column}) THEN CAST(CAST({column} AS DECIMAL(38, 0)) AS STRING)"
        rf" ELSE regexp_replace(CAST(CAST({column} AS DECIMAL(38, 22)) AS STRING), r'\.?0+\z', '') END"
    )
