"""Profile of a raw batch before it is loaded.

``field_facts`` reduces every value of every record to a narrow row; the figures
are aggregates over those rows. Store the facts once and read them many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslake.functions.dates import with_published_at
from presslake.functions.names import with_source
from presslake.functions.text import WS, looks_like_html
from presslake.functions.variants import number_text, script_type_sql
from presslake.schema import DATE_ALIASES, TEXT_ALIASES

# What looks like a number, and how many rows a report shows.
NUMERIC_TEXT = rf"\A{WS}*\d[\d,]*{WS}*\z"
REPORT_ROWS = 40

SOURCE_ALIASES = TEXT_ALIASES["source"]


def field_facts(raw: DataFrame) -> DataFrame:
    """One row per top-level field of each object, and one per other record with
    a null key: ``key, type, html, numeric, spelling, date_state, date_json``."""
    # An unreadable document holds no records; it has no value at all, not a JSON null.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("raw").alias("value")))
    entries = F.coalesce(F.map_entries(F.col("raw").try_cast("map<string,variant>")), whole)
    fields = raw.where(F.col("raw").isNotNull()).select(F.explode(entries).alias("_entry"))
    fields = fields.select(F.col("_entry.key").alias("key"), F.col("_entry.value").alias("_value"))
    fields = fields.withColumn("_shape", F.schema_of_variant("_value"))
    alone = F.col("key").isNull()
    fields = fields.withColumn(
        "type",
        F.when(alone & F.col("_shape").startswith("ARRAY"), F.lit("array")).when(alone & (F.col("_shape") == "VOID"), F.lit("object"))
        .otherwise(F.expr(script_type_sql("_shape"))),
    )
    is_date = F.col("key").isin(DATE_ALIASES)
    fields = fields.withColumns({
        "_text": F.when(~alone & (F.col("type") == "string"), F.variant_get("_value", "$", "string")),
        "_number": F.when(is_date & (F.col("type") == "number"), F.variant_get("_value", "$", "double")),
    })
    fields = fields.withColumn("_date_text", F.when(is_date, F.col("_text")))
    fields = with_published_at(fields, "_date_text", "_number", out="_date")
    missing = (F.col("type") == "null") | (F.coalesce(F.col("_text"), F.lit("x")) == "")
    fields = fields.withColumn("date_state", F.when(is_date, F.when(missing, "missing").when(F.col("_date").isNull(), "unparsable").otherwise("parsed")))
    return fields.select(
        "key", "type",
        F.coalesce(looks_like_html(F.col("_text")), F.lit(False)).alias("html"),
        F.coalesce(F.col("_text").rlike(NUMERIC_TEXT), F.lit(False)).alias("numeric"),
        F.when(F.col("key").isin(SOURCE_ALIASES), F.col("_text")).alias("spelling"),
        "date_state",
        F.when(F.col("date_state") == "unparsable", F.coalesce(number_text("_number"), F.to_json("_value"))).alias("date_json"),
    )


def field_frequency(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("count"))


def value_types(facts: DataFrame) -> DataFrame:
    name = F.concat(F.coalesce(F.col("key"), F.lit("non-object")), F.lit(": "), F.col("type"))
    return facts.groupBy("key", "type").agg(F.count("*").alias("count")).select(name.alias("key"), "count")


def date_fields(facts: DataFrame) -> DataFrame:
    return field_frequency(facts.where(F.col("key").isin(DATE_ALIASES)))


def unparsable_dates(facts: DataFrame) -> DataFrame:
    bad = facts.where(F.col("date_state") == "unparsable")
    return bad.groupBy(F.col("date_json").alias("key")).agg(F.count("*").alias("count"))


def value_flags(facts: DataFrame) -> DataFrame:
    """One row: missing dates, values with markup, texts that look like numbers."""
    return facts.agg(
        F.count_if(F.col("date_state") == "missing").alias("missing_dates"),
        F.count_if(F.col("html")).alias("html_values"),
        F.count_if(F.col("numeric")).alias("numeric_texts"),
    )


def source_folding(facts: DataFrame) -> DataFrame:
    """``source, spelling, count``: which spellings share a key. Rows rather than
    lists, so that no key has to fit one task."""
    used = facts.where(F.col("spelling").isNotNull()).groupBy("spelling").agg(F.count("*").alias("count"))
    folded = with_source(used, "spelling").where(F.col("source").isNotNull())
    return folded.select("source", "spelling", "count").orderBy("source", "spelling")


def record_totals(normalized: DataFrame) -> DataFrame:
    return normalized.agg(F.count("*").alias("records"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def top_report(counts: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """Largest counts first, ties by key."""
    return counts.orderBy(F.desc("count"), F.asc("key")).limit(rows)


def rows_beyond_report(counts: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    return counts.agg(F.greatest(F.count("*") - rows, F.lit(0)).alias("more"))
