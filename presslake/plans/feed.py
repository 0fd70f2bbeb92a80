"""Messy mention records made from ordinary tables.

``documents``, ``pages`` (each with a repost of itself under a tracked link) and
``conversations`` become raw records with aliases, misspelt sources, markup,
links, dates and counters in many shapes, and some records that must be refused.
Dates and counters come from a row of ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslake.session import plan_bytes

# Fixed values of the feed: how many ways a date and a counter are written, and
# which records are broken on purpose.
DATE_SHAPES = 13
COUNT_SHAPES = 8

# Records of neighbouring numbers take their dates from events this far apart (a
# prime), so that a feed of any size spans the whole time of the events.
EVENT_STEP = 7919
SPREAD_BYTES = 128 << 20

ENGLISH_MONTHS = ["January", "February", "March", "April", "May", "June", "July",
                  "August", "September", "October", "November", "December"]
INDONESIAN_MONTHS = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli",
                     "Agustus", "September", "Oktober", "November", "Desember"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. Work per row is heavy, and a file of one row group is one task, so a
    table of at most ``SPREAD_BYTES`` is spread over the cores. A larger one is read as
    it lies, without a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if plan_bytes(df) <= SPREAD_BYTES else df


def feed_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Stored size of the tables the records are made of."""
    return sum(plan_bytes(spark.read.parquet(f"{sf_dir}/{name}.parquet")) for name in ("documents", "pages", "conversations"))


def utc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant, whatever type the file declares."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _month_name(ts: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.month(ts))


def date_text(shape: Column, ts: Column, word: Column) -> Column:
    """``ts`` written in one of the shapes; null for absent and for numbers."""
    def fmt(pattern: str, shift: str = "0") -> Column:
        return F.date_format(ts + F.expr(f"INTERVAL {shift} HOURS"), pattern)

    return (
        F.when(shape == 1, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(shape == 2, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss", "7"), F.lit("+07:00")))
        .when(shape == 3, fmt("yyyy-MM-dd HH:mm:ss.SSS"))
        .when(shape == 4, fmt("yyyy-MM-dd"))
        .when(shape == 5, fmt("dd/MM/yyyy"))
        .when(shape == 6, fmt("yyyy.MM.dd"))
        .when(shape == 7, F.concat_ws(" ", fmt("d", "7"), _month_name(ts + F.expr("INTERVAL 7 HOURS"), INDONESIAN_MONTHS), fmt("yyyy HH:mm", "7"), F.lit("WIB")))
        .when(shape == 8, F.concat(_month_name(ts, ENGLISH_MONTHS), fmt(" d, yyyy")))
        .when(shape == 9, fmt("EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(shape == 10, F.unix_seconds(ts).cast("string"))
        .when(shape == 11, F.concat(F.lit("some time after "), word))
    )


def _grouped(n: Column, separator: str) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(separator))


def count_text(shape: Column, n: Column) -> Column:
    """``n`` written in one of the shapes; null for absent and for numbers."""
    tens, ones = F.floor(n / 10).cast("string"), (n % 10).cast("string")
    return (
        F.when(shape == 0, n.cast("string"))
        .when(shape == 1, _grouped(n, ","))
        .when(shape == 2, _grouped(n, "."))
        .when(shape == 3, _grouped(n, " "))
        .when(shape == 4, F.concat(tens, F.lit("."), ones, F.lit("K")))
        .when(shape == 5, F.concat(tens, F.lit(","), ones, F.lit(" jt")))
        .when(shape == 6, F.concat(F.lit("about "), n.cast("string")))
    )


def written_columns() -> dict[str, Column]:
    """Dates and counters of a row that ``_with_event`` prepared. The columns are
    unresolved, so one set serves all tables."""
    shape, count_shape = F.pmod(F.col("k"), F.lit(DATE_SHAPES)), F.pmod(F.col("k"), F.lit(COUNT_SHAPES))
    return {
        "date_text": date_text(shape, F.col("ts"), F.col("event_type")),
        "date_number": F.when(shape == 12, F.unix_millis("ts")),
        "count_text": count_text(count_shape, F.col("n")),
        "count_number": F.when(count_shape == 7, F.col("n")),
    }


def _with_event(spark: SparkSession, sf_dir: str, name: str, key: str, written: dict[str, Column] | None) -> DataFrame:
    """A table with its key as ``k`` and what its event gives."""
    e = utc_events(spark, sf_dir).select(
        F.col("event_id").alias("event"), "ts", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("n"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    df = table(spark, sf_dir, name).withColumn("k", F.col(key))
    df = df.withColumn("event", F.pmod(F.col("k") * EVENT_STEP, F.lit(events))).join(e, "event", "left").drop("event")
    return df.withColumns(written_columns() if written is None else written)


def document_records(spark: SparkSession, sf_dir: str, written: dict[str, Column] | None = None) -> DataFrame:
    """``ordinal, json``; every key is present, absent values are JSON null."""
    df = _with_event(spark, sf_dir, "documents", "doc_id", written)
    k = F.col("doc_id")
    spelling = (
        F.when(k % 37 == 5, F.lit(""))
        .when(k % 3 == 1, F.concat(F.lit("  "), F.upper("source"), F.lit(" ")))
        .when(k % 3 == 2, F.concat(F.lit("www."), F.col("source"), F.lit(".com")))
        .otherwise(F.col("source"))
    )
    record = F.struct(
        spelling.alias("source"),
        F.when(k % 41 != 7, F.col("text")).alias("text"),
        F.when(k % 43 == 11, F.struct(k.alias("of"))).alias("description"),
        F.col("date_text").alias("published_at"), F.col("date_number").alias("created_at"),
        F.col("count_text").alias("engagement"), F.col("count_number").alias("views"),
        F.col("lang"),
    )
    body = F.when(k % 47 == 13, F.to_json(F.array(k))).otherwise(F.to_json(record, {"ignoreNullFields": "false"}))
    return df.select((k * 3).alias("ordinal"), body.alias("json"))


def page_records(spark: SparkSession, sf_dir: str, written: dict[str, Column] | None = None) -> DataFrame:
    """Two records per page, the second a repost under a tracked link."""
    df = _with_event(spark, sf_dir, "pages", "page_id", written)
    df = df.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    joiner = F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?"))
    bare, fragment = F.substring_index("url", "#", 1), F.regexp_extract("url", "(#.*)?$", 1)
    tracked = F.concat(bare, joiner, F.lit("utm_campaign=repost&FBCLID="), F.col("page_id").cast("string"), F.coalesce(fragment, F.lit("")))
    record = F.struct(
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("publisher"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("headline"),
        F.col("html").alias("body"),
        F.when(F.col("copy") == 0, F.col("url")).otherwise(tracked).alias("link"),
        F.col("date_text").alias("publishedAt"), F.col("date_number").alias("date"),
        F.col("count_text").alias("reach"), F.col("count_number").alias("engagement_count"),
        F.col("page_id"),
    )
    return df.select((F.col("page_id") * 6 + F.col("copy") * 3 + 1).alias("ordinal"), F.to_json(record).alias("json"))


def conversation_records(spark: SparkSession, sf_dir: str, written: dict[str, Column] | None = None) -> DataFrame:
    """Posts without a link; author with markup, date as a number or missing."""
    df = _with_event(spark, sf_dir, "conversations", "conv_id", written)
    record = F.struct(
        F.col("role").alias("source_name"), F.col("text").alias("content"),
        F.when(F.col("turn") % 2 == 0, F.unix_seconds("ts")).alias("published_date"),
        F.concat(F.lit("<b>Speaker</b> &amp; "), F.col("conv_id").cast("string")).alias("author_name"),
        F.col("turn").alias("views"),
    )
    ordinal = (F.col("conv_id") * 1_000_000 + F.col("turn")) * 3 + 2
    return df.select(ordinal.alias("ordinal"), F.to_json(record).alias("json"))


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = written_columns()
    parts = [make(spark, sf_dir, written) for make in (document_records, page_records, conversation_records)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def raw_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed as ``ordinal, raw``."""
    return feed_lines(spark, sf_dir).select("ordinal", F.parse_json("json").alias("raw"))
