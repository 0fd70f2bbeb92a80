"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslake.functions import counts, dates, fingerprints, names, text, urls
from presslake.operators import dedup, profile, search, stats, summary
from presslake.operators.coercion import with_inputs
from presslake.operators.constraints import constraint_violations
from presslake.operators.export import export_rows, listing
from presslake.operators.normalize import normalize, rejected, spread
from presslake.plans import ingest as ingestion
from presslake.plans.feed_store import CREATED_AT, feed_facts, feed_table, normalized_feed, raw_feed, stored_feed, stored_fingerprints
from presslake.session import apply_settings, work_dir
from presslake.plans import feed
from presslake.sources import batches
from presslake.sources.mentions_table import copy_table, read_mentions
from presslake.streaming.incremental import ingest_stream

# Arguments of the search queries.
WORD = "The"
SOURCE = "SRC3.com"
FROM, TO = "2024-01-05", "2024-01-20"
PAGE, PAGE_SIZE = 3, 25
# Stored bytes of the feed's tables a file of lines stands for.
LINES_FILE_BYTES = 8 << 20


def _printable(df: DataFrame) -> DataFrame:
    """Times as text and fingerprints as hex, for comparison outside Spark."""
    kinds = {"timestamp": dates.iso_utc, "binary": F.hex}
    return df.select(*[kinds[t](F.col(n)).alias(n) if t in kinds else F.col(n) for n, t in df.dtypes])


# Sources and sinks ----------------------------------------------------------

def json_lines_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/lines-{uuid4().hex}"
    lines = feed.feed_lines(spark, sf_dir).orderBy("ordinal")
    lines.select(F.when(F.col("ordinal") % 53 == 1, F.lit('{"cut": ')).otherwise(F.col("json"))).write.text(folder)
    stored = ingestion.stage(spark, batches.read_json_lines(spark, folder), f"lines-{uuid4().hex}")
    rows = batches.with_ordinal(stored)
    field = lambda name: F.variant_get("raw", f"$.{name}", "string")
    return rows.select(
        "ordinal", "malformed",
        F.coalesce(field("source"), field("publisher"), field("source_name")).alias("name"),
    )


def json_document_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = feed.table(spark, sf_dir, "pages")
    records = F.to_json(F.array(F.struct(F.col("url").alias("link")), F.struct(F.col("page_id").cast("string").alias("link"))))
    wrapped = F.concat(F.lit('{"total": 2, "mentions": '), records, F.lit("}"))
    form = F.col("page_id") % 11
    value = (
        F.when(form == 3, F.lit('{"mentions": [')).when(form == 5, F.lit('{"items": []}'))
        .when(F.col("page_id") % 2 == 0, records).otherwise(wrapped)
    )
    rows = batches.explode_documents(pages.select("page_id", value.alias("value")))
    return rows.select("page_id", "row", "malformed", F.variant_get("raw", "$.link", "string").alias("link"))


def whole_file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per hundred pages, each one JSON document; every second one is cut off."""
    folder = f"{work_dir(spark)}/documents-{uuid4().hex}"
    pages = feed.table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).alias("g"), F.struct(F.col("url").alias("link")).alias("r"))
    docs = pages.groupBy("g").agg(F.to_json(F.collect_list("r")).alias("value"))
    cut = F.when(F.col("g") % 2 == 1, F.substring("value", 1, 40)).otherwise(F.col("value")).alias("value")
    docs.select("g", cut).write.partitionBy("g").text(folder)
    rows = batches.read_json_documents(spark, folder)
    return rows.select("malformed", F.variant_get("raw", "$.link", "string").alias("link"))


def large_array_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON arrays of a thousand records a file, read cut at commas by as many tasks as
    the files have splits, not one task a file."""
    folder = f"{work_dir(spark)}/arrays-{uuid4().hex}"
    pages = feed.table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 1000).alias("g"), F.struct("page_id", F.col("url").alias("link"), "html").alias("r"),
    )
    pages.groupBy("g").agg(F.to_json(F.collect_list("r")).alias("value")).select("g", "value").write.partitionBy("g").text(folder)
    rows = batches.read_json_arrays(spark, folder)
    return rows.select(
        "malformed", F.variant_get("raw", "$.page_id", "bigint").alias("page_id"), F.variant_get("raw", "$.link", "string").alias("link"),
    )


def stored_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printable(listing(stored_feed(spark, sf_dir)))


def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printable(stored_feed(spark, sf_dir).select("id", "fingerprint", "created_at", "batch_id"))


def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed again under a new batch id into a copy of its table, and the table this leaves."""
    table = copy_table(spark, feed_table(spark, sf_dir), f"{work_dir(spark)}/append-{uuid4().hex}")
    ingestion.ingest(spark, raw_feed(spark, sf_dir), table, f"again{uuid4().hex}", CREATED_AT)
    return _printable(read_mentions(spark, table).select("id", "fingerprint"))


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feed with one rule broken in every tenth of a hundred rows."""
    stored, broken = stored_feed(spark, sf_dir), F.col("ordinal") % 100
    changed = {
        "fingerprint": F.when(broken == 1, F.substring("fingerprint", 1, 31)).when(broken != 5, F.col("fingerprint")),
        "source": F.when(broken == 2, F.lit("  ")).when(broken != 6, F.col("source")),
        "engagement": F.when(broken == 3, F.lit(-1)).otherwise(F.col("engagement")),
        "id": F.when(broken != 4, F.col("id")), "source_raw": F.when(broken != 7, F.col("source_raw")),
        "raw": F.when(broken != 8, F.col("raw")), "created_at": F.when(broken != 9, F.col("created_at")),
    }
    return constraint_violations(stored.withColumns(changed).unionByName(stored.where(broken == 10)))


def raw_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_feed(spark, sf_dir)
    field = lambda name: F.variant_get("raw", f"$.{name}", "string")
    return stored.select("id", field("lang").alias("lang"), field("page_id").alias("page_id"), field("body").alias("body"))


def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(normalized_feed(spark, sf_dir)).select("ordinal", "reason")


def first_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.first_rejects(normalized_feed(spark, sf_dir))


def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(stored_feed(spark, sf_dir))


# Normalization --------------------------------------------------------------

def normalized_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole narrow pass over the raw records."""
    return _printable(normalize(spread(raw_feed(spark, sf_dir))).drop("raw"))


def coerced_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_inputs(raw_feed(spark, sf_dir))
    return df.select(
        "ordinal", "type_reason", "in_source", "in_title", "in_content", "in_url", "in_author", "in_engagement",
        F.col("in_engagement_number").cast("bigint").alias("engagement_number"),
        F.col("in_published_number").cast("bigint").alias("published_number"),
    )


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_feed(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("count"))


def accept_reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.record_totals(normalized_feed(spark, sf_dir))


# Column library -------------------------------------------------------------

def collapsed_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.table(spark, sf_dir, "documents").select("doc_id", text.collapse_ws(F.col("text")).alias("collapsed"))


def html_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = feed.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("k"), F.col("html").alias("body"))
    docs = feed.table(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", "text")
    return pages.union(docs).select("kind", "k", text.looks_like_html(F.col("body")).alias("html"))


def content_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.table(spark, sf_dir, "pages").select("page_id", text.drop_non_content(F.col("html")).alias("rest"))


def cleaned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = feed.table(spark, sf_dir, "pages").select("page_id", "html")
    return text.with_clean_text(pages, {"body": "html"}).select("page_id", "body")


def decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = feed.table(spark, sf_dir, "pages")
    messy = F.concat(F.col("html"), F.lit("&#38;amp; &#x41;&#0066;&Hellip;&#xZ; &#12ab &#65ab; &nbsp"))
    pages = pages.select("page_id", messy.alias("html"))
    return pages.select("page_id", text.decode_entities("html").alias("decoded"))


def folded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = feed.table(spark, sf_dir, "documents")
    spellings = F.array(
        F.col("source"), F.concat(F.lit("HTTPS://www."), F.col("source"), F.lit(".co.id/a b")),
        F.concat(F.lit(" The\t"), F.upper("source"), F.lit(" ")), F.concat(F.lit("WWW."), F.col("source"), F.lit("-x.net")),
    )
    docs = docs.select("doc_id", F.posexplode(spellings).alias("form", "spelling"))
    return docs.select("doc_id", "form", names.fold_source(F.col("spelling")).alias("key"))


def canonical_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links, and each of them made as messy as it can be."""
    pages = feed.table(spark, sf_dir, "pages")
    scheme, host = F.substring_index("url", "://", 1), F.regexp_extract("url", "://([^/?#]+)", 1)
    path = F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1)
    port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":080"))
    messy = F.concat(
        F.lit("  "), F.upper(scheme), F.lit("://"), F.upper(host), port, F.lit("/x/.."), path,
        F.lit("?z="), F.col("page_id").cast("string"), F.lit("&a=é%20b~&GCLID=1&&a=2&flag&ref=9#part"),
    )
    number = F.col("page_id").cast("string")
    hosts = [F.concat(F.lit(f"http://{host}/"), number) for host in ("0x0000000000000007f.0.0.1", "[0:0:0:0:0:0:0:1]", "Straße.de")]
    pages = pages.select("page_id", F.posexplode(F.array(F.col("url"), messy, *hosts)).alias("form", "link"))
    return urls.with_canonical_url(pages, "link").select("page_id", "form", "url", "url_raw")


def _event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over four years, so that every month and day occurs."""
    days = F.make_dt_interval(F.pmod(F.col("event_id"), F.lit(1461)).cast("int"))
    return feed.utc_events(spark, sf_dir).select("event_id", (F.col("ts") + days).alias("t"))


def _parsed(df: DataFrame, written: Column, number: Column | None = None) -> DataFrame:
    df = df.withColumn("written", written)
    if number is not None:
        df = df.withColumn("number", number)
    df = dates.with_published_at(df, "written", None if number is None else "number", out="at")
    return df.select("event_id", dates.iso_utc(F.col("at")).alias("at"))


def _form(n: int) -> Column:
    return F.pmod(F.col("event_id"), F.lit(n))


def epoch_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _event_dates(spark, sf_dir)
    seconds, millis = F.unix_seconds("t"), F.unix_millis("t")
    written = F.when(_form(3) == 0, seconds.cast("string")).when(_form(3) == 1, millis.cast("string"))
    return _parsed(df, written, F.when(_form(3) == 2, millis / 1000))


def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _event_dates(spark, sf_dir)
    ahead, behind = F.col("t") + F.expr("INTERVAL 7 HOURS"), F.col("t") - F.expr("INTERVAL '3:30' HOUR TO MINUTE")
    second = "yyyy-MM-dd'T'HH:mm:ss"
    return _parsed(df, (
        F.when(_form(6) == 0, F.date_format("t", second + "'Z'"))
        .when(_form(6) == 1, F.concat(F.date_format(ahead, second), F.lit("+07:00")))
        .when(_form(6) == 2, F.concat(F.date_format(behind, second + ".SSSSSS"), F.lit("-0330")))
        .when(_form(6) == 3, F.date_format("t", "yyyy-MM-dd HH:mm"))
        .when(_form(6) == 4, F.date_format("t", "yyyy-MM-dd"))
        .otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSS'z'"))
    ))


def numeric_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _event_dates(spark, sf_dir)
    return _parsed(df, (
        F.when(_form(4) == 0, F.date_format("t", "yyyy/M/d")).when(_form(4) == 1, F.date_format("t", "dd-MM/yyyy"))
        .when(_form(4) == 2, F.date_format("t", "M.d.yyyy")).otherwise(F.date_format("t", "dd/MM/yyyy HH:mm"))
    ))


def named_month_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _event_dates(spark, sf_dir)
    english, indonesian = (feed._month_name(F.col("t"), n) for n in (feed.ENGLISH_MONTHS, feed.INDONESIAN_MONTHS))
    return _parsed(df, (
        F.when(_form(4) == 0, F.concat_ws(" ", F.date_format("t", "d"), F.upper(indonesian), F.date_format("t", "yyyy, HH.mm.ss")))
        .when(_form(4) == 1, F.concat_ws(" ", english, F.date_format("t", "dd, yyyy H:mm")))
        .when(_form(4) == 2, F.concat_ws("  ", F.date_format("t", "dd"), F.substring(english, 1, 3), F.date_format("t", "yyyy")))
        .otherwise(F.concat_ws(" ", F.lit("Foo"), F.date_format("t", "d, yyyy")))
    ))


def local_zone_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _event_dates(spark, sf_dir)
    label = F.element_at(F.array(F.lit("WIB"), F.lit("wita"), F.lit("Wit")), (_form(3) + 1).cast("int"))
    return _parsed(df, F.concat_ws(" ", F.date_format("t", "yyyy-MM-dd HH:mm:ss"), label))


def mail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _event_dates(spark, sf_dir)
    body = F.date_format("t", "EEE, d MMM yyyy HH:mm:ss")
    zone = F.element_at(F.array(F.lit(" GMT"), F.lit(" +0700"), F.lit(""), F.lit(" EST")), (_form(4) + 1).cast("int"))
    return _parsed(df, F.concat(body, zone))


def utc_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _event_dates(spark, sf_dir)
    return df.groupBy(dates.utc_day(F.col("t")).alias("day")).agg(F.count("*").alias("count"))


def parsed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter in every shape, suffixes included."""
    events = feed.table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 100).cast("bigint").alias("n"))
    events = events.select("event_id", "n", F.explode(F.sequence(F.lit(0), F.lit(feed.COUNT_SHAPES))).alias("form"))
    events = events.withColumns({
        "written": F.when(F.col("form") == feed.COUNT_SHAPES, F.concat(F.lit("1."), F.repeat(F.lit("0"), 305), F.lit("k"))).otherwise(
            feed.count_text(F.col("form"), F.col("n"))),
        "number": F.when(F.col("form") == 7, F.col("n").cast("double")),
    })
    return counts.with_count(events, "written", "number", out="count").select("event_id", "form", "count")


def schemeless_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.table(spark, sf_dir, "pages").select("page_id", fingerprints.schemeless(F.col("url")).alias("link"))


def comparison_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.table(spark, sf_dir, "documents").select("doc_id", fingerprints.comparison_form(F.col("text")).alias("form"))


def mention_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printable(normalized_feed(spark, sf_dir).select("ordinal", "fingerprint", "fingerprint_strategy"))


# De-duplication -------------------------------------------------------------

def first_wins_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalized_feed(spark, sf_dir).where(F.col("reason").isNull())
    return dedup.first_wins(rows, ["ordinal"]).select("ordinal", "source", "url")


def canonical_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over a table in which a second writer stored every row again."""
    stored = stored_feed(spark, sf_dir)
    second = stored.withColumns({"batch_id": F.lit("late"), "id": -F.col("id")})
    return dedup.canonical_mentions(stored.unionByName(second)).select("id", "batch_id")


def not_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of the feed whose fingerprint no dated stored row has."""
    firsts = dedup.first_by_fingerprint(normalized_feed(spark, sf_dir).where(F.col("reason").isNull()), ["ordinal"])
    return _printable(dedup.not_stored(firsts, search.dated(stored_fingerprints(spark, sf_dir))))


def already_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = dedup.first_by_fingerprint(normalized_feed(spark, sf_dir).where(F.col("reason").isNull()), ["ordinal"])
    return _printable(dedup.already_stored(firsts, search.dated(stored_fingerprints(spark, sf_dir))))


def within_batch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.within_batch_duplicates(normalized_feed(spark, sf_dir))


def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = ingestion.report_frame(spark, feed_table(spark, sf_dir)).where(F.col("batch_id") == "feed")
    return reports.select(
        "received", "accepted", "rejected", "inserted", "duplicates",
        F.col("duplicate_breakdown.within_batch").alias("within_batch"),
        F.col("duplicate_breakdown.already_stored").alias("already_stored"),
        F.size("errors").cast("bigint").alias("errors_listed"),
    )


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feed as files of lines, ingested two thirds of the files in the first micro-batch.
    The number of files, and so of tasks that write and read them, grows with the feed."""
    base = f"{work_dir(spark)}/stream-{uuid4().hex}"
    times = max(1, -(-feed.feed_bytes(spark, sf_dir) // (3 * LINES_FILE_BYTES)))
    feed.feed_lines(apply_settings(spark), sf_dir).select("json").repartition(3 * times).write.text(f"{base}/lines")
    ingest_stream(spark, f"{base}/lines", f"{base}/table", f"{base}/checkpoint", files_per_batch=2 * times,
                  created_at=lambda n: CREATED_AT).awaitTermination()
    return _printable(read_mentions(spark, f"{base}/table").select("fingerprint", "source"))


# Search and statistics ------------------------------------------------------

def _request(spark: SparkSession, **arguments) -> search.SearchRequest:
    return search.search_request(apply_settings(spark), **arguments)


def _found(spark: SparkSession, sf_dir: str, **arguments) -> DataFrame:
    rows = search.filtered(stored_feed(spark, sf_dir), _request(spark, **arguments).filters)
    return _printable(rows.select("id", "source", "published_at"))


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, q=WORD)


def search_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, q="%")


def search_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, source=SOURCE)


def search_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, **{"from": FROM})


def search_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, to=TO)


def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, q=WORD, source=SOURCE, **{"from": FROM, "to": TO})


def undated_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.undated(stored_feed(spark, sf_dir)).select("id")


def dated_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dated(stored_feed(spark, sf_dir)).select("id")


def filtered_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.filtered(stored_feed(spark, sf_dir), _request(spark, q=WORD, to=TO).filters)
    return rows.agg(F.count("*").alias("total"))


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printable(search.page_of(stored_feed(spark, sf_dir), 1, search.DEFAULT_PAGE_SIZE))


def later_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printable(search.page_of(stored_feed(spark, sf_dir), 4, search.MAX_PAGE_SIZE))


def _paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    request = _request(spark, q=WORD, page=PAGE, page_size=PAGE_SIZE, **{"from": FROM, "to": TO})
    return search.paged_search(stored_feed(spark, sf_dir), request)


def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printable(_paged(spark, sf_dir)[0])


def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, sf_dir)[1]


def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first, found by key instead of offset."""
    stored = stored_feed(spark, sf_dir)
    first = search.page_of(stored, 1, PAGE_SIZE)
    last = first.orderBy(F.asc_nulls_first("published_at"), F.asc("id")).limit(1).select("published_at", "id").first()
    return _printable(search.next_page(stored, PAGE_SIZE, (last["published_at"], last["id"])))


def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stats(stored_feed(spark, sf_dir), "source")[0]


def count_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stats(stored_feed(spark, sf_dir), "day")[0]


def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stats(stored_feed(spark, sf_dir), "day")[1]


def filtered_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.filtered(stored_feed(spark, sf_dir), _request(spark, q=WORD).filters)
    return stats.count_by_source(rows)


def recent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.recent_days(stats.count_by_day(stored_feed(spark, sf_dir)))


def key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.key_figures(stored_feed(spark, sf_dir), search.matching(_request(spark, q=WORD, **{"from": FROM}).filters))


def share_of_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.share_of_maximum(stats.count_by_source(stored_feed(spark, sf_dir)))


def undated_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.undated_worklist(stored_feed(spark, sf_dir)).select("id", "published_at_raw")


def refingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table stored anew under a second version of the fingerprint."""
    target = f"{work_dir(spark)}/refingerprinted-{uuid4().hex}"
    return _printable(ingestion.refingerprint_table(spark, feed_table(spark, sf_dir), target, "v2").select("id", "fingerprint"))


# Profile --------------------------------------------------------------------

def field_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.field_frequency(feed_facts(spark, sf_dir))


def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_types(feed_facts(spark, sf_dir))


def date_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.date_fields(feed_facts(spark, sf_dir))


def unparsable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.unparsable_dates(feed_facts(spark, sf_dir))


def value_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_flags(feed_facts(spark, sf_dir))


def source_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.source_folding(feed_facts(spark, sf_dir))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fingerprint_groups(normalized_feed(spark, sf_dir))


def strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.strategy_counts(normalized_feed(spark, sf_dir))


def record_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.record_totals(normalized_feed(spark, sf_dir))


def _spelling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.source_folding(feed_facts(spark, sf_dir)).select(F.col("spelling").alias("key"), "count")


def top_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_report(_spelling_counts(spark, sf_dir))


def rows_beyond_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rows_beyond_report(_spelling_counts(spark, sf_dir))


REGISTERED: list[Callable[[SparkSession, str], DataFrame]] = [
    json_lines_batch, json_document_batch, whole_file_documents, large_array_documents, stored_mentions, surrogate_keys, constraint_check,
    raw_retention, rejected_records, first_rejects, exported_rows, normalized_mentions, coerced_inputs,
    reject_reasons, accept_reject_split, collapsed_whitespace, html_detection, content_elements, cleaned_pages,
    decoded_entities, folded_sources, canonical_links, epoch_dates, iso_dates, numeric_dates, named_month_dates,
    local_zone_dates, mail_dates, utc_days, parsed_counts, schemeless_links, comparison_forms, mention_fingerprints,
    first_wins_batch, canonical_view, not_stored, already_stored, within_batch_duplicates, ingestion_report,
    idempotent_append, incremental_ingest, search_text, search_wildcards, search_source, search_from, search_to,
    search_combined, undated_mentions, dated_mentions, filtered_total, first_page, later_page, paged_search,
    pagination, next_page, count_by_source, count_by_day, missing_dates, filtered_source_counts, recent_days,
    key_figures, share_of_maximum, undated_worklist, refingerprinted, field_frequency, value_types, date_fields,
    unparsable_dates, value_flags, source_folding, fingerprint_groups, strategy_counts, record_totals, top_report,
    rows_beyond_report,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(query):
        return lambda spark, sf_dir: query(apply_settings(spark), sf_dir)

    return {query.__name__: prepared(query) for query in REGISTERED}
