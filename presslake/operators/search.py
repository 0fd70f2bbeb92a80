"""Filtered, stably ordered, paged reading of the stored table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presslake.functions.dates import with_published_at
from presslake.functions.names import fold_source
from presslake.operators.export import listing

# Limits of the search arguments, and the white space around them.
MAX_QUERY_LENGTH = 200   # UTF-16 units
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
WHITE_SPACE = (
    "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# What a refused argument is told. The rest of a message is its name.
NOT_WHOLE, TOO_SMALL, OUT_OF_RANGE = "must be a positive integer", "must be 1 or greater", "must be between 1 and {}"
BLANK, TOO_LONG, UNKNOWN = "must not be blank", "must be at most {} characters", "unknown argument"
NO_LETTER = "must contain at least one alphanumeric character"
NO_DATE = "is not a recognised date (expected e.g. 2024-03-15 or 2024-03-15T08:30:00Z)"
REVERSED = "must be earlier than or equal to to"


class SearchError(ValueError):
    """Arguments refused; ``problems`` lists ``(argument, message)``."""

    def __init__(self, problems: list[tuple[str, str]]):
        super().__init__("; ".join(f"{name}: {message}" for name, message in problems))
        self.problems = problems


@dataclass(frozen=True)
class SearchFilters:
    q: str | None = None
    source: str | None = None
    start: datetime | None = None
    end: datetime | None = None


@dataclass(frozen=True)
class SearchRequest:
    filters: SearchFilters
    page: int = 1
    page_size: int = DEFAULT_PAGE_SIZE


def _read_arguments(spark: SparkSession, texts: dict[str, str]) -> tuple[str | None, datetime | None, datetime | None]:
    """Runs the column functions of the table on the arguments, so that a query
    and the data can never disagree."""
    given = [(name, texts[name]) for name in ("source", "from", "to") if texts.get(name)]
    if not given:
        return None, None, None
    df = spark.createDataFrame(given, "name string, text string")
    df = with_published_at(df, "text", out="at") if texts.get("from") or texts.get("to") else df.withColumn("at", F.lit(None).cast("timestamp"))
    rows = {r["name"]: r for r in df.select("name", fold_source(F.col("text")).alias("key"), F.unix_millis("at").alias("ms")).collect()}
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def moment(name: str) -> datetime | None:
        ms = rows[name]["ms"] if name in rows else None
        return None if ms is None else epoch + timedelta(milliseconds=ms)

    return rows["source"]["key"] if "source" in rows else None, moment("from"), moment("to")


def _whole_number(name: str, value, problems: list, highest: int | None = None) -> int:
    message = f"{name} {TOO_SMALL if highest is None else OUT_OF_RANGE.format(highest)}"
    if not re.fullmatch("[0-9]+", str(value)):
        problems.append((name, f"{name} {NOT_WHOLE}"))
        return 1
    if int(value) < 1 or (highest is not None and int(value) > highest):
        problems.append((name, message))
    return int(value)


def search_request(spark: SparkSession, **arguments) -> SearchRequest:
    """Checks the arguments ``q, source, from, to, page, page_size`` (use
    ``**{"from": …}``) and raises ``SearchError`` listing all problems.

    A bare ``YYYY-MM-DD`` as upper bound includes that day.
    """
    problems: list[tuple[str, str]] = []
    known = {"q", "source", "from", "to", "page", "page_size"}
    problems += [(name, UNKNOWN) for name in arguments if name not in known]
    texts = {n: arguments[n].strip(WHITE_SPACE) for n in ("q", "source", "from", "to") if arguments.get(n) is not None}
    problems += [(n, f"{n} {BLANK}") for n, value in texts.items() if not value]
    if len(texts.get("q", "").encode("utf-16-le")) > 2 * MAX_QUERY_LENGTH:
        problems.append(("q", f"q {TOO_LONG.format(MAX_QUERY_LENGTH)}"))
    key, start, end = _read_arguments(spark, texts)
    if texts.get("source") and not key:
        problems.append(("source", f"source {NO_LETTER}"))
    for name, parsed in (("from", start), ("to", end)):
        if texts.get(name) and parsed is None:
            problems.append((name, f"{name} {NO_DATE}"))
    if end is not None and re.fullmatch(r"\d{4}-\d{2}-\d{2}", texts["to"], re.ASCII):
        end += timedelta(days=1)
    page = _whole_number("page", arguments.get("page", 1), problems)
    page_size = _whole_number("page_size", arguments.get("page_size", DEFAULT_PAGE_SIZE), problems, MAX_PAGE_SIZE)
    if start is not None and end is not None and start > end:
        problems.append(("from", f"from {REVERSED}"))
    if problems:
        raise SearchError(problems)
    return SearchRequest(SearchFilters(texts.get("q"), key if texts.get("source") else None, start, end), page, page_size)


def contains_text(q: str) -> Column:
    """Case-insensitive substring of title or content; wildcards mean themselves."""
    needle = F.lower(F.lit(q))
    return F.lower("title").contains(needle) | F.lower("content").contains(needle)


def matching(filters: SearchFilters) -> Column:
    """Conjunction of the filters given; true when there are none."""
    conditions = []
    if filters.q is not None:
        conditions.append(F.coalesce(contains_text(filters.q), F.lit(False)))
    if filters.source is not None:
        conditions.append(F.col("source") == filters.source)
    if filters.start is not None:
        conditions.append(F.col("published_at") >= F.lit(filters.start))
    if filters.end is not None:
        conditions.append(F.col("published_at") < F.lit(filters.end))
    return reduce(and_, conditions) if conditions else F.lit(True)


def filtered(stored: DataFrame, filters: SearchFilters) -> DataFrame:
    return stored.where(matching(filters))


def undated(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("published_at").isNull())


def dated(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("published_at").isNotNull())


def undated_worklist(stored: DataFrame) -> DataFrame:
    """Rows whose date was given but not understood."""
    return stored.where(F.col("published_at_raw").isNotNull())


def listing_order() -> list[Column]:
    return [F.desc_nulls_last("published_at"), F.desc("id")]


def at_or_after(published_at: datetime | None, row_id: int, inclusive: bool = False) -> Column:
    """Rows that the listing shows after the given one."""
    id_rule = F.col("id") <= row_id if inclusive else F.col("id") < row_id
    when = F.col("published_at")
    if published_at is None:
        return when.isNull() & id_rule
    moment = F.lit(published_at)
    return when.isNull() | (when < moment) | ((when == moment) & id_rule)


def next_page(rows: DataFrame, page_size: int, after: tuple[datetime | None, int] | None = None) -> DataFrame:
    """Keyset paging: constant cost at any depth."""
    if after is not None:
        rows = rows.where(at_or_after(*after))
    return listing(rows).orderBy(*listing_order()).limit(page_size)


def page_of(rows: DataFrame, page: int, page_size: int) -> DataFrame:
    """Rows of one page; empty past the end.

    The page is found on times and ids alone; only its rows, ``page_size`` at most,
    are then read whole. For a deep page Spark itself turns the top-k of narrow rows
    into a distributed sort.
    """
    keys = rows.select("published_at", "id").orderBy(*listing_order()).offset((page - 1) * page_size).limit(page_size)
    return listing(rows).join(F.broadcast(keys.select("id")), "id", "left_semi").orderBy(*listing_order())


def pagination(rows: DataFrame, page: int, page_size: int) -> DataFrame:
    """One row describing where a page lies among all matching rows."""
    total = F.col("total")
    return rows.agg(F.count("*").alias("total")).select(
        F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), total,
        F.ceil(total / page_size).alias("total_pages"),
        (F.lit(page) < F.ceil(total / page_size)).alias("has_next"),
        (F.lit(page > 1) & (total > 0)).alias("has_previous"),
    )


def paged_search(stored: DataFrame, request: SearchRequest) -> tuple[DataFrame, DataFrame]:
    """The page asked for and its pagination row."""
    rows = filtered(stored, request.filters)
    return page_of(rows, request.page, request.page_size), pagination(rows, request.page, request.page_size)
