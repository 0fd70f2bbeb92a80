import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from presslake.operators import search, stats, summary
from presslake.operators.export import export_rows
from presslake.plans.ingest import ingest
from presslake.schema import STORED_SCHEMA
from presslake.sources.mentions_table import read_mentions

# Ids follow the order of the list, from 1. Three stories share a time, two have no usable one.
STORIES = [
    {"source": "Tern", "title": "Kelp harvest", "content": "A good year", "url": "https://tern.is/k", "published_at": "2022-05-01T12:00:00Z"},
    {"source": "tern.is", "title": "Boats", "content": "Old boats 100% rebuilt", "url": "https://tern.is/b", "published_at": "2022-05-03T06:30:00Z"},
    {"source": "Gull Post", "title": "HARVEST MOON", "content": "A walk", "url": "https://gull.fo/h", "published_at": "2022-05-03T06:30:00Z"},
    {"source": "Gull Post", "title": "Undated", "content": "kelp_soup", "url": "https://gull.fo/u", "published_at": "around spring"},
    {"source": "Skua", "title": None, "content": "Harvest of ice", "url": "https://skua.gl/i", "published_at": "2022-05-03T06:30:00Z"},
    {"source": "TERN", "title": "Late boat", "content": "came at night", "url": "https://tern.is/l", "published_at": "2022-05-02T23:59:59Z"},
    {"source": "Auk", "title": "Blank", "content": "nothing", "url": "https://auk.no/b"},
    {"source": "Auk", "title": "First light", "content": "at sea", "url": "https://auk.no/f", "published_at": "2022-04-30"},
]
ORDER = [5, 3, 2, 6, 1, 8, 7, 4]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "table")
    lines = [(i, json.dumps(r)) for i, r in enumerate(STORIES)]
    raw = spark.createDataFrame(lines, "ordinal long, j string").select("ordinal", F.parse_json("j").alias("raw"))
    ingest(spark, raw, path, "b1", datetime(2024, 6, 1, tzinfo=timezone.utc))
    return read_mentions(spark, path).cache()


def found(spark, table, **arguments):
    rows, page = search.paged_search(table, search.search_request(spark, **arguments))
    return [r["id"] for r in rows.collect()], page.first()


def test_everything_on_one_page(spark, table):
    ids, page = found(spark, table)
    assert ids == ORDER
    assert page.asDict() == {"page": 1, "page_size": 20, "total": 8, "total_pages": 1, "has_next": False, "has_previous": False}


@pytest.mark.parametrize("arguments, ids", [
    ({"q": "harvest"}, [5, 3, 1]), ({"q": "HARVEST m"}, [3]), ({"q": "%"}, [2]), ({"q": "_"}, [4]), ({"q": "kelp  h"}, []),
    ({"source": "www.TERN.is/x"}, [2, 6, 1]), ({"from": "2022-05-02"}, [5, 3, 2, 6]), ({"to": "2022-05-01"}, [1, 8]),
    ({"to": "1 May 2022"}, [8]), ({"from": "2022-05-02", "to": "2022-05-02"}, [6]), ({"to": "2023-01-01"}, [5, 3, 2, 6, 1, 8]),
    ({"q": "boat", "source": "tern", "to": "2022-05-02"}, [6]), ({"from": "2022-06-01"}, []),
])
def test_filters(spark, table, arguments, ids):
    assert found(spark, table, **arguments)[0] == ids


@pytest.mark.parametrize("size", [1, 3, 5])
def test_pages_cut_the_order_into_pieces(spark, table, size):
    pages = -(-len(ORDER) // size)
    for number in range(1, pages + 2):
        ids, page = found(spark, table, page=number, page_size=size)
        assert ids == ORDER[(number - 1) * size : number * size]
        assert (page["total"], page["total_pages"], page["has_next"], page["has_previous"]) == (8, pages, number < pages, number > 1)


def test_no_rows_no_pages(spark, table):
    ids, page = found(spark, table.limit(0))
    assert ids == [] and (page["total"], page["total_pages"], page["has_previous"]) == (0, 0, False)


def test_a_page_is_found_on_narrow_rows(spark, tmp_path):
    """The sort that finds a page does not carry the texts."""
    spark.createDataFrame([], STORED_SCHEMA).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.schema(STORED_SCHEMA).parquet(f"{tmp_path}/rows")
    plan = search.page_of(rows, 900, 100)._jdf.queryExecution().optimizedPlan().toString()
    narrow = plan[plan.index("GlobalLimit") :]
    assert "Project [published_at" in narrow and "Relation" in narrow
    assert not any("content" in line for line in narrow.splitlines() if "Relation" not in line)


def test_keyset_walk(spark, table):
    after, seen = None, []
    while True:
        rows = search.next_page(table, 3, after).collect()
        if not rows:
            break
        seen += [r["id"] for r in rows]
        at = rows[-1]["published_at"]
        after = (None if at is None else at.replace(tzinfo=timezone.utc), rows[-1]["id"])
    assert seen == ORDER


@pytest.mark.parametrize("arguments, name", [
    ({"page": -3}, "page"), ({"page": "2.0"}, "page"), ({"page": ""}, "page"), ({"page_size": "0"}, "page_size"), ({"page_size": 250}, "page_size"),
    ({"from": "last week"}, "from"), ({"to": "2022-02-30"}, "to"), ({"from": "2022-05-09", "to": "2022-05-02"}, "from"), ({"q": "　"}, "q"),
    ({"q": "é" * 201}, "q"), ({"q": "😀" * 101}, "q"), ({"source": " "}, "source"), ({"source": "***"}, "source"), ({"order": "asc"}, "order"),
])
def test_refused_arguments(spark, arguments, name):
    with pytest.raises(search.SearchError) as error:
        search.search_request(spark, **arguments)
    assert [p[0] for p in error.value.problems] == [name]


def test_accepted_limits(spark):
    request = search.search_request(spark, page_size=100, q="😀" * 100)
    assert request.page_size == 100 and len(request.filters.q) == 100


def test_stats(spark, table):
    buckets, missing = stats.stats(table, "source")
    assert [tuple(r) for r in buckets.collect()] == [("tern", "TERN", 3), ("auk", "Auk", 2), ("gullpost", "Gull Post", 2), ("skua", "Skua", 1)]
    assert missing is None
    days, missing = stats.stats(table, "day")
    assert [tuple(r) for r in days.collect()] == [("2022-04-30", 1), ("2022-05-01", 1), ("2022-05-02", 1), ("2022-05-03", 3)]
    assert missing.first()[0] == 2
    assert [r["group"] for r in stats.recent_days(days, 3).collect()] == ["2022-05-01", "2022-05-02", "2022-05-03"]
    with pytest.raises(ValueError):
        stats.stats(table, "month")


def test_summary_and_worklist(spark, table):
    figures = summary.key_figures(table, search.matching(search.SearchFilters(q="harvest"))).first()
    assert tuple(figures) == (8, 3, 4, 2)
    shares = {r["group"]: r["share"] for r in summary.share_of_maximum(stats.count_by_source(table)).collect()}
    assert shares == {"tern": 100, "auk": 67, "gullpost": 67, "skua": 33}
    assert [r["published_at_raw"] for r in search.undated_worklist(table).collect()] == ["around spring"]


def test_export(spark, table):
    rows = {r["id"]: json.loads(r["json"]) for r in export_rows(table).collect()}
    assert rows[6]["published_at"] == "2022-05-02T23:59:59.000Z" and rows[7]["published_at"] is None and rows[5]["title"] is None
    assert list(rows[1]) == ["id", "source", "source_raw", "title", "content", "url", "published_at", "author", "engagement", "created_at"]
