"""Record-level typing, choice of aliases and reasons."""

import json

import pytest
from pyspark.sql import functions as F

from presslake.operators.normalize import normalize

PORT = {"publisher": "Port Ledger", "headline": "Cargo", "permalink": "http://portledger.org/cargo"}

RECORDS = {
    "whole": {"publisher": "\tPort  Ledger ", "headline": "Rum &lt;aged&gt;", "description": "<td>cask</td><td>two</td><style>p{}</style>",
              "permalink": "HTTP://WWW.portledger.org:80/a/../rum/?mc_eid=9#list", "date": "30.11.2022", "reach": "4,700"},
    "undated": {**PORT, "published_date": None},
    "vague_date": {**PORT, "publishedAt": "after the harvest"},
    "fraction_date": {**PORT, "created_at": 77.25},
    "nameless": {"headline": "Who wrote this"},
    "signs_only": {"source_name": "?? --", "headline": "Signs"},
    "name_only": {"publisher": "Port Ledger", "author": "K"},
    "number": 31, "flag": True, "list": [{"publisher": "x"}],
    "second_choice": {"source": "", "publisher": "Harbour 9", "title": "", "headline": "", "text": "Nets", "permalink": "https://h9.io/n"},
    "spaces_win": {**PORT, "title": " \n ", "text": "kept"},
    "spare_object": {**PORT, "views": {"n": 1}},
    "two_faults": {"author": {"n": 1}, "link": [], "publisher": "x", "headline": "y"},
    "true_author": {**PORT, "author": True}, "true_date": {**PORT, "created_at": True},
    "long_number": {**PORT, "title": 1200000.0}, "tiny_number": {**PORT, "title": 0.25},
    "half_count": {**PORT, "views": 3.5}, "whole_count": {**PORT, "views": 408},
    "late_count": {**PORT, "reach": "", "views": "6juta"},
    "mail_link": {**PORT, "permalink": "mailto:a@b.c", "text": "z"},
    "seconds": {**PORT, "date": 1669766400},
    "markup_author": {**PORT, "author_name": "<u>Wu</u> Li"},
}


@pytest.fixture(scope="module")
def rows(spark):
    lines = [(i, name, json.dumps(r)) for i, (name, r) in enumerate(RECORDS.items())]
    raw = spark.createDataFrame(lines, "ordinal long, name string, j string").withColumn("raw", F.parse_json("j"))
    got = normalize(raw.drop("j")).withColumn("at", F.date_format("published_at", "yyyy-MM-dd HH:mm"))
    return {r["name"]: r for r in got.collect()}


def test_one_record_with_everything(rows):
    r = rows["whole"]
    assert r["reason"] is None
    assert {k: r[k] for k in ("source", "source_raw", "title", "content", "url", "at", "engagement")} == {
        "source": "portledger", "source_raw": "Port Ledger", "title": "Rum <aged>", "content": "cask two",
        "url": "http://portledger.org/rum", "at": "2022-11-30 00:00", "engagement": 4700}


@pytest.mark.parametrize("name, kept", [("undated", None), ("vague_date", "after the harvest"), ("fraction_date", "77.25")])
def test_a_date_that_is_not_understood_is_kept_as_written(rows, name, kept):
    assert (rows[name]["published_at"], rows[name]["published_at_raw"], rows[name]["reason"]) == (None, kept, None)


@pytest.mark.parametrize("name, part", [
    ("nameless", "source is required"), ("signs_only", "at least one alphanumeric"), ("name_only", "title or content"),
    ("number", "JSON object"), ("flag", "JSON object"), ("list", "JSON object"),
    ("spare_object", "views: Invalid input"), ("two_faults", "link: Invalid input"), ("true_date", "created_at: Invalid input"),
])
def test_reasons(rows, name, part):
    assert part in rows[name]["reason"] and rows[name]["fingerprint"] is None


@pytest.mark.parametrize("name, field, value", [
    ("second_choice", "source", "harbour9"), ("second_choice", "title", None), ("second_choice", "content", "Nets"),
    ("spaces_win", "title", None), ("true_author", "author", "true"), ("long_number", "title", "1200000"), ("tiny_number", "title", "0.25"),
    ("half_count", "engagement", None), ("whole_count", "engagement", 408), ("late_count", "engagement", 6_000_000),
    ("mail_link", "url", None), ("mail_link", "url_raw", None), ("mail_link", "fingerprint_strategy", "content"),
    ("seconds", "at", "2022-11-30 00:00"), ("markup_author", "author", "Wu Li"), ("undated", "fingerprint_strategy", "url"),
])
def test_values(rows, name, field, value):
    assert rows[name][field] == value


def test_the_original_is_kept(rows):
    assert rows["spare_object"]["raw"].toPython() == RECORDS["spare_object"]


def test_the_link_decides_identity(rows):
    same = [rows[n]["fingerprint"] for n in ("undated", "seconds", "whole_count")]
    assert len(set(same)) == 1 and len(same[0]) == 32 and rows["second_choice"]["fingerprint"] != same[0]


def test_versions_do_not_mix(spark):
    raw = spark.createDataFrame([(0, json.dumps(PORT))], "ordinal long, j string").select("ordinal", F.parse_json("j").alias("raw"))
    assert normalize(raw).first()["fingerprint"] != normalize(raw, "v2").first()["fingerprint"]
