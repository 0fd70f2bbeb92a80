import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from data import ACCEPTED, MESSY, STORED
from presslake.operators import dedup, profile
from presslake.operators.normalize import normalize

EXTRA = ["words", 8, None, {"published_at": "", "date": False, "created_at": 3, "publisher": "<u>&</u>", "views": " 12,000 "}]
RECORDS = MESSY + EXTRA
TYPES = {str: "string", bool: "boolean", int: "number", list: "array", dict: "object", type(None): "null"}


@pytest.fixture(scope="module")
def raw(spark):
    lines = [(i, json.dumps(r)) for i, r in enumerate(RECORDS)]
    return spark.createDataFrame(lines, "ordinal long, j string").select("ordinal", F.parse_json("j").alias("raw"))


@pytest.fixture(scope="module")
def facts(raw):
    return profile.field_facts(raw).cache()


def pairs(df):
    return {r["key"]: r["count"] for r in df.collect()}


def test_fields_and_types(facts):
    objects = [r for r in RECORDS if isinstance(r, dict)]
    assert pairs(profile.field_frequency(facts)) == Counter(k for r in objects for k in r)
    got = pairs(profile.value_types(facts))
    others = {k: v for k, v in got.items() if k.startswith("non-object")}
    assert {k: v for k, v in got.items() if k not in others} == Counter(f"{k}: {TYPES[type(v)]}" for r in objects for k, v in r.items())
    assert sum(others.values()) == len(RECORDS) - len(objects)


def test_dates(facts):
    assert pairs(profile.date_fields(facts)) == {"publishedAt": 1, "created_at": 2, "date": 3, "published_at": 4, "published_date": 1}
    assert pairs(profile.unparsable_dates(facts)) == {'"soon"': 1, "false": 1, "3": 1}
    flags = profile.value_flags(facts).first()
    assert (flags["missing_dates"], flags["html_values"], flags["numeric_texts"]) == (1, 7, 1)


def test_folding_and_reports(facts):
    rows = {(r["source"], r["spelling"]): r["count"] for r in profile.source_folding(facts).collect()}
    assert rows[("reefradio", "Reef Radio")] == 2 and rows[("reefradio", "REEF RADIO!")] == 1 and rows[("orbitweekly", "orbitweekly.net")] == 1
    assert not any(source == "" for source, _ in rows)
    counts = profile.field_frequency(facts)
    top = profile.top_report(counts, 4).collect()
    assert [r["count"] for r in top] == sorted((r["count"] for r in counts.collect()), reverse=True)[:4] and top[0]["key"] == "source"
    assert profile.rows_beyond_report(counts, 4).first()[0] == counts.count() - 4


def test_fingerprint_figures(raw):
    normalized = normalize(raw)
    assert tuple(dedup.fingerprint_groups(normalized).first()) == (len(STORED), 2, 2)
    links = sum(1 for i in ACCEPTED if {"link", "permalink"} & MESSY[i].keys())
    assert pairs(dedup.strategy_counts(normalized).withColumnRenamed("strategy", "key")) == {"url": links, "content": len(ACCEPTED) - links}
    assert tuple(profile.record_totals(normalized).first()) == (len(RECORDS), len(RECORDS) - len(ACCEPTED))
