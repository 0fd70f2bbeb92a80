"""The feed of ``plans.feed`` ingested once per application.

Searches, counts and profiles read the stored table and the staged frames, as a
service reads its database, instead of normalizing the feed on every call.
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from presslake.operators.dedup import write_fingerprint_index
from presslake.operators.profile import field_facts
from presslake.plans.ingest import ingest, stage, stage_name
from presslake.session import apply_settings, work_dir
from presslake.plans.feed import raw_mentions
from presslake.sources.mentions_table import delete_folder, read_mentions

BATCH = "feed"
CREATED_AT = datetime(2024, 6, 1, tzinfo=timezone.utc)

_done: set[tuple[str, str, str]] = set()
_lock = threading.RLock()


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]) -> None:
    key = (spark.sparkContext.applicationId, sf_dir, what)
    with _lock:
        if key not in _done:
            make()
            _done.add(key)


def _name(sf_dir: str) -> str:
    return f"feed-{zlib.crc32(sf_dir.encode()):x}"


def feed_table(spark: SparkSession, sf_dir: str) -> str:
    """Path of the table that holds the feed as one committed batch."""
    apply_settings(spark)
    path = f"{work_dir(spark)}/{_name(sf_dir)}/table"

    def make() -> None:
        raw = stage(spark, raw_mentions(spark, sf_dir), f"{_name(sf_dir)}/raw")
        ingest(spark, raw, path, BATCH, CREATED_AT, keep_stages=True)
        staged = f"{work_dir(spark)}/{stage_name(path, BATCH)}"
        stage(spark, _without_text(spark.read.parquet(f"{staged}/normalized/*")), f"{_name(sf_dir)}/normalized")
        delete_folder(spark, staged)

    _once(spark, sf_dir, "table", make)
    return path


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed_table(spark, sf_dir)
    return spark.read.parquet(f"{work_dir(spark)}/{_name(sf_dir)}/raw")


def _without_text(normalized: DataFrame) -> DataFrame:
    return normalized.drop("content").withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))


def normalized_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized rows, refused ones included, without what takes nearly all their disk and
    is kept elsewhere: content (in the stored table) and accepted originals (``raw_feed``)."""
    feed_table(spark, sf_dir)
    return spark.read.parquet(f"{work_dir(spark)}/{_name(sf_dir)}/normalized")


def stored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_mentions(spark, feed_table(spark, sf_dir))


def stored_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored feed's fingerprints as a table bucketed by fingerprint (``dedup.write_fingerprint_index``)."""
    app = "".join(ch if ch.isalnum() else "_" for ch in spark.sparkContext.applicationId)
    name = f"presslake_fingerprints_{_name(sf_dir).replace('-', '_')}_{app}"
    _once(spark, sf_dir, "fingerprints", lambda: write_fingerprint_index(stored_feed(spark, sf_dir), name))
    return spark.table(name)


def feed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{_name(sf_dir)}/facts"
    _once(spark, sf_dir, "facts", lambda: stage(spark, field_facts(raw_feed(spark, sf_dir)), name))
    return spark.read.parquet(f"{work_dir(spark)}/{name}")
