"""Bulk ingestion: normalize, de-duplicate, append once, report.

One wide pass normalizes the batch into a staged table. Duplicates are decided
on narrow rows. The survivors are written by a second pass that moves wide rows
only if both they and the duplicates are too many to broadcast, and then a slice at
a time. Every step that is used again is a table in the shared work folder, so a lost
executor costs a task, not the batch; the staged tables go once the batch is committed.

A staged batch for a table that has rows already is normalized slice by slice. A slice
that is mostly stored keeps of the stored rows only what the report needs.

Writers do not wait for each other. A writer decides against the log it has read,
writes its part and takes the next number of the log. If another writer was
faster, it decides again against what that one stored.
"""

from __future__ import annotations

import uuid
import zlib
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from presslake.operators.dedup import BROADCAST_ROWS, already_stored, first_by_fingerprint, first_wins, not_stored
from presslake.operators.keys import with_ids
from presslake.operators.normalize import accepted, normalize, rejected, slices, spread
from presslake.schema import MENTION_COLUMNS, STORED_SCHEMA
from presslake.session import apply_settings, work_dir, write_table
from presslake.sources.batches import BatchError, with_ordinal
from presslake.sources.mentions_table import (
    Log, check_batch_id, commit, delete_folder, read_log, read_mentions, write_part,
)

# Fixed value: how many refused records a report lists.
REPORTED_ERRORS = 50

REPORT = ["received", "accepted", "rejected", "inserted", "duplicates", "duplicate_breakdown", "errors"]


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the work folder and reads it back: a table that survives
    lost executors and cuts the lineage."""
    path = f"{work_dir(spark)}/{name}"
    write_table(df, path, "overwrite")
    return spark.read.parquet(path)


def stage_name(table: str, batch_id: str) -> str:
    return f"ingest/{zlib.crc32(table.encode()):x}-{batch_id}"


def first_rejects(normalized: DataFrame, limit: int = REPORTED_ERRORS) -> DataFrame:
    return rejected(normalized).orderBy("ordinal").limit(limit).select(F.col("ordinal").alias("index"), "reason")


def survivors(rows: DataFrame, kept: DataFrame, dropped: int, kept_rows: int | None = None) -> DataFrame:
    """Accepted rows whose ordinal is in ``kept``. Ordinals are unique, so the
    join is even however uneven the fingerprints are."""
    if dropped == 0:
        return rows
    kept = kept.select("ordinal")
    if dropped <= BROADCAST_ROWS:
        losers = rows.select("ordinal").join(kept, "ordinal", "left_anti")
        return rows.join(F.broadcast(losers), "ordinal", "left_anti")
    if kept_rows is not None and kept_rows <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    return rows.join(kept, "ordinal", "left_semi")


def without_stored(spark: SparkSession, rows: DataFrame, stored: DataFrame, name: str) -> DataFrame | None:
    """The normalized rows, accepted ones whose fingerprint is stored already emptied of what only
    a row to be stored needs. None if that is less than half of them. An ordinal that repeats with
    a fingerprint not stored is left whole; ``emptied`` tells the others."""
    narrow = rows.where("reason IS NULL").select("fingerprint", "ordinal")
    number = narrow.count()
    hits = already_stored(narrow, stored, number)
    fresh = narrow.join(F.broadcast(hits) if number <= BROADCAST_ROWS else hits, "fingerprint", "left_anti")
    fresh = stage(spark, fresh.select("ordinal").distinct(), f"{name}/fresh")
    fresh_rows = fresh.count()
    if 2 * fresh_rows > number:
        return None
    known = fresh.where("ordinal IS NOT NULL").withColumn("_fresh", F.lit(True))
    joined = rows.join(F.broadcast(known) if fresh_rows <= BROADCAST_ROWS else known, "ordinal", "left")
    needed = F.col("reason").isNotNull() | F.col("_fresh").isNotNull() | F.col("ordinal").isNull()
    wide = [c for c in MENTION_COLUMNS if c != "fingerprint"]
    return stage(spark, joined.withColumns({c: F.when(needed, F.col(c)) for c in wide}).select(*rows.columns), f"{name}/rows")


def emptied(rows: DataFrame) -> DataFrame:
    """Accepted rows that ``without_stored`` emptied: no other has no source."""
    return rows.where(F.col("reason").isNull() & F.col("source").isNull())


def stage_normalized(spark: SparkSession, raw: DataFrame, name: str, stored: DataFrame | None = None) -> DataFrame:
    """The batch normalized and staged. Given the rows that are ``stored``, it is staged slice by
    slice if there are several, ``without_stored`` rows."""
    from_text, paths = "malformed" in raw.columns, []
    found = [raw] if stored is None or from_text else slices(raw)
    for i, rows in enumerate(found):
        normalized = normalize(spread(rows)).withColumn("record_hash", _record_hash())
        if from_text:
            normalized = normalized.withColumn("reason", F.coalesce("malformed", "reason")).drop("malformed")
        paths.append(f"{name}/normalized/{i}")
        staged = stage(spark, normalized, paths[i])
        if len(found) > 1 and without_stored(spark, staged, stored, f"{name}/lean/{i}") is not None:
            delete_folder(spark, f"{work_dir(spark)}/{paths[i]}")
            paths[i] = f"{name}/lean/{i}/rows"
    return spark.read.schema(staged.schema).parquet(*[f"{work_dir(spark)}/{path}" for path in paths])


def report_row(counts: dict[str, int], errors: list[Row]) -> dict:
    within_batch = counts["accepted"] - counts["distinct"]
    already = counts["distinct"] - counts["inserted"]
    return {
        "received": counts["received"], "accepted": counts["accepted"],
        "rejected": counts["received"] - counts["accepted"], "inserted": counts["inserted"],
        "duplicates": within_batch + already,
        "duplicate_breakdown": {"within_batch": within_batch, "already_stored": already},
        "errors": [{"index": e["index"], "reason": e["reason"]} for e in errors],
    }


def _record_hash() -> Column:
    return F.xxhash64(F.to_json("raw")).cast("decimal(20,0)")


def _digest(row: Row) -> str:
    """What tells one input from another under the same batch id."""
    return f"{row['received']}:{row['hashes'] or 0}"


def _logged_report(entry: dict, digest: str) -> dict:
    if entry["input"] != digest:
        raise BatchError(f"batch id {entry['batch_id']} is committed for another input")
    return {name: entry[name] for name in REPORT}


def ingest(
    spark: SparkSession, raw: DataFrame, table: str, batch_id: str, created_at: datetime | None = None,
    bad_lines: str = "refuse", keep_stages: bool = False,
) -> dict:
    """Stores a batch of ``ordinal, raw`` rows, or of what the batch readers
    yield, and returns its report.

    A batch id that is committed for the same records is not stored again and its
    logged report is returned; with other records it raises. ``bad_lines`` says
    whether text that is no JSON refuses the batch (``"refuse"``) or is a
    rejected record of its own (``"reject"``).
    """
    if bad_lines not in ("refuse", "reject"):
        raise ValueError("bad_lines must be 'refuse' or 'reject'")
    apply_settings(spark)
    check_batch_id(batch_id)
    log = Log(spark, table)
    if log.batch(batch_id):
        seen = raw.agg(F.count("*").alias("received"), F.sum(_record_hash()).alias("hashes")).first()
        return _logged_report(log.batch(batch_id), _digest(seen))
    created_at = created_at or datetime.now(timezone.utc)

    from_text = "malformed" in raw.columns
    if from_text and bad_lines == "refuse":
        bad = raw.where(F.col("malformed").isNotNull()).select("file", "malformed").first()
        if bad is not None:
            raise BatchError(f"{bad['malformed']} ({bad['file']})")
    name = f"{stage_name(table, batch_id)}" if keep_stages else f"{stage_name(table, batch_id)}-{uuid.uuid4().hex}"
    delete_folder(spark, f"{work_dir(spark)}/{name}")
    lean = bool(log.parts) and not keep_stages
    staged = stage_normalized(spark, raw, name, read_mentions(spark, table, log) if lean else None)
    totals = staged.agg(
        F.count("*").alias("received"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.sum("record_hash").alias("hashes"),
    ).first()
    if from_text:
        staged = with_ordinal(staged)
    last_ordinal = staged.agg(F.max("ordinal")).first()[0]
    rows = accepted(staged)
    firsts = stage(spark, first_by_fingerprint(rows, ["ordinal"]), f"{name}/firsts")
    distinct = firsts.count()
    errors = first_rejects(staged).collect()
    columns = [c for c in STORED_SCHEMA.names if c != "batch_id"]
    attempt, refused = 0, f"{batch_id}-{uuid.uuid4().hex}"
    write_part(rejected(staged).withColumn("batch_id", F.lit(batch_id)), table, "rejects", refused)

    while True:
        log = Log(spark, table)
        if log.batch(batch_id):  # the same batch, by a faster writer
            report = _logged_report(log.batch(batch_id), _digest(totals))
            break
        kept, inserted = firsts, distinct
        if log.parts:
            attempt += 1
            kept = stage(spark, not_stored(firsts, read_mentions(spark, table, log), distinct), f"{name}/kept-{attempt}")
            inserted = kept.count()
        dropped, part = totals["accepted"] - inserted, f"{batch_id}-{uuid.uuid4().hex}"
        if lean and not survivors(emptied(rows.select("ordinal", "reason", "source")), kept, dropped, inserted).isEmpty():
            # Ordinals that repeat over slices: rows that share one with a survivor are stored as well, and so needed whole.
            lean, staged = False, stage_normalized(spark, raw, f"{name}/whole")
            rows = accepted(staged)
        # Too many to broadcast either way: the wide rows are shuffled, a slice at a time.
        shuffled = min(dropped, inserted) > BROADCAST_ROWS
        for number, some in enumerate(map(accepted, slices(staged)) if shuffled else [rows]):
            new = with_ids(survivors(some, kept, dropped, inserted), log.last_id, created_at)
            # Sorted files let min/max statistics skip row groups for source and date filters.
            ordered = new.select(*columns, F.lit(batch_id).alias("batch_id")).sortWithinPartitions("source", "published_at")
            write_part(ordered, table, "mentions", part, **({"more": True} if number else {}))
        counts = {"received": totals["received"], "accepted": totals["accepted"], "distinct": distinct, "inserted": inserted}
        report = report_row(counts, errors)
        max_id = log.last_id if last_ordinal is None else log.last_id + 1 + last_ordinal
        entry = {
            "kind": "batch", "batch_id": batch_id, "created_at": created_at, "max_id": max_id, **report,
            "part": part, "rejects": refused, "input": _digest(totals),
        }
        if commit(spark, table, log.head + 1, [entry]):
            break
        delete_folder(spark, f"{table}/mentions/{part}")
    if not keep_stages:
        delete_folder(spark, f"{work_dir(spark)}/{name}")
    return report


def report_frame(spark: SparkSession, table: str) -> DataFrame:
    """Reports of all committed batches."""
    return read_log(spark, table).drop("max_id", "created_at")


def refingerprint(stored: DataFrame, version: str | None = None) -> DataFrame:
    """Applies the present rules, under a fingerprint version, to the kept
    originals: the stored columns, derived anew, of every stored row."""
    fresh = normalize(spread(stored.select("id", "created_at", "batch_id", "ordinal", "raw")), version)
    return fresh.select(*STORED_SCHEMA.names)


def refingerprint_table(spark: SparkSession, table: str, target: str, version: str) -> DataFrame:
    """Stores ``table`` under another fingerprint version as a new table and returns
    its rows. Rows that agree under the new rules are one: the smallest id stays."""
    log = Log(spark, table)
    fresh = stage(spark, refingerprint(read_mentions(spark, table, log), version), f"refingerprint/{uuid.uuid4().hex}")
    part = f"refingerprint-{uuid.uuid4().hex}"
    write_part(first_wins(fresh, ["id"]).sortWithinPartitions("source", "published_at"), target, "mentions", part)
    entries = [{**e, "part": None, "rejects": None} for e in log.entries if e["kind"] == "batch"]
    entries.append({"kind": "compact", "part": part, "max_id": log.last_id})
    if not commit(spark, target, 1, entries):
        raise BatchError(f"{target} is not empty")
    return read_mentions(spark, target)
