import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from data import ACCEPTED, MESSY, REFUSED, STORED
from presslake.operators.constraints import constraint_violations
from presslake.operators.dedup import canonical_mentions
from presslake.operators.stats import count_by_day, count_by_source, missing_dates
from presslake.plans import ingest as ingest_plan
from presslake.plans.ingest import ingest, refingerprint, refingerprint_table
from presslake.sources import batches
from presslake.sources.batches import BatchError, read_json_arrays, read_json_documents, read_json_lines, with_ordinal
from presslake.sources.mentions_table import Log, compact, copy_table, read_log, read_mentions, read_rejects, vacuum
from presslake.streaming.incremental import ingest_stream

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def put(folder, name, body):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder / name)


def as_lines(records):
    return "".join(json.dumps(r) + "\n" for r in records)


def store(spark, tmp_path, records, batch_id="b1", table="table"):
    raw = read_json_documents(spark, put(tmp_path / "in", f"{batch_id}-{table}.json", records))
    return ingest(spark, raw, str(tmp_path / table), batch_id, NOW)


def test_report_and_rows(spark, tmp_path):
    report = store(spark, tmp_path, MESSY)
    assert [report[k] for k in ("received", "accepted", "rejected", "inserted", "duplicates")] == [13, 10, 3, 8, 2]
    assert report["duplicate_breakdown"] == {"within_batch": 2, "already_stored": 0}
    assert [e["index"] for e in report["errors"]] == sorted(REFUSED)
    assert all(REFUSED[e["index"]] in e["reason"] for e in report["errors"])
    table = str(tmp_path / "table")
    rows = {r["ordinal"]: r for r in read_mentions(spark, table).withColumn("at", F.date_format("published_at", "dd HH:mm:ss")).collect()}
    assert sorted(rows) == STORED
    assert {i: r["engagement"] for i, r in rows.items() if r["engagement"] is not None} == {0: 98765, 1: 17, 4: 2500, 7: 1500}
    assert {i: r["at"] for i, r in rows.items()} == {
        0: "07 21:05:30", 1: "07 21:00:00", 4: "07 00:00:00", 7: None, 8: "08 00:00:00", 9: "07 21:45:00", 11: "08 21:20:00", 12: "09 05:00:00"}
    assert (rows[0]["url"], rows[0]["content"], rows[0]["source_raw"]) == ("http://orbitweekly.net/sky/comet?lang=en", "Green tail", "Orbit Weekly")
    assert (rows[9]["source"], rows[9]["title"], rows[9]["content"], rows[9]["author"]) == ("saltsail", "Regatta results", "Won by ⛵", "Ida Moe")
    assert rows[4]["source"] == "hutanlestari" and rows[11]["source"] == "7" and rows[7]["published_at_raw"] == "soon"
    assert rows[0]["raw"].toPython() == MESSY[0]
    stored = read_mentions(spark, table)
    assert {r["group"]: r["count"] for r in count_by_source(stored).collect()} == {
        "reefradio": 2, "lighthouse": 2, "orbitweekly": 1, "hutanlestari": 1, "saltsail": 1, "7": 1}
    assert [(r["group"], r["count"]) for r in count_by_day(stored).collect()] == [("2023-10-07", 4), ("2023-10-08", 2), ("2023-10-09", 1)]
    assert missing_dates(stored).first()[0] == 1
    assert {r["violations"] for r in constraint_violations(stored).collect()} == {0}
    assert {r["ordinal"] for r in read_rejects(spark, table).collect()} == set(REFUSED)


def test_each_rule_can_be_broken(spark, tmp_path):
    store(spark, tmp_path, MESSY)
    stored = read_mentions(spark, str(tmp_path / "table"))
    broken = stored.withColumns({
        "source": F.when(F.col("ordinal") != 7, F.col("source")), "engagement": F.when(F.col("ordinal") == 8, F.lit(-4)),
        "fingerprint": F.when(F.col("ordinal") == 9, F.unhex(F.lit("00"))).otherwise(F.col("fingerprint")),
    }).unionByName(stored.where("ordinal = 12"))
    found = {r["rule"]: r["violations"] for r in constraint_violations(broken).collect() if r["violations"]}
    assert found == {"source_not_null": 1, "engagement_natural": 1, "fingerprint_length": 1, "fingerprint_unique": 1}


def test_a_committed_batch_is_not_stored_again(spark, tmp_path):
    first = store(spark, tmp_path, MESSY)
    assert store(spark, tmp_path, MESSY) == first
    second = store(spark, tmp_path, {"mentions": MESSY[::-1], "note": "same records"}, "b2")
    assert (second["inserted"], second["duplicate_breakdown"]) == (0, {"within_batch": 2, "already_stored": 8})
    table = str(tmp_path / "table")
    assert read_mentions(spark, table).count() == 8
    assert sorted(r["batch_id"] for r in read_log(spark, table).collect()) == ["b1", "b2"]


def test_a_batch_id_with_other_records_raises(spark, tmp_path):
    store(spark, tmp_path, MESSY[:2])
    with pytest.raises(BatchError, match="another input"):
        store(spark, tmp_path, MESSY[:3])
    assert read_mentions(spark, str(tmp_path / "table")).count() == 2


def test_later_batches_keep_first_values_and_ids_grow(spark, tmp_path):
    store(spark, tmp_path, MESSY[:2])
    report = store(spark, tmp_path, [MESSY[12], {**MESSY[0], "headline": "Comet fades"}, MESSY[8]], "b2")
    assert report["inserted"] == 2 and report["duplicate_breakdown"]["already_stored"] == 1
    rows = read_mentions(spark, str(tmp_path / "table")).orderBy("id").collect()
    assert [(r["batch_id"], r["ordinal"]) for r in rows] == [("b1", 0), ("b1", 1), ("b2", 0), ("b2", 2)]
    assert rows[0]["title"] == "Comet brightens"


def test_parts_without_a_log_entry_do_not_count(spark, tmp_path):
    table = str(tmp_path / "table")
    store(spark, tmp_path, MESSY[:2])
    read_mentions(spark, table).write.parquet(f"{table}/mentions/b2-dead")  # a writer that died
    assert read_mentions(spark, table).count() == 2
    assert store(spark, tmp_path, MESSY[:2], "b2")["inserted"] == 0
    assert vacuum(spark, table) == ["mentions/b2-dead"]
    assert read_mentions(spark, table).count() == 2


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """While one writer is between its decision and its log entry, another commits."""
    real, done = ingest_plan.write_part, []

    def interrupted(df, table, folder, part):
        real(df, table, folder, part)
        if folder == "mentions" and not done:
            done.append(1)
            done.append(store(spark, tmp_path, MESSY[4:], "fast"))

    monkeypatch.setattr(ingest_plan, "write_part", interrupted)
    slow = store(spark, tmp_path, MESSY[:9], "slow")
    rows = read_mentions(spark, str(tmp_path / "table")).collect()
    assert len(rows) == len({r["fingerprint"] for r in rows}) == len({r["id"] for r in rows}) == slow["inserted"] + done[1]["inserted"] == 8
    assert [r["batch_id"] for r in read_log(spark, str(tmp_path / "table")).collect()] == ["fast", "slow"]
    assert vacuum(spark, str(tmp_path / "table")) == []


def test_the_same_batch_by_two_writers(spark, tmp_path, monkeypatch):
    real, reports = ingest_plan.write_part, []

    def interrupted(df, table, folder, part):
        real(df, table, folder, part)
        if folder == "mentions" and not reports:
            reports.append(None)
            reports.append(store(spark, tmp_path, MESSY))

    monkeypatch.setattr(ingest_plan, "write_part", interrupted)
    assert store(spark, tmp_path, MESSY) == reports[1]
    assert read_mentions(spark, str(tmp_path / "table")).count() == 8


def test_compaction(spark, tmp_path):
    table = str(tmp_path / "table")
    for i in (0, 4, 8):
        store(spark, tmp_path, MESSY[i : i + 5], f"b{i}")
    before = sorted(map(tuple, read_mentions(spark, table).drop("raw").collect()), key=str)
    log = sorted(map(str, read_log(spark, table).collect()))
    part = compact(spark, table)
    assert Log(spark, table).parts == [part]
    assert sorted(map(tuple, read_mentions(spark, table).drop("raw").collect()), key=str) == before
    assert sorted(map(str, read_log(spark, table).collect())) == log
    assert len(vacuum(spark, table)) == 3 and read_mentions(spark, table).count() == len(before)
    (tmp_path / "table/log/compacted").unlink()  # died before the pointer was written
    assert Log(spark, table).parts == [part]
    assert store(spark, tmp_path, MESSY, "again")["inserted"] == 0 and compact(spark, table) is not None
    assert read_rejects(spark, table).count() == 6
    copied = copy_table(spark, table, str(tmp_path / "copy"))
    assert read_mentions(spark, copied).count() == len(before) and Log(spark, copied).last_id == Log(spark, table).last_id


def test_empty_batch(spark, tmp_path):
    report = store(spark, tmp_path, [])
    assert report["received"] == report["inserted"] == report["duplicates"] == 0 and report["errors"] == []
    table = read_mentions(spark, str(tmp_path / "table"))
    assert count_by_source(table).collect() == [] and missing_dates(table).first()[0] == 0
    assert store(spark, tmp_path, MESSY, "b2")["inserted"] == len(STORED)


@pytest.mark.parametrize("body", [{"records": []}, "[1, 2", '"text"', {"mentions": 5}])
def test_unusable_document_is_refused_whole(spark, tmp_path, body):
    with pytest.raises(BatchError):
        store(spark, tmp_path, body)
    assert read_mentions(spark, str(tmp_path / "table")).count() == 0


def test_bad_lines(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", as_lines(MESSY[:1]) + "{cut\n\n" + as_lines(MESSY[7:9]))
    raw = read_json_lines(spark, str(tmp_path / "in"))
    with pytest.raises(BatchError):
        ingest(spark, raw, str(tmp_path / "table"), "b1", NOW)
    report = ingest(spark, raw, str(tmp_path / "table"), "b1", NOW, bad_lines="reject")
    assert [report[k] for k in ("received", "accepted", "inserted")] == [4, 3, 3]
    assert report["errors"] == [{"index": 1, "reason": batches.NOT_JSON}]
    with pytest.raises(ValueError):
        ingest(spark, raw, str(tmp_path / "table"), "b2", NOW, bad_lines="skip")


def test_staged_tables_go_after_the_commit(spark, tmp_path):
    import os

    from presslake.session import work_dir
    folder = f"{work_dir(spark)}/ingest"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    store(spark, tmp_path, MESSY)
    assert set(os.listdir(folder)) == before


@pytest.mark.parametrize("splits", [4_000_000, 0])
def test_lines_keep_their_order_across_splits_and_files(spark, tmp_path, monkeypatch, splits):
    monkeypatch.setattr(batches, "BROADCAST_SPLITS", splits)
    want = []
    for part in (8, 9, 10, 101):  # by number, not by letter
        records = [{"source": f"s{part}", "title": f"t{i} " + "y" * (i % 50)} for i in range(50 * part)]
        put(tmp_path / "in", f"part-{part}.jsonl", as_lines(records))
        want += [(r["source"], r["title"]) for r in records]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read_json_lines(spark, str(tmp_path / "in")).write.parquet(str(tmp_path / "stored"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = with_ordinal(spark.read.parquet(str(tmp_path / "stored"))).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(len(want)))
    assert [(v["source"], v["title"]) for v in (r["raw"].toPython() for r in got)] == want


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_ordinals_add_up_over_ranges_of_splits(spark, tmp_path, monkeypatch, ranges):
    """Running sums range by range, plus the totals of the ranges before: the same order as
    one running sum over all splits, and no window without a partition in the plan."""
    monkeypatch.setattr(batches, "ORDER_RANGES", ranges)
    want = []
    for part in (2, 10, 11, 100):
        records = [{"source": f"s{part}", "n": i} for i in range(40 * part)]
        put(tmp_path / "in", f"part-{part}.jsonl", as_lines(records))
        want += [(r["source"], r["n"]) for r in records]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read_json_lines(spark, str(tmp_path / "in")).write.parquet(str(tmp_path / "stored"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    stored = spark.read.parquet(str(tmp_path / "stored"))
    assert stored.select("file", "block").distinct().count() > 2 * ranges
    got = with_ordinal(stored).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(len(want)))
    assert [(v["source"], int(v["n"])) for v in (r["raw"].toPython() for r in got)] == want
    splits = stored.groupBy("file", "block").agg(F.min("row").alias("_low"), F.max("row").alias("_high"))
    plan = batches._split_offsets(splits)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def test_one_large_array_is_read_by_many_tasks_as_the_whole_document_is(spark, tmp_path):
    """Pieces cut at commas, string and depth state from running sums: the same rows as the
    whole-file reader, for a file of many splits and for documents it must read whole."""
    records = [{"source": f"s{i}", "title": ["a,b", 'q"u,o\\"te', "[x,{y", "}],", "back\\\\", "é,ü"][i % 6] * (1 + i % 4),
                "n": [i, {"k": [1, {"z": "]"}]}], "e": {}} for i in range(1500)]
    docs = {
        "big.json": json.dumps(records), "pretty.json": json.dumps(records[:40], indent=2), "empty.json": "[]", "spaced.json": "  [ ]  ",
        "one.json": "[5]", "cut.json": json.dumps(records[:20])[:300], "wrapped.json": json.dumps({"mentions": records[:2]}),
        "scalar.json": "7", "nothing.json": "", "two.json": "[1],[2]", "trailing.json": "[1,]",
    }
    for name, text in docs.items():
        put(tmp_path / "in", name, text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", ",").text(str(tmp_path / "in")).rdd.getNumPartitions() > 10
        got = read_json_arrays(spark, str(tmp_path / "in"))
        rows = lambda df: sorted(
            (r.file.rsplit("/", 1)[1], r.row, r.block, r.malformed or "", "" if r.raw is None else json.dumps(r.raw.toPython(), sort_keys=True))
            for r in df.select("file", "row", "block", "malformed", "raw").collect()
        )
        assert rows(got) == rows(read_json_documents(spark, str(tmp_path / "in")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_duplicates_take_the_shuffled_way(spark, tmp_path, monkeypatch):
    records = [{"source": "Tide", "content": f"wave {i % 11}"} for i in range(300)]
    small = store(spark, tmp_path, records)
    monkeypatch.setattr(ingest_plan, "BROADCAST_ROWS", 10)
    large = store(spark, tmp_path, records, "b1", "other")
    assert small == large and large["inserted"] == 11
    assert sorted(r["ordinal"] for r in read_mentions(spark, str(tmp_path / "other")).collect()) == list(range(11))


def test_canonical_view_over_two_tables(spark, tmp_path):
    store(spark, tmp_path, MESSY[:5])
    one = read_mentions(spark, str(tmp_path / "table"))
    both = one.unionByName(one.withColumns({"batch_id": F.lit("b2"), "id": F.col("id") + 100}))
    assert sorted(r["id"] for r in canonical_mentions(both).collect()) == sorted(r["id"] for r in one.collect())


def test_refingerprint(spark, tmp_path):
    table = str(tmp_path / "table")
    store(spark, tmp_path, MESSY)
    old = {r["id"]: r["fingerprint"] for r in read_mentions(spark, table).collect()}
    assert {r["id"]: r["fingerprint"] for r in refingerprint(read_mentions(spark, table)).collect()} == old
    fresh = refingerprint_table(spark, table, str(tmp_path / "second"), "v2")
    new = {r["id"]: r["fingerprint"] for r in fresh.collect()}
    assert new.keys() == old.keys() and not set(new.values()) & set(old.values())
    with pytest.raises(BatchError):
        refingerprint_table(spark, table, str(tmp_path / "second"), "v2")


def _stream(spark, folder, table, checkpoint, **options):
    ingest_stream(spark, str(folder), table, str(checkpoint), created_at=lambda n: NOW, **options).awaitTermination()


def test_stream_ingests_files_once(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", as_lines(MESSY[:6]))
    put(tmp_path / "in", "b.jsonl", as_lines(MESSY[3:]))
    table = str(tmp_path / "table")
    for _ in range(2):
        _stream(spark, tmp_path / "in", table, tmp_path / "checkpoint", files_per_batch=1)
    assert read_mentions(spark, table).count() == len(STORED)
    reports = read_log(spark, table).collect()
    assert len(reports) == 2 and sum(r["inserted"] for r in reports) == len(STORED)
    put(tmp_path / "in", "c.jsonl", as_lines(MESSY[:1]))
    _stream(spark, tmp_path / "in", table, tmp_path / "checkpoint")
    assert read_mentions(spark, table).count() == len(STORED) and read_log(spark, table).count() == 3


def test_two_streams_into_one_table(spark, tmp_path):
    """Each stream counts its batches from 0; nothing is taken for a repetition."""
    put(tmp_path / "one", "a.jsonl", as_lines(MESSY[:2]))
    put(tmp_path / "two", "a.jsonl", as_lines(MESSY[7:]))
    table = str(tmp_path / "table")
    _stream(spark, tmp_path / "one", table, tmp_path / "c1")
    _stream(spark, tmp_path / "two", table, tmp_path / "c2")
    assert sorted(r["ordinal"] for r in read_mentions(spark, table).collect()) == [0, 0, 1, 1, 2, 4, 5]
    _stream(spark, tmp_path / "two", table, tmp_path / "c3")  # a new checkpoint reads all again
    assert read_mentions(spark, table).count() == 7 and read_log(spark, table).count() == 3
    assert len(ACCEPTED) == 10


def test_normalizing_deals_costly_rows_over_tasks_by_the_size_of_the_input(spark, tmp_path):
    """Records that cost much lie in one file; their number of tasks grows with the input, the rows stay."""
    from presslake.operators.normalize import spread

    spark.range(4000).selectExpr("id AS ordinal", "parse_json(to_json(named_struct('body', repeat(uuid(), 30)))) AS raw").coalesce(1).write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    size = sum(f.stat().st_size for f in (tmp_path / "raw").glob("*.parquet"))
    dealt = spread(raw, size // 40)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert 40 <= len(sizes) <= 42 and max(sizes) < 250 and sum(sizes) == 4000
    lines = raw.select(F.to_json("raw"))
    lines.write.text(f"{tmp_path}/lines")
    size = sum(f.stat().st_size for f in (tmp_path / "lines").glob("*.txt"))
    # The variant made on the way does not count: two tasks of half the text, or all cores.
    assert spread(read_json_lines(spark, f"{tmp_path}/lines"), size // 20).rdd.getNumPartitions() <= 42


def test_lines_of_a_larger_feed_lie_in_more_files(spark, tmp_path, monkeypatch):
    """A file of lines is one task that writes it: their number grows with the feed, two thirds are the first micro-batch."""
    from presslake.plans import queries

    made = {
        "documents": "id AS doc_id, concat('text ', uuid()) AS text, 'en' AS lang, 'src' AS source, 5L AS n_chars",
        "pages": "id AS page_id, concat('http://a.net/', id) AS url, concat('<title>', id, '</title>') AS html",
        "conversations": "id AS conv_id, 0L AS turn, 'user' AS role, 'hello' AS text",
        "events": "id AS event_id, TIMESTAMP '2024-01-05 00:00:00' AS ts, id AS user_id, 'view' AS event_type, 1.5D AS value, '{}' AS props",
    }
    for name, columns in made.items():
        spark.sql(f"SELECT {columns} FROM range(300)").write.parquet(f"{tmp_path}/{name}.parquet")
    stored = sum(f.stat().st_size for name in ("documents", "pages", "conversations") for f in (tmp_path / f"{name}.parquet").glob("*.parquet"))
    monkeypatch.setattr(queries, "LINES_FILE_BYTES", stored // 14, raising=False)
    seen = {}

    class Stop(Exception):
        pass

    def stream(spark, lines, table, checkpoint, files_per_batch=None, **rest):
        seen.update(files=len(spark.read.text(lines).inputFiles()), first=files_per_batch, rows=spark.read.text(lines).count())
        raise Stop

    monkeypatch.setattr(queries, "ingest_stream", stream)
    with pytest.raises(Stop):
        queries.incremental_ingest(spark, str(tmp_path))
    assert seen == {"files": 15, "first": 10, "rows": 300 * 4}


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {name for name in names if name.startswith("shuffle_")}


def _raw_files(spark, path, records, files):
    rows = [(i, json.dumps(record)) for i, record in enumerate(records)]
    df = spark.createDataFrame(rows, "ordinal long, json string").select("ordinal", F.parse_json("json").alias("raw"))
    df.repartition(files, "ordinal").write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_staging_and_storing_leave_no_shuffle_files_and_compress(spark, tmp_path):
    """Shuffles of steps that are over do not add up on disk with those of the next."""
    import time

    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = spark.range(2000).selectExpr("id", "uuid() AS u").repartition(7, "id")
    staged = ingest_plan.stage(spark, rows, f"test-{tmp_path.name}")
    ingest_plan.write_part(rows, str(tmp_path), "mentions", "p")
    ended = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < ended:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert all(".zstd." in f.name for f in (tmp_path / "mentions/p").glob("*.parquet"))
    assert staged.count() == spark.read.parquet(f"{tmp_path}/mentions/p").count() == 2000


def test_a_staged_batch_is_normalized_in_slices_of_its_files(spark, tmp_path):
    from presslake.operators.normalize import SLICES, slices

    raw = _raw_files(spark, tmp_path / "raw", MESSY, 4)
    parts = slices(raw, 1)
    assert 1 < len(parts) <= SLICES and sum(len(p.inputFiles()) for p in parts) == len(raw.inputFiles())
    assert sorted(r["ordinal"] for p in parts for r in p.select("ordinal").collect()) == list(range(len(MESSY)))
    assert len(slices(raw)) == 1 and len(slices(raw.where("ordinal < 5"), 1)) == 1


@pytest.mark.parametrize("broadcast_rows", [2, 0])
def test_slices_give_the_same_table_and_report(spark, tmp_path, monkeypatch, broadcast_rows):
    """Also where losers, or losers and survivors, are too many to broadcast: then each slice is a write of the one part."""
    from presslake.operators.normalize import slices

    raw = _raw_files(spark, tmp_path / "raw", MESSY + MESSY[:5], 4)
    whole = ingest(spark, raw, str(tmp_path / "whole"), "b", NOW)
    monkeypatch.setattr(ingest_plan, "slices", lambda rows: slices(rows, 1))
    monkeypatch.setattr(ingest_plan, "BROADCAST_ROWS", broadcast_rows)
    assert ingest(spark, raw, str(tmp_path / "sliced"), "b", NOW) == whole
    rows = [sorted(map(str, read_mentions(spark, str(tmp_path / t)).drop("raw").collect())) for t in ("whole", "sliced")]
    assert rows[0] == rows[1] and len(rows[0]) == whole["inserted"] == len(STORED)
    assert vacuum(spark, str(tmp_path / "sliced")) == []
    assert ingest(spark, raw, str(tmp_path / "sliced"), "again", NOW)["inserted"] == 0


def test_the_stored_feed_keeps_its_text_once(spark, tmp_path):
    """After the feed's ingestion originals and content lie in the raw stage and in the table, not in a normalized stage as well."""
    import os
    from presslake.plans import feed_store
    from presslake.session import work_dir

    made = {
        "documents": "id AS doc_id, concat('text ', uuid()) AS text, 'en' AS lang, IF(id % 9 = 4, '', 'src') AS source, 5L AS n_chars",
        "pages": "id AS page_id, concat('http://a.net/', id) AS url, concat('<title>', id, '</title>', repeat(uuid(), 50)) AS html",
        "conversations": "id AS conv_id, 0L AS turn, 'user' AS role, 'hello' AS text",
        "events": "id AS event_id, TIMESTAMP '2024-01-05 00:00:00' AS ts, id AS user_id, 'view' AS event_type, 1.5D AS value, '{}' AS props",
    }
    for name, columns in made.items():
        spark.sql(f"SELECT {columns} FROM range(90)").write.parquet(f"{tmp_path}/{name}.parquet")
    table, normalized = feed_store.feed_table(spark, str(tmp_path)), feed_store.normalized_feed(spark, str(tmp_path))
    assert not os.path.exists(f"{work_dir(spark)}/{ingest_plan.stage_name(table, feed_store.BATCH)}")
    assert normalized.count() == feed_store.raw_feed(spark, str(tmp_path)).count() == 90 * 4
    assert normalized.where("reason IS NOT NULL AND raw IS NULL").count() == 0 < normalized.where("reason IS NOT NULL").count()
    assert normalized.where("reason IS NULL AND (raw IS NOT NULL OR fingerprint IS NULL)").count() == 0


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_a_slice_that_is_stored_keeps_no_text_and_gives_the_same_table(spark, tmp_path, monkeypatch, broadcast_rows):
    """One file of the second batch is stored already, the other is mostly new; ``repeats`` also repeats ordinals over both."""
    from presslake.operators.normalize import slices

    new = [{"source": "Fresh", "title": f"Title {i}"} for i in range(6)]
    seen, lean = [], ingest_plan.without_stored
    monkeypatch.setattr(ingest_plan, "without_stored", lambda *a: seen.append(lean(*a)) or seen[-1])
    monkeypatch.setattr(ingest_plan, "BROADCAST_ROWS", broadcast_rows)
    for name, start in (("plain", 100), ("repeats", 3)):
        for part, (first, records) in enumerate(((0, MESSY), (start, new + MESSY[:1]))):
            rows = [(first + i, json.dumps(record)) for i, record in enumerate(records)]
            df = spark.createDataFrame(rows, "ordinal long, json string").select("ordinal", F.parse_json("json").alias("raw"))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-raw")
        raw, found = spark.read.parquet(f"{tmp_path}/{name}-raw"), []
        for cut in (1 << 30, 1):
            table = str(tmp_path / f"{name}-{cut}")
            ingest(spark, _raw_files(spark, f"{table}-first", MESSY, 1), table, "first", NOW)
            monkeypatch.setattr(ingest_plan, "slices", lambda rows: slices(rows, cut))
            report, stored = ingest(spark, raw, table, "second", NOW), read_mentions(spark, table)
            found.append((report, sorted(map(str, stored.withColumn("raw", F.to_json("raw")).collect()))))
            assert stored.where("source IS NULL OR raw IS NULL").count() == 0
        assert found[0] == found[1] and found[0][0]["inserted"] == 6
    slim = [rows for rows in seen if rows is not None]
    assert len(seen) == 4 and len(slim) == 2
