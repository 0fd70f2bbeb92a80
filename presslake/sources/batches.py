"""Batches of raw records read from JSON text.

Both forms yield ``file, block, row, raw, malformed``. ``row`` grows within a
split of a file and ``(file, block, row)`` is the order of the input, but only
while one job reads it: write the result once, read it back, and call
``with_ordinal`` on what was read.
"""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from presslake.session import work_dir

# The split table has one narrow row (three numbers) per input split. Up to this many
# rows, about 100 MB, it is sent to every executor; that is 500 TB in splits of 128 MB.
# A larger one is joined by shuffle.
BROADCAST_SPLITS = 4_000_000
# Ranges the split table is cut into for its running sums. One total per range goes
# through the driver, so at most this many numbers.
ORDER_RANGES = 1024

NOT_JSON = "text is not valid JSON"
NOT_A_BATCH = "document is neither an array nor an object with a mentions array"


class BatchError(ValueError):
    """The batch as a whole is unusable; nothing of it is stored."""


def parse_lines(lines: DataFrame) -> DataFrame:
    """``value`` (one JSON record a line) and file metadata to batch rows."""
    df = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value"),
    )
    df = df.where(~F.col("value").rlike(r"\A\s*\z"))
    df = df.withColumn("raw", F.try_parse_json(F.col("value")))
    return df.withColumn("malformed", F.when(F.col("raw").isNull(), F.lit(NOT_JSON))).drop("value")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The form that scales: files are split and lines parsed in parallel."""
    return parse_lines(spark.read.text(path))


def _is_array(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(c).startswith("ARRAY"), F.lit(False))


def explode_documents(docs: DataFrame, text: str = "value") -> DataFrame:
    """One row per record of each JSON document in ``text``. A document is an
    array or wraps one as ``mentions``; other keys of the wrapper are ignored."""
    rest = [c for c in docs.columns if c != text]
    df = docs.withColumn("_doc", F.try_parse_json(F.col(text))).drop(text)
    df = df.withColumn("_wrapped", F.variant_get(F.col("_doc"), "$.mentions", "variant"))
    df = df.withColumn("_records", F.when(_is_array(F.col("_doc")), F.col("_doc")).when(_is_array(F.col("_wrapped")), F.col("_wrapped")))
    df = df.withColumn("malformed", F.when(F.col("_doc").isNull(), F.lit(NOT_JSON)).when(F.col("_records").isNull(), F.lit(NOT_A_BATCH)))
    df = df.select(*rest, "malformed", F.posexplode_outer(F.col("_records").try_cast("array<variant>")).alias("_pos", "raw"))
    df = df.where(F.col("_pos").isNotNull() | F.col("malformed").isNotNull())
    return df.withColumn("row", F.coalesce(F.col("_pos"), F.lit(0)).cast("bigint")).drop("_pos")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file documents. One document is parsed by one task, so large inputs
    should come as JSON lines or as many documents."""
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return explode_documents(docs).withColumn("block", F.lit(0).cast("bigint"))


def natural_order(name: str) -> Column:
    """A sort key for file names in which runs of digits count by value."""
    return F.expr(
        f"transform(transform(regexp_extract_all({name}, '[0-9]+|[^0-9]+', 0), "
        "t -> regexp_replace(t, '^0+(?=[0-9])', '')), t -> CASE WHEN t RLIKE '^[0-9]' THEN concat(lpad(CAST(length(t) AS STRING), 5, '0'), t) ELSE t END)"
    )


def _split_offsets(splits: DataFrame) -> DataFrame:
    """``file, block, _low, _before``: rows of all splits before each one, in input order.

    Two levels of running sums, so that no task sees all splits: the splits are cut into
    ranges of the input order, summed within each range by a window on the range, and the
    ranges' totals (one number each, ``ORDER_RANGES`` at most) are summed in order on the
    driver. The cut is written once, so totals and sums within ranges see the same ranges.
    """
    spark = splits.sparkSession
    ranged = splits.withColumns({"_name": natural_order("file"), "_count": F.col("_high") - F.col("_low") + 1})
    ranged = ranged.repartitionByRange(ORDER_RANGES, "_name", "file", "block").withColumn("_range", F.spark_partition_id())
    folder = f"{work_dir(spark)}/split-ranges-{uuid4().hex}"
    ranged.drop("_high").write.parquet(folder)
    ranged = spark.read.parquet(folder)
    totals = sorted((r["_range"], r["_total"]) for r in ranged.groupBy("_range").agg(F.sum("_count").alias("_total")).collect())
    starts, running = [], 0
    for number, total in totals:
        starts.append((number, running))
        running += total
    start_of = spark.createDataFrame(starts, "_range int, _start long")
    before = Window.partitionBy("_range").orderBy("_name", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.join(F.broadcast(start_of), "_range")
    return ranged.select("file", "block", "_low", (F.col("_start") + F.coalesce(F.sum("_count").over(before), F.lit(0))).alias("_before"))


def with_ordinal(stored: DataFrame) -> DataFrame:
    """Replaces ``file, block, row`` of a stored batch by its 0-based position.

    Files follow each other by name, numbers in a name by value (``part-99999`` before
    ``part-100000``). Only the narrow table of splits is ordered, range by range; the rows
    are not moved. Splits are joined by a 64-bit hash of file and block; if two share
    one, by file and block.
    """
    splits = stored.groupBy("file", "block").agg(F.min("row").alias("_low"), F.max("row").alias("_high"))
    offsets = _split_offsets(splits).withColumn("_split", F.xxhash64("file", "block"))
    number, distinct = offsets.agg(F.count("*"), F.countDistinct("_split")).first()
    if number == distinct:
        keys = ["_split"]
        stored = stored.withColumn("_split", F.xxhash64("file", "block"))
    else:
        keys = ["file", "block"]
    offsets = offsets.select(*keys, "_low", "_before")
    df = stored.join(F.broadcast(offsets) if number <= BROADCAST_SPLITS else offsets, keys)
    ordinal = F.col("row") - F.col("_low") + F.col("_before")
    return df.withColumn("ordinal", ordinal).drop("file", "block", "row", "_split", "_low", "_before")


# A quote that no backslash escapes, and strings that are complete or open at the end.
_QUOTE = r'(?<!\\)(?:\\\\)*"'
_STRING = r'(?s)"(?:[^"\\]++|\\.)*+"'
_OPEN_STRING = r'(?s)"(?:[^"\\]++|\\.)*+\z'


def _depth_change(piece: Column, inside: bool) -> Column:
    """Brackets opened minus closed outside strings, for a piece entered inside a string or not."""
    text = F.concat(F.lit('"'), piece) if inside else piece
    bare = F.regexp_replace(F.regexp_replace(text, _STRING, ""), _OPEN_STRING, "")
    return F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = f"{work_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _bare(path: str) -> str:
    """A file's path without the ways of writing a local one (``file:/``, ``file:///``)."""
    return re.sub(r"\Afile:/+", "/", path)


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array, read in parallel however large one file is.

    The text reader cuts each file at every comma, so a file of many splits is read by many
    tasks. Whether a cut lies inside a string depends only on the number of unescaped quotes
    before it, and its depth on the brackets outside strings; both come from running sums over
    the pieces, taken range by range (as in ``with_ordinal``), so no task holds a whole file.
    A cut at depth 1 outside strings separates two records; the pieces of one record are joined
    again. Files that are no well-formed array of parseable records (an object with
    ``mentions``, a cut-off text, a record Spark cannot parse) are read whole by
    ``read_json_documents``, so the result equals that of ``read_json_documents`` row for row:
    ``file, malformed, raw, row, block``. Very long strings with many escapes cost regex stack.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value"),
    )
    pieces = with_ordinal(_written(pieces.withColumn("_file", F.col("file")), "array-pieces")).withColumnRenamed("_file", "file")
    pieces = pieces.withColumns({
        "_q": F.regexp_count("value", F.lit(_QUOTE)) % 2, "_d0": _depth_change(F.col("value"), False), "_d1": _depth_change(F.col("value"), True),
    })
    count = pieces.count()
    size = max(1, -(-count // ORDER_RANGES))
    pieces = pieces.withColumn("_range", F.floor(F.col("ordinal") / size))
    before = Window.partitionBy("file", "_range").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_lx", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2)
    pieces = pieces.withColumns({
        "_e0": F.when(F.col("_lx") == 0, F.col("_d0")).otherwise(F.col("_d1")),
        "_e1": F.when(F.col("_lx") == 0, F.col("_d1")).otherwise(F.col("_d0")),
    })
    pieces = pieces.withColumns({"_p0": F.coalesce(F.sum("_e0").over(before), F.lit(0)), "_p1": F.coalesce(F.sum("_e1").over(before), F.lit(0))})
    pieces = _written(pieces.drop("_d0", "_d1"), "array-sums")
    # Entry state of each range, composed in order per file on the driver: one row a range.
    ranges = pieces.groupBy("file", "_range").agg(
        (F.sum("_q") % 2).alias("x"), F.sum("_e0").alias("d0"), F.sum("_e1").alias("d1"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"),
    ).collect()
    entries, last_of = [], {}
    for r in sorted(ranges, key=lambda r: r["first"]):
        if r["file"] not in last_of:
            state = (0, 0)
        entries.append((r["file"], r["_range"], state[0], state[1]))
        state = (state[0] ^ r["x"], state[1] + (r["d0"] if state[0] == 0 else r["d1"]))
        last_of[r["file"]] = (r["last"], state)
    entry = spark.createDataFrame(entries, "file string, _range long, _P int, _D long")
    pieces = pieces.join(F.broadcast(entry) if len(entries) <= BROADCAST_SPLITS else entry, ["file", "_range"])
    first_of = {}
    for r in ranges:
        first_of[r["file"]] = min(first_of.get(r["file"], r["first"]), r["first"])
    ends = spark.createDataFrame([(f, first_of[f], last) for f, (last, _) in last_of.items()], "file string, _first_piece long, _last long")
    pieces = pieces.join(F.broadcast(ends) if len(last_of) <= BROADCAST_SPLITS else ends, "file")
    inside = F.col("_P").bitwiseXOR(F.col("_lx"))
    depth = F.col("_D") + F.when(F.col("_P") == 0, F.col("_p0")).otherwise(F.col("_p1"))
    pieces = pieces.withColumns({"_first": F.col("ordinal") == F.col("_first_piece"), "_start": (depth == 1) & (inside == 0)})
    pieces = pieces.withColumn("_open", ~F.col("_first") | F.col("value").rlike(r"\A\s*\["))
    pieces = pieces.withColumn("value", F.when(F.col("_first"), F.regexp_replace("value", r"\A\s*\[", "")).otherwise(F.col("value")))
    pieces = pieces.withColumn("value", F.when(F.col("ordinal") == F.col("_last"), F.regexp_replace("value", r"\]\s*\z", "")).otherwise(F.col("value")))
    pieces = _written(pieces.select("file", "ordinal", "_range", "value", "_open", (F.col("_first") | F.col("_start")).alias("_start")), "array-starts")
    # The record of a piece is the last start at or before it: within its range, or the last of earlier ranges.
    last_start = pieces.where("_start").groupBy("file", "_range").agg(F.max("ordinal").alias("s")).collect()
    carried, by_file = [], {}
    for r in sorted(last_start, key=lambda r: r["s"]):
        by_file.setdefault(r["file"], []).append((r["_range"], r["s"]))
    for r in sorted(ranges, key=lambda r: r["first"]):
        earlier = [s for rng, s in by_file.get(r["file"], []) if rng < r["_range"]]
        carried.append((r["file"], r["_range"], max(earlier) if earlier else None))
    carry = spark.createDataFrame(carried, "file string, _range long, _carry long")
    within = Window.partitionBy("file", "_range").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.join(F.broadcast(carry) if len(carried) <= BROADCAST_SPLITS else carry, ["file", "_range"])
    pieces = pieces.withColumn("_record", F.coalesce(F.max(F.when(F.col("_start"), F.col("ordinal"))).over(within), F.col("_carry")))
    records = pieces.groupBy("file", "_record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda p: p["value"]), ",").alias("text"), F.min("_open").alias("_open"))
    records = records.withColumns({"raw": F.try_parse_json("text"), "_blank": F.col("text").rlike(r"\A\s*\z")})
    records = records.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("_record")) - 1)
    shape = records.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("raw").isNull().cast("int")).alias("bad"), F.sum(F.col("_blank").cast("int")).alias("blank"), F.min("_open").alias("open"))
    final = spark.createDataFrame([(f, d == 0 and x == 0) for f, (_, (x, d)) in last_of.items()], "file string, closed boolean")
    good = shape.join(F.broadcast(final) if len(last_of) <= BROADCAST_SPLITS else final, "file").where(
        F.col("closed") & F.col("open") & ((F.col("bad") == 0) | ((F.col("n") == 1) & (F.col("blank") == 1)))
    )
    rows = records.join(good.select("file", "n", "blank"), "file").where(~((F.col("n") == 1) & (F.col("blank") == 1)))
    rows = rows.select("file", F.lit(None).cast("string").alias("malformed"), "raw", F.col("row").cast("bigint"), F.lit(0).cast("bigint").alias("block"))
    # Files of no piece at all (empty ones) and those that are no clean array are read whole.
    unread = [f for f in spark.read.text(path).inputFiles() if _bare(f) not in {_bare(g) for g in last_of}]
    others = sorted({r["file"] for r in shape.join(good, "file", "left_anti").select("file").collect()} | set(unread))
    if not others:
        return rows
    return rows.unionByName(read_json_documents(spark, others).select("file", "malformed", "raw", "row", "block"))
