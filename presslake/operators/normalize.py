"""One narrow pass from raw records to normalized mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presslake.functions.counts import with_count
from presslake.functions.dates import with_published_at
from presslake.functions.fingerprints import with_fingerprint
from presslake.functions.names import with_source
from presslake.functions.text import with_clean_text
from presslake.functions.urls import with_canonical_url
from presslake.operators.coercion import reject_reason, with_inputs
from presslake.schema import NORMALIZED_COLUMNS
from presslake.session import plan_bytes


# Normalizing costs seconds a MB of stored markup, so a task is given this much of the input (as
# text, or compressed as staged tables are) and the number of tasks grows with it. Beyond
# ``KNOWN_BYTES`` Spark's figure is no size but "unknown".
TASK_BYTES = 5 << 20
KNOWN_BYTES = 1 << 50
# A staged table is handled in up to this many slices where that saves disk, each of a task a core
# at least. Each costs the driver a plan, of which that of normalization takes seconds.
SLICES = 6


def spread(raw: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows dealt evenly over tasks of about ``task_bytes`` of input each, by their row key.

    As they lie, records that cost much (pages) share files and so tasks: the longest task
    grows with the input up to a whole split of them, while others are idle.
    """
    size = plan_bytes(raw)
    if size > KNOWN_BYTES:
        return raw
    key = [c for c in ("file", "block", "row") if c in raw.columns] or ["ordinal"]
    return raw.repartition(max(raw.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes)), *key)


def slices(raw: DataFrame, task_bytes: int = TASK_BYTES) -> list[DataFrame]:
    """``raw`` as tables of about equal stored size if it is simply a read of Parquet files, else ``raw``.

    What a step takes of disk until it is done is, slice by slice, a fraction. Each file is read
    for one slice only.
    """
    plan, spark = raw._jdf.queryExecution().analyzed(), raw.sparkSession
    if plan.getClass().getSimpleName() != "LogicalRelation" or not raw.inputFiles():
        return [raw]
    relation = plan.relation()
    if relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat" or relation.partitionSchema().length():
        return [raw]
    found = relation.location().allFiles()
    files = sorted(((f.getLen(), f.getPath().toString()) for f in map(found.apply, range(found.size()))), reverse=True)
    least = spark.sparkContext.defaultParallelism * task_bytes
    number = min(SLICES, len(files), max(1, -(-sum(size for size, _ in files) // least)))
    if number == 1:
        return [raw]
    return [spark.read.schema(raw.schema).parquet(*[path for _, path in files[i::number]]) for i in range(number)]


def normalize(raw: DataFrame, version: str | None = None) -> DataFrame:
    """``(…, raw VARIANT)`` to the same rows with ``reason`` (null when accepted)
    and the mention fields. No shuffle, no Python worker; other columns of the
    input are carried along.

    A published number in text form is a date text, not an epoch number, so the
    text parser sees it only when the value was not a JSON number. ``version`` is
    that of the fingerprints.
    """
    carried = [c for c in raw.columns if c not in NORMALIZED_COLUMNS]
    df = with_inputs(raw)
    df = with_source(df, "in_source")
    df = with_clean_text(df, {"title": "in_title", "content": "in_content", "author": "in_author"})
    df = with_canonical_url(df, "in_url")
    df = df.withColumns({
        "_date_text": F.when(F.col("in_published_number").isNull(), F.col("in_published")),
        "_count_text": F.when(F.col("in_engagement_number").isNull(), F.col("in_engagement")),
    })
    df = with_published_at(df, "_date_text", "in_published_number")
    df = with_count(df, "_count_text", "in_engagement_number")
    df = df.withColumns({
        "published_at_raw": F.when(F.col("published_at").isNull(), F.col("in_published")),
        "reason": reject_reason(),
    })
    df = with_fingerprint(df, version)
    accepted = F.col("reason").isNull()
    return df.withColumns({
        "fingerprint": F.when(accepted, F.col("fingerprint")),
        "fingerprint_strategy": F.when(accepted, F.col("fingerprint_strategy")),
    }).select(*carried, *[c for c in NORMALIZED_COLUMNS if c in df.columns])


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNull())


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNotNull()).select("ordinal", "reason", "raw")
