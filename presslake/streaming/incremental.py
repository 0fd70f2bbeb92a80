"""Repeated bulk calls as a stream of files.

Each micro-batch is one ingest. Its batch id is made of the query's own id, which
Spark keeps in the checkpoint, and the number of the micro-batch: a replayed
micro-batch is recognised, and two streams or two checkpoints never share an id.
The horizon of de-duplication is the whole table, which is why this is an anti-join
per batch and not a watermark.
"""

from __future__ import annotations

import threading
from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from presslake.plans.ingest import ingest
from presslake.sources.batches import parse_lines


def ingest_stream(
    spark: SparkSession, lines_dir: str, table: str, checkpoint: str, prefix: str = "s",
    files_per_batch: int | None = None, created_at: Callable[[int], datetime] | None = None, bad_lines: str = "refuse",
) -> StreamingQuery:
    """Starts a query that ingests all JSON-lines files present and then ends."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(lines_dir).select("value", "_metadata")
    known, started = {}, threading.Event()

    def store(batch: DataFrame, number: int) -> None:
        started.wait()
        batch_id = f"{prefix}{known['id']}-{number}"
        ingest(batch.sparkSession, parse_lines(batch), table, batch_id, created_at(number) if created_at else None, bad_lines)

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    known["id"] = query.id.replace("-", "")
    started.set()
    return query
