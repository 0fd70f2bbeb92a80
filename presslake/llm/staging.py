"""Written intermediate tables, files in the shared folder, and size-bounded Arrow batches."""

from __future__ import annotations

import io
import math
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import presslake
from presslake.session import work_dir

#: Rows that may be broadcast; every broadcast here is counted against it first.
BROADCAST_ROWS = 200_000
#: Bytes of one Arrow batch handed to Python.
BATCH_BYTES = 8 << 20


_shipped: set[str] = set()


def ready_for_python(spark: SparkSession) -> None:
    """Call before work in Python: limits Arrow batches by bytes, so that long texts do not pile
    up in a worker, and sends this package to the executors, once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    packed, root = io.BytesIO(), Path(presslake.__file__).parent
    with zipfile.ZipFile(packed, "w") as code:
        for file in sorted(root.rglob("*.py")):
            code.write(file, str(file.relative_to(root.parent)))
    folder = new_folder(spark, "code")
    files, place = open_folder(folder)
    files.create_dir(place, recursive=True)
    with files.open_output_stream(f"{place}/presslake.zip") as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{folder}/presslake.zip")
    _shipped.add(context.applicationId)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: cuts the lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it was counted to be small, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if urlparse(uri).scheme:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def publish(files: fs.FileSystem, temporary: str, final: str) -> None:
    """Gives a finished file its name. Contents are determined by the input, so a file that a
    lost or speculative attempt has already put there is as good as this one."""
    if files.get_file_info(final).type == fs.FileType.File:
        files.delete_file(temporary)
    else:
        files.move(temporary, final)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def shards_for(total_bytes: int, shard_bytes: int, most: int = 20_000) -> int:
    """Number of shards: of ``shard_bytes`` each, larger ones beyond ``most``."""
    return max(1, min(most, math.ceil(total_bytes / shard_bytes)))


def range_bounds(df: DataFrame, key: str, shards: int) -> list:
    """Upper bounds that cut the keys into ``shards`` ranges of about equal row number.

    The bounds are quantiles of a sample chosen by the hash of the key, of about 100 keys a
    shard, so they are the same in every run and do not depend on how the input is dealt.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    every = max(1, keys.count() // (100 * shards))
    sample = [r[0] for r in keys.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).distinct().sort(key).collect()]
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []


def range_shard(key: str, bounds: list) -> Column:
    """Number of bounds at or below the key; 0 for null."""
    edges = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def shard(values: pa.Array) -> pa.Array:
        keys = values.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, keys, side="right").astype(np.int32))

    return shard(F.col(key).cast("long"))
