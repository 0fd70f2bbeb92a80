"""Session settings the results depend on, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, not speed.
SEMANTIC_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# For sessions we start ourselves: call-site capture costs several round trips per
# column function, which adds up in plans of this width. It changes no result.
DRIVER_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Spark removes the shuffle files of a query when the driver happens to collect garbage, or under
# this setting when the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Staged tables and the stored table: text takes two thirds of what the default leaves.
COMPRESSION = "zstd"

_local_work_dirs: dict[str, str] = {}
_freeing: dict[int, list] = {}
_freeing_lock = threading.Lock()


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in SEMANTIC_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(name: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above and those given as ``**{name: value}``."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_SETTINGS, **DRIVER_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files. For writes only: a frame that is run
    again would have to shuffle again. Threads may be inside at once; the last restores."""
    key, conf = spark._jsparkSession.hashCode(), spark.conf
    with _freeing_lock:
        held = _freeing.setdefault(key, [0, conf.get(FREE_SHUFFLES)])
        held[0] += 1
        conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _freeing_lock:
            held[0] -= 1
            if not held[0]:
                conf.set(FREE_SHUFFLES, _freeing.pop(key)[1])


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a staged or stored table and frees the shuffle files this took."""
    with shuffles_freed(df.sparkSession):
        df.write.mode(mode).option("compression", COMPRESSION).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Spark's own figures of what ``df`` reads, summed: for files, their size. Not that of the
    whole plan, which counts a variant made on the way with 2 KB a row."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def work_dir(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    It lies under ``spark.checkpoint.dir``, which every executor can read. Only
    a local session may fall back to a temporary folder of its own.
    """
    app_id = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return os.path.join(shared, f"presslake-{app_id}")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app_id not in _local_work_dirs:
        _local_work_dirs[app_id] = tempfile.mkdtemp(prefix="presslake-")
    return _local_work_dirs[app_id]
