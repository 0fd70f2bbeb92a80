"""Positions of rows inside their groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.staging import small_side, written


def positions(df: DataFrame, group: str, order: list[Column], name: str = "pos", label: str = "positions") -> DataFrame:
    """``df`` with ``name``: the 0-based place of each row in its group (null is a group of its own)
    when the group is ordered by ``order``.

    All rows are sorted once by range partitioning, so a group that holds a third of all rows
    is spread over many tasks, and written with their partition and local row number: that cuts
    the lineage and keeps the order fixed if executors are lost. A place is then the number of the
    group's rows in earlier partitions plus the offset inside the partition. Only the table of
    (group, partition) counts is aggregated and summed by a window; it is broadcast if counted small.
    Rows that tie on group and order get consecutive places in an unspecified order.
    """
    ordered = df.sort(F.col(group).asc_nulls_first(), *order)
    tagged = written(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), label)
    counts = tagged.groupBy(F.col(group).alias("_g"), "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_g", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = tagged.join(small_side(counts), tagged[group].eqNullSafe(counts["_g"]) & (tagged["_part"] == counts["_part"]))
    place = (F.col("_before") + F.col("_row") - F.col("_first")).alias(name)
    return joined.select(*[tagged[c] for c in df.columns], place)
