"""J1/J2 against a stored fingerprint index bucketed by fingerprint: only the batch moves."""

import uuid

from pyspark.sql import functions as F

from presslake.operators import dedup


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_join_shuffles_only_the_batch(spark):
    stored = spark.range(0, 20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"),
                                           F.when(F.col("id") % 7 == 0, None).otherwise(F.current_timestamp()).alias("published_at"),
                                           F.lit("wide").alias("content"))
    batch = spark.range(15_000, 30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.col("id").alias("ordinal"))
    index = dedup.write_fingerprint_index(stored, f"fingerprints_{uuid.uuid4().hex}")
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dated = index.where(F.col("published_at").isNotNull())
        missing = dedup.not_stored(batch, dated)
        found = dedup.already_stored(batch, dated)
        for df in (missing, found):
            plan = _plan(df)
            assert plan.count("Exchange") == 1, plan  # the batch only
            assert "SortMergeJoin" in plan
        plain_dated = stored.where(F.col("published_at").isNotNull())
        assert sorted(missing.select("ordinal").collect()) == sorted(batch.join(plain_dated, "fingerprint", "left_anti").select("ordinal").collect())
        assert found.count() == batch.join(plain_dated, "fingerprint", "left_semi").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)


def test_index_appends_and_empty(spark):
    name = f"fingerprints_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([("a", None), (None, None), ("b", None)], "fingerprint string, published_at timestamp")
    dedup.write_fingerprint_index(rows, name)
    index = dedup.write_fingerprint_index(rows.limit(0), name)
    assert sorted(r[0] for r in index.collect()) == ["a", "b"]  # null fingerprints are never stored
    dedup.write_fingerprint_index(rows, name)
    assert spark.table(name).count() == 4
