"""The training-corpus pipeline: filters, mixes and encodes ``documents`` in written stages.

Every stage keeps the columns of ``documents`` but the last, whose rows are read back from the
packed files. Null texts count as empty; extra columns are dropped; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.contamination import without_items
from presslake.llm.mixing import mixed
from presslake.llm.packed_ids import packed_documents
from presslake.llm.simhash_links import near_duplicates
from presslake.llm.staging import forget, written
from presslake.llm.toxicity import with_score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5

#: Tables a stage wrote for its own use. Once a stage's output is written and read again, no
#: later stage reads them.
_scratch: list[DataFrame] = []


def _release(docs: DataFrame | None = None) -> None:
    """Deletes the scratch tables of earlier stages that ``docs`` does not read, so that they do
    not pile up in the shared folder over the whole run. A stage handed unwritten output of an
    earlier one keeps the tables it reads."""
    needed = set(docs.inputFiles()) if docs is not None else set()
    for table in list(_scratch):
        if needed.isdisjoint(table.inputFiles()):
            _scratch.remove(table)
            forget(table)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more."""
    _release(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_score(docs.select(COLUMNS), labels, "toxicity").where(F.col("toxicity") < TOXIC).select(COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``_row``, an id of each row, fixed by writing them once; the table is
    deleted when the next stage starts."""
    rows = written(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    _scratch.append(rows)
    return rows


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component: that of the smallest doc_id (null last;
    equal ids: the first row). Components are found over rows, not ids, so rows that share an id
    but not a text are apart, rows without an id are grouped like any other, and rows repeated
    whole become one.
    """
    _release(docs)
    rows = _numbered(docs)
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    grouped = rows.join(groups.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))).alias("first")
    kept = grouped.groupBy("component_id").agg(first).select(F.col("first._row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    _release(docs)
    return without_items(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each row as often as the mix takes it; those not taken go. The mix sees each row
    under its own ``_row`` id, so its decisions go back to that very row."""
    _release(docs)
    rows = _numbered(docs)
    taken = mixed(rows.select(F.col("_row").alias("doc_id"), "text", "lang", "source", "n_chars"))
    taken = taken.where("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    each = rows.join(taken, "_row")
    return each.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, read back from the files."""
    _release(docs)
    return packed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("source_mixing", to_target_weights),
    ("token_ids", token_ids),
]

#: Classifier, components, knapsack and tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    _release(docs)
    return docs
