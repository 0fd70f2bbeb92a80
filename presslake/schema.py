"""Column lists and schemas of the raw, normalized and stored frames."""

from __future__ import annotations

from pyspark.sql import types as T

# The field aliases of a raw record, in order of preference.
TEXT_ALIASES = {
    "source": ["source", "source_name", "sourceName", "publisher"],
    "title": ["title", "headline"],
    "content": ["content", "body", "text", "description"],
    "url": ["url", "link", "permalink"],
    "author": ["author", "author_name"],
}
DATE_ALIASES = ["published_at", "publishedAt", "published_date", "date", "created_at"]
COUNT_ALIASES = ["engagement", "engagement_count", "reach", "views"]

# The order in which fields are checked for a wrong type.
CHECKED_FIELDS = (
    TEXT_ALIASES["source"]
    + TEXT_ALIASES["title"]
    + TEXT_ALIASES["content"]
    + TEXT_ALIASES["url"]
    + DATE_ALIASES
    + TEXT_ALIASES["author"]
    + COUNT_ALIASES
)

# The columns a reader of the table sees.
LISTING_COLUMNS = [
    "id", "source", "source_raw", "title", "content", "url",
    "published_at", "author", "engagement", "created_at",
]

MENTION_FIELDS = [
    T.StructField("fingerprint", T.BinaryType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_raw", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("url_raw", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("published_at_raw", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("engagement", T.IntegerType()),
    T.StructField("raw", T.VariantType()),
]
MENTION_COLUMNS = [f.name for f in MENTION_FIELDS]

NORMALIZED_COLUMNS = ["ordinal", "reason", "fingerprint_strategy"] + MENTION_COLUMNS

STORED_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("ordinal", T.LongType())]
    + MENTION_FIELDS
    + [T.StructField("created_at", T.TimestampType()), T.StructField("batch_id", T.StringType())]
)

# A batch as the log shows it to readers.
COMMITTED_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("max_id", T.LongType()),
    T.StructField("received", T.LongType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("rejected", T.LongType()),
    T.StructField("inserted", T.LongType()),
    T.StructField("duplicates", T.LongType()),
    T.StructField("duplicate_breakdown", T.StructType([
        T.StructField("within_batch", T.LongType()),
        T.StructField("already_stored", T.LongType()),
    ])),
    T.StructField("errors", T.ArrayType(T.StructType([
        T.StructField("index", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]))),
])

# Entries of the log: a batch, or a compaction of all before it. ``part`` and
# ``rejects`` name the folders that hold the rows, ``input`` tells inputs apart.
LOG_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("rejects", T.StringType()), T.StructField("input", T.StringType()),
] + [T.StructField("created_at", T.StringType()) if f.name == "created_at" else f for f in COMMITTED_SCHEMA.fields])
