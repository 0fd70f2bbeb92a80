"""Identity of a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Version tag, separator and prefix length of the hashed text.
VERSION = "v1"
SEPARATOR = "\x1f"
CONTENT_UNITS = 500
# Only so many units of the content's comparison form are hashed, so the form of this many first
# characters is tried before that of the whole content.
CONTENT_HEAD = 2000


def schemeless(url: Column) -> Column:
    return F.regexp_replace(url, r"\Ahttps?://", "")


def comparison_form(c: Column) -> Column:
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(words)


def content_prefix(form: Column) -> Column:
    """First 500 UTF-16 units. Code points and units agree unless the text has
    astral letters; if the cut splits one, its half reads as U+FFFD."""
    short = F.substring(form, 1, CONTENT_UNITS)
    units = F.substring(F.encode(form, "UTF-16BE"), 1, 2 * CONTENT_UNITS)
    last = F.hex(F.substring(units, 2 * CONTENT_UNITS - 1, 2))
    split_pair = last.rlike(r"\AD[89AB]")
    exact = F.when(
        split_pair,
        F.concat(F.decode(F.substring(units, 1, 2 * CONTENT_UNITS - 2), "UTF-16BE"), F.lit("�")),
    ).otherwise(F.decode(units, "UTF-16BE"))
    return F.when(short.rlike(r"[\x{10000}-\x{10ffff}]"), exact).otherwise(short)


def identity_text(
    source: Column, url: Column, title_form: Column, content_form: Column, version: str = VERSION
) -> Column:
    by_url = F.concat_ws(SEPARATOR, F.lit(version), F.lit("url"), schemeless(url))
    by_content = F.concat_ws(
        SEPARATOR, F.lit(version), F.lit("content"), source, title_form, content_prefix(content_form)
    )
    return F.when(url.isNotNull(), by_url).otherwise(by_content)


def with_fingerprint(df: DataFrame, version: str | None = None) -> DataFrame:
    """Adds ``fingerprint`` and ``fingerprint_strategy`` from source, url, title
    and content. The version is part of the hashed text. Comparison forms are built only where the link is missing."""
    no_url = F.col("url").isNull()
    head = F.substring("content", 1, CONTENT_HEAD)
    # How a capital sigma is lowered depends on what follows, so a head with one does not stand for its text.
    df = df.withColumns({
        "_title_form": F.when(no_url, comparison_form(F.col("title"))),
        "_head_form": F.when(no_url & ~F.coalesce(head.contains("\u03a3"), F.lit(False)), comparison_form(head)),
    })
    long_enough = F.length("_head_form") > CONTENT_UNITS + 1
    df = df.withColumn("_content_form", F.when(long_enough, F.col("_head_form")).when(no_url, comparison_form(F.col("content"))))
    text = identity_text(F.col("source"), F.col("url"), F.col("_title_form"), F.col("_content_form"), version or VERSION)
    return df.withColumns({
        "fingerprint": F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)),
        "fingerprint_strategy": F.when(no_url, F.lit("content")).otherwise(F.lit("url")),
    }).drop("_title_form", "_head_form", "_content_form")
