"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is a bit of ``failures`` and the
measurements stay beside it. A policy is a versioned mask of rules: applying it, comparing
versions and leaving rules out are bit operations on the ledger, without the texts.
Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rules in bit order: name, and when a document fails it (integers only, so that SQL agrees).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("very_many_words", "n_words > 1000000"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask("few_words", "repeated_words")
#: Policies by version; a new version is added, an old one never changed.
POLICIES = {
    1: BASE,
    2: mask("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
    # Repeated lines alone turned out to mark documents labelled as good, and no others.
    3: mask("few_words", "repeated_words", "symbols", "short_words", "long_words"),
}
CURRENT = 3


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``MEASURES``; null and empty texts have zeros.

    Two word windows count as equal if their 64-bit hashes agree. All work is within a row,
    so nothing is shuffled and no group is built.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_text", t)
    df = df.withColumn("_words", F.array_remove(F.split("_text", f"{SPACE}+"), "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    )
    df = df.withColumn(
        "_windows",
        F.expr(
            f"IF(size(_words) < {WINDOW}, array(CAST(NULL AS BIGINT)), transform(sequence(0, size(_words) - {WINDOW}), "
            f"i -> xxhash64({', '.join(f'_words[i + {k}]' for k in range(WINDOW))})))"
        ),
    )
    df = df.withColumn(
        "_sorted",
        F.expr(
            "IF(size(array_distinct(_windows)) < size(_windows), "
            "sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))), NULL)"
        ),
    )
    df = df.withColumn(
        "_starts",
        F.expr(
            "sort_array(filter(transform(_sorted, (e, k) -> IF(get(_sorted, k - 1).h = e.h OR get(_sorted, k + 1).h = e.h, e.i, NULL)), "
            "i -> i IS NOT NULL))"
        ),
    )
    repeated = F.expr(
        f"aggregate(transform(_starts, (s, k) -> least({WINDOW}, coalesce(get(_starts, k + 1), s + {WINDOW}) - s)), 0L, (a, x) -> a + x)"
    )
    return (
        df.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
        .drop("_text", "_words", "_lines", "_windows", "_sorted", "_starts")
    )


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the measurements and ``failures``: bit i is set if rule i fails.

    Rows are independent: repeated rows and null keys stay rows of their own, columns other
    than ``key`` and ``text`` are ignored, an empty table gives no rows.
    """
    clean = docs.select(F.col(key), F.col(text).alias("_input"))
    bits: Column = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0))
    return measured(clean, "_input").drop("_input").withColumn("failures", bits)


def rejected_by(policy: int) -> Column:
    """Whether a ledger row fails any rule of a policy mask."""
    return F.col("failures").bitwiseAND(F.lit(policy).cast("long")) != 0


def judged(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` under a policy version, and the version."""
    return (
        book.withColumn("base_failed", rejected_by(BASE))
        .withColumn("kept", ~rejected_by(BASE | POLICIES[version]))
        .withColumn("policy_version", F.lit(version))
    )


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and kept without it.

    One scan of the ledger and one row per combination of bits (at most 2 to the number of
    rules) before the shuffle.
    """
    policy = POLICIES[version]
    combos = book.groupBy(F.col("failures").bitwiseAND(F.lit(policy).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(name, BIT[name]) for name, _ in RULES if BIT[name] & policy]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return (
        combos.select("bits", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(hit & (others == 0), F.col("n"))), F.lit(0)).alias("only_this"),
            F.coalesce(F.sum(F.when(others == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
    )
