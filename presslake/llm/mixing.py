"""Mixing sources to target weights by fitting exact length counts to each source's budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.staging import forget, ready_for_python, small_side, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
#: Words that the knapsack fits; what lies above is spread evenly over all lengths.
FITTED = 1 << 16
#: Documents of one source and length that are ranked together.
RANKED = 1 << 16
KEY = ["no_source", "source"]


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come closest to ``budget`` from below.

    All but about ``FITTED`` words are spread evenly over the lengths; a bounded knapsack over all
    lengths and documents that are left then fits the rest, which is at most ``2 * FITTED``. For
    each sum it holds the step that first reached it, so memory does not grow with the lengths.
    """
    order = np.argsort(-lengths, kind="stable")
    size, left = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * left).sum())
    spread = max(0, min(budget, total) - FITTED)
    upto = np.floor(np.cumsum(left) * (spread / max(total, 1)) + 0.5).astype(np.int64)
    taken = np.diff(upto, prepend=0)
    rest = budget - int((size * taken).sum())
    for i in np.flatnonzero(taken):  # only where one document is longer than the fitted part
        if rest >= 0:
            break
        back = min(int(taken[i]), -(rest // int(size[i])))
        taken[i] -= back
        rest += back * int(size[i])
    left = left - taken
    for i in np.flatnonzero(left):
        if rest <= 2 * FITTED:
            break
        more = min(int(left[i]), (rest - FITTED) // int(size[i]))
        taken[i], left[i], rest = taken[i] + more, left[i] - more, rest - more * int(size[i])
    usable = np.flatnonzero((left > 0) & (size <= rest))
    if rest > 2 * FITTED:  # what is left is longer than rest - FITTED, so one document fits at most
        taken[usable[:1]] += 1
        usable = usable[:0]
        rest = 0
    reached, step_of, steps = np.zeros(rest + 1, bool), np.zeros(rest + 1, np.int64), []
    reached[0] = True
    for i in usable.tolist():
        many, piece = min(int(left[i]), rest // int(size[i])), 1
        while many > 0 and not reached[rest]:
            piece_count = min(piece, many)
            words = piece_count * int(size[i])
            new = words + np.flatnonzero(reached[: rest + 1 - words] & ~reached[words:])
            step_of[new] = len(steps)
            reached[new] = True
            steps.append((i, piece_count, words))
            many, piece = many - piece_count, piece * 2
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:  # the sum before a step was reached by an earlier one
        i, n, words = steps[step_of[at]]
        taken[i] += n
        at -= words
    out = np.zeros(len(lengths), np.int64)
    out[order] = taken
    return out


def _with_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the weights in turn over the sources in code point order, null last.

    The position is counted within ranges and over the few ranges, so no task sees all sources.
    """
    ranged = sources.repartitionByRange(F.col("no_source"), F.col("source"))
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "mix-sources")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*KEY))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = ranged.withColumn("row", within).join(small_side(parts), "part")
    turn = F.pmod(F.col("first") + F.col("row") - 1, F.lit(len(weights))).cast("int") + 1
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).drop("part", "row", "first")


def _with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target``: a common level times the weight, at most ``most`` times the source's size."""
    totals = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, level = share * (totals[0] or 0), 0.0
    free, full = totals[1] or 0.0, 0.0
    while free > 0:
        following = (wanted - full) / free
        if following <= level:
            break
        level = following
        above = F.col("weight") * level >= most * F.col("source_size")
        full, free = sources.agg(
            F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))
        ).first()
        if free == 0:
            level = float("inf")
    reached = most * F.col("source_size").cast("double")
    return sources.withColumn("target", reached if level == float("inf") else F.least(reached, F.col("weight") * F.lit(level)))


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42
) -> DataFrame:
    """Per row: ``doc_id``, ``size`` (words), ``source_size``, ``target`` of its source, words ``taken``, ``copies``, and ``text_hash``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times
    all words; what exceeds ``most`` times a source's words goes to the others by weight. A
    source takes all its documents as often as fits whole, and then, once more, documents whose
    lengths add up to the rest: how many of each length comes from the histogram of lengths,
    which of them from the order of a seeded hash of id and text. No document exceeds ``most`` times
    its size. Null texts have size 0; null ids are hashed as null; repeated rows count as rows;
    an empty table gives no rows; other columns are ignored.
    """
    ready_for_python(docs.sparkSession)
    sizes = written(
        docs.select(
            F.col("doc_id"), F.col("source").isNull().alias("no_source"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
        ),
        "mix-sizes",
    )
    histogram = written(sizes.groupBy(*KEY, "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = histogram.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = written(_with_targets(_with_weights(sources, weights), share, most), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("rounds", whole).withColumn(
        "budget", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long")
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        picked = fit_counts(group["size"].to_numpy(), group["n"].to_numpy(), int(group["budget"].iloc[0]))
        return group[[*KEY, "size", "n"]].assign(k=picked)

    open_budget = sources.where("budget > 0").select(*KEY, "budget")
    fitted = (
        histogram.where("size > 0").join(small_side(open_budget), KEY)
        .groupBy(*KEY).applyInPandas(fit, "no_source boolean, source string, size long, n long, k long")
    )
    plan = histogram.join(fitted.select(*KEY, "size", "k"), [*KEY, "size"], "left").join(
        small_side(sources.select(*KEY, "source_size", "target", "rounds")), KEY
    )
    plan = written(plan.withColumn("k", F.coalesce("k", F.lit(0))), "mix-plan")
    planned = sizes.join(small_side(plan), [*KEY, "size"])
    partly = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    sure = planned.where(~partly).withColumn("extra", (F.col("k") > 0).cast("long"))
    cell = [*KEY, "size"]
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    split = planned.where(partly).withColumn("h", hashed).withColumn(
        "bucket", F.pmod(F.col("h"), F.ceil(F.col("n") / RANKED).cast("long"))
    )
    earlier = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = split.groupBy(*cell, "bucket").agg(F.count("*").alias("m")).select(
        *cell, "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("first")
    )
    ranked = split.join(small_side(buckets), [*cell, "bucket"]).withColumn(
        "row", F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("h", "doc_id", "text_hash")) + F.col("first")
    )
    chosen = ranked.withColumn("extra", (F.col("row") <= F.col("k")).cast("long")).select(sure.columns)
    result = sure.unionByName(chosen)
    forget(histogram, sources)
    copies = F.col("rounds") + F.col("extra")
    return result.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "text_hash")
