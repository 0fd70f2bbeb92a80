"""Which windows of a corpus occur more than once: routing to shards that hold what may be equal.

A window is a number of consecutive units (words or bytes) of one document. Of the grams in a
window, the one with the smallest hash is its anchor; neighbouring windows with the same anchor
form a run, and the text of a run is a segment. Equal windows have equal anchors, so all that
can be equal to a window lies in segments of its own anchor: segments are dealt to shards by
anchor, and each shard is searched alone by a method given from outside. Every window of the
corpus is in exactly one segment.

* Runs whose anchor occurs once in the corpus cannot repeat and go no further.
* Equal segments are one segment with a weight; only one of them is read again.
* An anchor with very many different segments is dealt by window instead, so no shard grows
  with a frequent passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.staging import binary, ready_for_python, forget, written
from presslake.llm.words import BYTES, WORDS, mixed, prefix_sums, range_hashes, sliding_minimum, uneven_gaps, word_bounds, word_hashes

#: From segments, their weights and the window: per segment, a flag for each of its windows
#: that occurs at least twice, weights counted.
Finder = Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]

KEY = ["d", "th", "tl"]
#: Bytes of texts whose runs are found at once.
CUT_BYTES = 1 << 17
RUN = "d long, th long, tl long, start long, n long, anchor long, hash long, hash2 long, twice boolean"
#: A segment is known by its anchor and a 128-bit BLAKE2b digest of its bytes in the text (two longs).
SEGMENT = ["anchor", "hash", "hash2"]


@dataclass(frozen=True)
class Units:
    """How a text is cut. ``gram`` units make an anchor; windows have ``window`` units."""

    words: bool
    window: int
    gram: int

    def bounds(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            return word_bounds(text)
        at = np.arange(len(text))
        return at, at + 1

    def sums(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, object]:
        """Prefix sums over the units, for hashes of unit ranges."""
        if self.words:
            return prefix_sums(word_hashes(text, starts, ends), WORDS), WORDS
        return prefix_sums(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), BYTES), BYTES

    def segment(self, text: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> bytes:
        """Units ``first`` to ``last - 1``, words joined by one space."""
        if not self.words:
            return text[first:last]
        return b" ".join([text[a:b] for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist())])

    def segments(self, text: bytes, ranges: list[tuple[int, int]]) -> list[bytes]:
        """``segment`` of many ranges: words with single spaces between them are cut out whole."""
        if not self.words:
            return [text[a:b] for a, b in ranges]
        starts, ends = word_bounds(text)
        uneven = uneven_gaps(text, starts, ends)
        return [
            text[starts[a] : ends[b - 1]] if uneven[a] == uneven[b - 1] else self.segment(text, starts, ends, a, b) for a, b in ranges
        ]

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Runs of all texts: number of the text, start and number of windows, anchor, segment hash, and
        whether the anchor recurs (in the text; of bytes, in one of the texts cut with it)."""
        if self.words:
            parts = [(np.full(len(f[0]), i), *f) for i, f in ((i, self._word_runs(t)) for i, t in enumerate(texts)) if len(f[0])]
        else:
            own = [i for i, t in enumerate(texts) if len(t) >= self.window]
            block = np.cumsum([0] + [len(texts[i]) for i in own])[:-1] // CUT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(own)]
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    row, *found = self._byte_runs([texts[i] for i in own[a:b]])
                    parts.append((np.array(own[a:b])[row], *found))
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, bool))
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else empty

    def _word_runs(self, text: bytes) -> tuple[np.ndarray, ...]:
        first, after = self.bounds(text)
        sums, powers = self.sums(text, first, after)
        units = len(sums) - 1
        if units < self.window:
            return (np.zeros(0, np.int64),)
        at = np.arange(units - self.gram + 1)
        grams = range_hashes(sums, at, at + self.gram, powers)
        width = self.window - self.gram + 1
        least = sliding_minimum(grams, width)
        starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        sizes = np.diff(starts, append=len(least))
        # A gram is chosen if it is the least of some window around it.
        padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
        chosen = np.sort(grams[~sliding_minimum(~padded, width) == grams])
        again = chosen[1:][chosen[1:] == chosen[:-1]]
        anchors = least[starts]
        twice = np.isin(anchors, again) if len(again) else np.zeros(len(anchors), bool)
        # The bytes its units span are the segment. Equal bytes are equal segments; equal segments
        # written with other spaces stay apart, which costs work but no result.
        return starts, sizes, anchors, _digests(text, first[starts], after[starts + sizes + self.window - 2]), twice

    def _byte_runs(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Runs of a few texts, none shorter than a window, from one pass over all of them."""
        text = b"".join(texts)
        lengths = np.array([len(t) for t in texts])
        after = np.cumsum(lengths)
        begin, width = after - lengths, self.window - self.gram + 1
        sums, powers = self.sums(text, None, None)
        grams = mixed((sums[self.gram :] - sums[: -self.gram]) * powers.get(len(sums))[1][: len(sums) - self.gram]
                      + np.uint64(self.gram * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        least = sliding_minimum(grams, width)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        new[begin] = True
        stop = after - self.window + 1  # windows of a text start before it
        for a, b in zip(stop[:-1].tolist(), begin[1:].tolist()):
            new[a:b] = False
        starts = np.flatnonzero(new)
        row = np.searchsorted(begin, starts, side="right") - 1
        sizes = np.minimum(np.append(starts[1:], len(least)), stop[row]) - starts
        anchors = least[starts]
        return row, starts - begin[row], sizes, anchors, _digests(text, starts, starts + sizes + self.window - 1), np.isin(
            anchors, self._recurring(grams, starts, anchors, begin, after))

    def _recurring(self, grams: np.ndarray, starts: np.ndarray, anchors: np.ndarray, begin: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Grams at two or more places that are each the least of some window around them."""
        at = np.flatnonzero(grams <= anchors.max())
        value = grams[at]
        order = np.argsort(value, kind="stable")
        equal = value[order[1:]] == value[order[:-1]]
        if not equal.any():
            return value[:0]
        at = at[order[np.append(equal, False) | np.append(False, equal)]]
        row = np.searchsorted(begin, at, side="right") - 1
        inside = at + self.gram <= after[row]
        at, row = at[inside], row[inside]
        first = np.maximum(begin[row], at - (self.window - self.gram))  # windows around the gram
        last = np.minimum(at, after[row] - self.window)
        runs = [np.searchsorted(starts, x, side="right") for x in (first, last)]
        # None of their anchors is larger than the gram.
        most = np.maximum.reduceat(np.append(anchors, np.uint64(0)), np.column_stack((runs[0] - 1, runs[1])).ravel())[::2] if len(at) else grams[:0]
        value = np.sort(grams[at[most == grams[at]]])
        return value[1:][value[1:] == value[:-1]]


def _digests(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Identity of segments: a 128-bit digest of the bytes of each, as two longs."""
    view, digest = memoryview(text), hashlib.blake2b
    digests = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())])
    return np.frombuffer(digests, "<i8").reshape(-1, 2)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key that tells rows with the same id apart unless their texts agree too.

    The key holds two 64-bit hashes of the text, the second seeded by its length, so that
    different texts under one id agree with a chance of 2 ** -128 a pair.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id").cast("long")
    hashes = F.xxhash64(text).alias("th"), F.xxhash64(F.octet_length(text), text).alias("tl")
    return docs.select(number.alias("doc_id"), F.coalesce(number, F.lit(-(1 << 63))).alias("d"), *hashes, text.alias("text"))


def _runs(keyed: DataFrame, units: Units) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, sizes, anchors, hashes, twice = units.runs(binary(batch, "text"))
            if not len(row):
                continue
            yield pa.RecordBatch.from_arrays([
                *(batch.column(i).take(pa.array(row)) for i in range(len(KEY))), pa.array(starts), pa.array(sizes),
                pa.array(anchors.view(np.int64)), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()),
                pa.array(twice),
            ], [*KEY, "start", "n", "anchor", "hash", "hash2", "twice"])

    return keyed.select(*KEY, "text").mapInArrow(cut, RUN)


def _segments(keyed: DataFrame, chosen: DataFrame, units: Units) -> DataFrame:
    """Reads the texts of chosen runs (``d, th, start, n, anchor, hash, hash2, weight``)."""
    lists = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", *SEGMENT, "weight")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that are equal give their segments once a task
        for batch in batches:
            rows = []
            for text, runs, *key in zip(binary(batch, "text"), *(batch.column(i).to_pylist() for i in range(1, 2 + len(KEY)))):
                if tuple(key) in seen:
                    continue
                seen.add(tuple(key))
                found = units.segments(text, [(r["start"], r["start"] + r["n"] + units.window - 1) for r in runs])
                rows += [(r["anchor"], r["hash"], r["hash2"], r["weight"], r["n"], s) for r, s in zip(runs, found)]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.binary())], [*SEGMENT, "weight", "n", "segment"]
            )

    return keyed.select(*KEY, "text").join(lists, KEY).select("text", "runs", *KEY).mapInArrow(
        cut, "anchor long, hash long, hash2 long, weight long, n long, segment binary")


def _searched(segments: DataFrame, units: Units, find: Finder, shard_bytes: int) -> DataFrame:
    """Runs ``first, count`` of repeated windows in each segment (``anchor, hash, hash2``), shard by shard."""
    total = segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(SEGMENT)
        flags = find(group["segment"].tolist(), group["weight"].to_numpy(), units.window)
        rows = []
        for i, f in enumerate(flags):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], f.astype(np.int8), [0]))))
            rows += [(i, a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        at = [r[0] for r in rows]
        return pd.DataFrame({
            "anchor": group["anchor"].to_numpy()[at], "hash": group["hash"].to_numpy()[at], "hash2": group["hash2"].to_numpy()[at],
            "first": np.array([r[1] for r in rows], np.int64), "count": np.array([r[2] for r in rows], np.int64),
        })

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, "anchor long, hash long, hash2 long, first long, count long")


def _windows(segments: DataFrame, units: Units) -> DataFrame:
    """Every window of the segments by a 128-bit digest: ``anchor, hash, hash2, off, weight, wide, narrow``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                starts, ends = units.bounds(r["segment"])
                texts = [units.segment(r["segment"], starts, ends, i, i + units.window) for i in range(r["n"])]
                ids = np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=16).digest() for t in texts]), "<i8").reshape(-1, 2)
                same = lambda x: pa.array(np.full(r["n"], x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [same(r["anchor"]), same(r["hash"]), same(r["hash2"]), pa.array(np.arange(r["n"])), same(r["weight"]), pa.array(ids[:, 0].copy()),
                     pa.array(ids[:, 1].copy()), pa.array(texts, pa.binary())],
                    [*SEGMENT, "off", "weight", "wide", "narrow", "segment"],
                )

    return segments.mapInArrow(cut, "anchor long, hash long, hash2 long, off long, weight long, wide long, narrow long, segment binary")


def _searched_hot(hot: DataFrame, units: Units, find: Finder, shard_bytes: int) -> DataFrame:
    """As ``_searched`` for segments of frequent anchors, cut to windows that are dealt by their own digest."""
    windows = _windows(hot, units)
    ids = ["wide", "narrow"]
    counted = windows.groupBy(*ids).agg(F.sum("weight").alias("weight"), F.min(F.struct(*SEGMENT, "off")).alias("at")).where("weight > 1")
    counted = written(counted, "passages-windows")
    taken = windows.drop("weight").join(
        counted.select("weight", *[F.col(f"at.{c}").alias(c) for c in SEGMENT], F.col("at.off").alias("off")), [*SEGMENT, "off"]
    )
    alone = taken.select(F.col("wide").alias("anchor"), F.col("narrow").alias("hash"), F.lit(0).cast("long").alias("hash2"), "weight",
                         F.lit(1).cast("long").alias("n"), "segment")
    found = _searched(written(alone, "passages-frequent"), units, find, shard_bytes)
    hits = found.select(F.col("anchor").alias("wide"), F.col("hash").alias("narrow"))
    return windows.select(*SEGMENT, "off", *ids).join(hits, ids).select(*SEGMENT, F.col("off").alias("first"), F.lit(1).cast("long").alias("count"))


def repeated_ranges(
    docs: DataFrame, units: Units, find: Finder, shard_bytes: int, hot_segments: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """The documents with their keys, and ranges ``a, b`` of window starts that occur elsewhere too."""
    ready_for_python(docs.sparkSession)
    keyed = _keyed(docs)
    runs = written(_runs(keyed, units), "passages-runs")
    seen = F.sum(F.when(F.col("twice"), 2).otherwise(1))
    anchors = runs.groupBy("anchor").agg(seen.alias("seen")).where("seen > 1").select("anchor")
    again = written(runs.join(anchors, "anchor").select(*KEY, "start", "n", *SEGMENT), "passages-again")
    forget(runs)
    # One run stands for all with its segment. A row that the table holds several times may give
    # its segments once a task; the search takes one of them, the weight counts all.
    chosen = again.groupBy(*SEGMENT).agg(F.count("*").alias("weight"), F.min(F.struct(*KEY, "start", "n")).alias("r")).select("r.*", *SEGMENT, "weight")
    segments = written(_segments(keyed, chosen, units), "passages-segments")
    per_anchor = segments.groupBy("anchor").agg(F.count("*").alias("segments")).where(F.col("segments") > hot_segments).select("anchor")
    hot_anchors = written(per_anchor, "passages-hot")
    if hot_anchors.isEmpty():
        found = _searched(segments, units, find, shard_bytes)
    else:
        usual = segments.join(hot_anchors, "anchor", "left_anti")
        hot = written(segments.join(hot_anchors, "anchor", "left_semi"), "passages-hot-segments")
        found = _searched(usual, units, find, shard_bytes).unionByName(_searched_hot(hot, units, find, shard_bytes))
    found = written(found, "passages-found")
    forget(segments)
    where = again.join(found, SEGMENT)
    ranges = where.select(*KEY, (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("first") + F.col("count")).alias("b"))
    ranges = written(ranges, "passages-ranges")
    forget(again, found)
    return keyed, ranges


def with_ranges(keyed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents and, per row, the list of their ranges. Equal rows share one list, which has no more ranges than a document has windows."""
    pieces = ranges.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    few = ranges.limit(200_001).count() <= 200_000
    return keyed.join(F.broadcast(pieces) if few else pieces, KEY, "left")


def covered(ranges: list[dict] | None, units: int, window: int) -> np.ndarray:
    """Flags of the units that a repeated window covers."""
    steps = np.zeros(units + 1, np.int64)
    for r in ranges or ():
        steps[r["a"]] += 1
        steps[r["b"] + window - 1] -= 1
    return np.cumsum(steps[:-1]) > 0
