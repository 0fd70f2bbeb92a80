"""Substring removal with a compressed FM-index per shard.

Each shard of ``passages`` becomes one FM-index: the Burrows-Wheeler transform of its segments'
words in a wavelet tree of packed bit vectors. The segments are then streamed against it from
right to left; the number of occurrences of ever longer matches gives the matching statistics,
and stretches of at least the window that occur twice are reported.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from presslake.llm.induced_sorting import doubled
from presslake.llm.passages import Units, covered, repeated_ranges, with_ranges
from presslake.llm.staging import binary
from presslake.llm.words import joined, word_bounds

WINDOW, GRAM = 35, 10
SHARD_BYTES = 12 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class BitVector:
    """Bits in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """A balanced wavelet tree, its levels stored one after another (all zeros of a level first)."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.bits = max(1, (alphabet - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            ones = bit.astype(bool)
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        every = np.arange(alphabet)
        self.node = self._descend(every, np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, b in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1)):
            ones = level.rank(at)
            at = np.where(symbol >> b & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.node[symbol]


class FMIndex:
    """Counts weighted occurrences by backward search. Symbols are 1 and more; 0 ends the text."""

    def __init__(self, text: np.ndarray, weights: np.ndarray) -> None:
        text, weights = np.append(text, 0), np.append(weights, 0)
        alphabet = int(text.max()) + 1
        order = doubled(text)
        self.tree = WaveletTree(text[order - 1], alphabet)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.weight = np.concatenate(([0], np.cumsum(weights[order])))
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, empty: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one symbol put before them. Before an empty match
        (``empty``) that is all of the symbol's rows, which needs no rank."""
        new_low, new_high = self.first[symbol], self.first[symbol + 1]
        at = np.arange(len(symbol)) if empty is None else np.flatnonzero(~empty)
        both = self.tree.rank(np.concatenate((symbol[at], symbol[at])), np.concatenate((low[at], high[at])))
        new_high[at] = new_low[at] + both[len(at) :]
        new_low[at] += both[: len(at)]
        return new_low, new_high

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]

def _ruled_out(index: FMIndex, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray, weights: np.ndarray, window: int) -> np.ndarray:
    """Segments without a repeated window that a short backward search tells: words that all of
    the segment's windows share, and that occur once, are in no repeated window."""
    out = np.zeros(len(sizes), bool)
    # The windows of a segment share its words from the last window's first to the first window's last.
    which = np.flatnonzero((weights == 1) & (sizes >= window) & (sizes < 2 * window))
    left, at = (begin + sizes - window)[which], (begin + window)[which]
    low, high, empty = np.zeros(len(which), np.int64), np.full(len(which), index.size), np.ones(len(which), bool)
    while len(which):
        low, high = index.extend(text[at - 1], low, high, empty)
        single, at = index.occurrences(low, high) <= 1, at - 1
        out[which[single]] = True
        keep = ~single & (at > left)
        which, left, at, low, high = which[keep], left[keep], at[keep], low[keep], high[keep]
        empty = np.zeros(len(which), bool)
    return out


def find_repeats(segments: list[bytes], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """Flags of the windows of each segment (words joined by one space) that occur at least twice in all."""
    words = pc.split_pattern(pa.array(segments, pa.large_binary()), b" ")
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1  # a separator, symbol 1, follows each segment
    text = np.ones(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
    index = FMIndex(text, np.repeat(weights, sizes + 1))
    steps = np.zeros(len(text) + 1, np.int64)  # +1 where flagged windows begin, -1 after them

    open_ = ~_ruled_out(index, text, begin, sizes, weights, window)
    start, end = begin[open_], (begin + sizes)[open_]
    at = end.copy()
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.size)
    while len(at):
        new_low, new_high = index.extend(text[at - 1], low, high, at == end)
        longer = index.occurrences(new_low, new_high) > 1
        at = at - longer
        done = ~longer | (at == start)
        full = done & (end - at >= window)
        np.add.at(steps, at[full], 1)
        np.add.at(steps, (end - window + 1)[full], -1)
        low, high = np.where(longer, new_low, low), np.where(longer, new_high, high)
        # The match ending here cannot be longer; the window that begins one word earlier is next.
        failed = done & (at > start)
        end = np.where(failed, np.minimum(end - 1, at - 1 + window), end)
        at, low, high = np.where(failed, end, at), np.where(failed, 0, low), np.where(failed, index.size, high)
        keep = ~done | (failed & (end - start >= window))
        start, end, at, low, high = start[keep], end[keep], at[keep], low[keep], high[keep]
    flags = np.cumsum(steps) > 0
    return [flags[a : a + n - window + 1] for a, n in zip(begin.tolist(), sizes.tolist())]


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_segments: int = 4096) -> DataFrame:
    """Per row of ``docs``: words, words removed, and the SHA-256 of those kept, joined by one space.

    A word goes if a window of ``window`` words over it also starts anywhere else, in the same
    document too. Null and empty texts have no words; a document that is shorter than a window
    keeps all; rows that repeat an id or a whole row are documents of their own; null ids are
    kept; other columns are ignored; an empty table gives no rows.
    """
    units = Units(words=True, window=window, gram=min(gram, window))
    keyed, ranges = repeated_ranges(docs, units, find_repeats, shard_bytes, hot_segments)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), binary(batch, "text"), batch.column(2).to_pylist()):
                starts, ends = word_bounds(text)
                keep = np.flatnonzero(~covered(found, len(starts), window))
                kept = joined(text, starts, ends, keep)
                rows.append((doc_id, len(starts), len(starts) - len(keep), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return with_ranges(keyed, ranges).select("doc_id", "text", "ranges").mapInArrow(strip, RESULT)
