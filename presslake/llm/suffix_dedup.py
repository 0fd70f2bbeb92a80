"""Substring removal by external induced sorting of each shard's suffixes.

The shards of ``passages`` are sorted one by one with ``induced_sorting``; suffixes that are
neighbours in order and share a prefix of at least the window hold equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from presslake.llm.induced_sorting import MEMORY_ROWS, Store, sorted_suffixes
from presslake.llm.passages import Units, covered, repeated_ranges, with_ranges
from presslake.llm.staging import binary

WINDOW, GRAM = 200, 40
SHARD_BYTES = 3 << 18
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def find_repeats(segments: list[bytes], weights: np.ndarray, window: int, memory_rows: int = MEMORY_ROWS) -> list[np.ndarray]:
    """Flags of the windows of each segment that occur at least twice in all."""
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\0".join([*segments, b""]), np.uint8) + np.uint8(2)  # bytes of UTF-8 end at 244
    text[begin + sizes] = 1  # a separator after each segment
    text = np.append(text, np.uint8(0))
    left = np.append(np.repeat(begin + sizes, sizes + 1) - np.arange(len(text) - 1), 0)  # bytes before the separator
    weight = np.append(np.repeat(weights, sizes + 1), 0)
    store = Store(memory_rows)
    try:
        order, common = sorted_suffixes(text, window, memory_rows, store)
        group = np.cumsum(common < window) - 1  # suffixes with an equal window are neighbours
        often = np.bincount(group, weight[order]) > 1
        flags = np.zeros(len(text), bool)
        flags[order] = often[group]
    finally:
        store.close()
    flags &= left >= window
    return [flags[a : a + n - window + 1] for a, n in zip(begin.tolist(), sizes.tolist())]


def without_repeated_bytes(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
    hot_segments: int = 4096, memory_rows: int = MEMORY_ROWS,
) -> DataFrame:
    """Per row of ``docs``: UTF-8 bytes, bytes and runs removed, and the SHA-256 of the bytes kept.

    A byte goes if a string of ``window`` bytes over it also starts anywhere else, in the same
    document too. Null and empty texts have no bytes; a text that is shorter than a window is
    kept whole; rows that repeat an id or a whole row are documents of their own; null ids are
    kept; other columns are ignored; an empty table gives no rows.
    """
    units = Units(words=False, window=window, gram=min(gram, window))

    def find(segments: list[bytes], weights: np.ndarray, window: int) -> list[np.ndarray]:
        return find_repeats(segments, weights, window, memory_rows)

    keyed, ranges = repeated_ranges(docs, units, find, shard_bytes, hot_segments)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), binary(batch, "text"), batch.column(2).to_pylist()):
                keep, spans = text, 0
                gone = covered(found, len(text), window) if found else np.zeros(0, bool)
                if found:
                    keep = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((doc_id, len(text), len(text) - len(keep), spans, hashlib.sha256(keep).hexdigest()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return with_ranges(keyed, ranges).select("doc_id", "text", "ranges").mapInArrow(strip, RESULT)
