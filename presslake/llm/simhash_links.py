"""Near duplicates by SimHash, searched with covering locality-sensitive hashing.

Every bit position gets a nonzero vector of radius + 1 bits. Table v, one for each nonzero
vector v, keeps the positions whose vector has an odd inner product with v. At most ``radius``
positions span less than the whole space, so some v is orthogonal to all of them: two
fingerprints that differ only there agree on everything table v keeps. No pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.components import components
from presslake.llm.staging import binary, ready_for_python, forget, written
from presslake.llm.words import word_bounds

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of one bucket that are compared directly; larger buckets are hashed once more.
DIRECT = 4096
ALL = (1 << 64) - 1


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """A mask of 64 bits for each nonzero vector of ``radius + 1`` bits, over the given positions."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << p for k, p in enumerate(positions) if ((k % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes, repeats included."""
    text = text.lower()  # bytes: A-Z only
    starts, ends = word_bounds(text)
    if not len(starts):
        return 0
    if np.any(starts[1:] != ends[:-1] + 1) or b" " * (len(starts) - 1) != np.frombuffer(text, np.uint8)[ends[:-1]].tobytes():
        text = b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        starts, ends = word_bounds(text)
    first, last = (starts[: len(starts) - shingle + 1], ends[shingle - 1 :]) if len(starts) >= shingle else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(text[a:b], seed) for a, b in zip(first.tolist(), last.tolist())], "<u8", len(first))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every row; null texts have fingerprint zero."""
    ready_for_python(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x) for x in binary(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(read, "doc_id long, fp long")


def _near(one: np.ndarray, many: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(one ^ many) <= radius


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within one bucket: at most one less than its fingerprints."""
    rest, a, b = fps, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _near(x, rest, radius)
            found = rest[near]
            if len(found):
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _searched(keyed: DataFrame, radius: int, direct: int | None) -> DataFrame:
    """From rows ``t, key, fp``: links ``a, b`` (kind 0), or the rows of too large buckets (kind 1, ``t`` in ``a``, ``fp`` in ``b``)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

        def rows(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        def small(t: np.ndarray, key: np.ndarray, fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Buckets of up to 8 are compared side by side, larger ones one by one."""
            left = np.repeat(starts + sizes, sizes)
            at = np.arange(len(fp))
            few = np.repeat(sizes <= 8, sizes)
            a, b = [fp[:0]], [fp[:0]]
            for d in range(1, 8):
                i = at[few & (at + d < left)]
                i = i[_near(fp[i], fp[i + d], radius)]
                a.append(fp[i])
                b.append(fp[i + d])
            for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
                x, y = _forest(fp[s : s + n], radius)
                a.append(x)
                b.append(y)
            yield rows(0, np.concatenate(a), np.concatenate(b))

        parts: list[tuple[np.ndarray, ...]] = []
        held, spilled = 0, None  # rows of the last bucket so far; the bucket that proved too large
        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if not len(t):
                continue
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cut))
            for s, e in ((0, int(starts[1]) if len(starts) > 1 else len(t)),):
                same = (parts and (parts[-1][0][-1], parts[-1][1][-1]) == (t[0], key[0])) or spilled == (t[0], key[0])
                if not same:
                    e = s
                elif spilled == (t[0], key[0]):
                    yield rows(1, t[s:e].astype(np.int64), fp[s:e])
                else:
                    parts.append((t[s:e], key[s:e], fp[s:e]))
                    held += e - s
            if parts and direct is not None and held > direct:
                spilled = (parts[-1][0][-1], parts[-1][1][-1])
                for x, _, z in parts:
                    yield rows(1, x.astype(np.int64), z)
                parts, held = [], 0
            if e == len(t):
                continue
            if parts:  # the open bucket is complete
                t0, k0, f0 = (np.concatenate(x) for x in zip(*parts))
                yield from small(t0, k0, f0, np.zeros(1, np.int64), np.array([len(t0)]))
                parts, held = [], 0
            spilled = None
            t, key, fp = t[e:], key[e:], fp[e:]
            starts = np.concatenate(([0], np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1))
            sizes = np.diff(starts, append=len(t))
            whole = int(starts[-1])
            if whole:
                big = sizes[:-1] > (direct if direct is not None else len(t))
                take = np.repeat(~big, sizes[:-1])
                if big.any():
                    yield rows(1, t[:whole][~take].astype(np.int64), fp[:whole][~take])
                kept = sizes[:-1][~big]
                yield from small(t[:whole][take], key[:whole][take], fp[:whole][take], np.cumsum(kept) - kept, kept)
            parts, held = [(t[whole:], key[whole:], fp[whole:])], len(t) - whole
        if parts:
            t0, k0, f0 = (np.concatenate(x) for x in zip(*parts))
            if direct is not None and len(t0) > direct:
                yield rows(1, t0.astype(np.int64), f0)
            else:
                yield from small(t0, k0, f0, np.zeros(1, np.int64), np.array([len(t0)]))

    return keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(search, "kind int, a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that join exactly what is linked at the radius.

    Each fingerprint goes to 31 tables (radius 4) and is compared within its buckets. Of a
    bucket over ``direct`` fingerprints, the positions that its table does not keep are covered
    again by the same rule; after that at most 17 positions are left, which bounds a bucket
    whatever the input. A bucket gives the links of a spanning forest, not all its pairs.
    """
    masks = covering_masks(radius, list(range(64)))
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks)])).alias("x")
    keyed = distinct.select("fp", table).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    found = written(_searched(keyed, radius, direct), "simhash-links")
    first = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1")
    if large.isEmpty():
        return first
    again = []
    for i, m in enumerate(masks):
        inner = covering_masks(radius, [p for p in range(64) if not m >> p & 1])
        again.append(F.when(F.col("a") == i, F.array(*[F.struct(F.lit(i * len(inner) + j).alias("t"), F.lit(_signed(m | x)).alias("m")) for j, x in enumerate(inner)])))
    keyed = large.select(F.col("b").alias("fp"), F.explode(F.coalesce(*again)).alias("x"))
    keyed = keyed.select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    return first.unionByName(_searched(keyed, radius, None).select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``radius`` differing bits
    reach, the row's own included (null if all of them are null). Equal fingerprints are one
    node, so copies cost no links. Null and empty texts have fingerprint zero and are linked
    like any other; repeated rows stay repeated; other columns are ignored.
    """
    prints = written(fingerprints(docs), "simhash-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    labels = components(links(nodes.select("fp"), radius))
    named = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    result = written(named.join(smallest, "label").select("fp", "component_id"), "simhash-components")
    forget(nodes)
    return prints.join(result, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
