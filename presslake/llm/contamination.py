"""Benchmark items inside documents: size-partitioned MinHash search, verified by exact containment.

Items are partitioned by their number of shingles. For the class of up to u shingles a document
is cut into domains of 2u shingles, each beginning u after the one before: a passage of an item's
length lies whole in one of them, however long the document, so the Jaccard similarity of an
item and its domain has a floor set by the class and not by the document. The minima of all
classes are put together from those of blocks of ``BLOCK`` shingles. Items of few distinct
shingles have no such floor; every shingle of a document is looked up among theirs instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.staging import binary, ready_for_python
from presslake.llm.words import LONG, WORDS, mixed, prefix_sums, range_hashes, word_bounds, word_hashes

SHINGLE = 5
CONTAINED = 0.8
#: Minima of an item and a domain; one that agrees makes a candidate. Items searched so have more
#: distinct shingles than half their class bound. At a containment of 0.8 in one passage of the
#: item's length the least similar domain has a Jaccard similarity of 0.8 / (4 + 0.2) = 0.19, so
#: all HASHES differ with a chance of 0.81 ** 48, about 4e-5; for a whole item it is 0.75 ** 48, 1e-6.
HASHES = 48
BLOCK = 8
#: Items of at most so many distinct shingles, or of at most half their class bound, are looked up exactly.
FEW = 8
#: Items and bytes of one pass; more items are searched in several passes over the documents.
PASS_ITEMS, PASS_BYTES = 20_000, 16 << 20


def size_class(n: int) -> int:
    """Upper bound of the class of ``n`` shingles: 8, 16, 32, …"""
    return max(BLOCK, 1 << (n - 1).bit_length())


def shingles(words: list[bytes], width: int = SHINGLE) -> set[bytes]:
    """Distinct runs of ``width`` words."""
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _shingle_hashes(data: bytes, width: int) -> np.ndarray:
    starts, ends = word_bounds(data)
    if len(starts) < width:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(word_hashes(data, starts, ends), WORDS)
    first = np.arange(len(starts) - width + 1)
    return range_hashes(sums, first, first + width, WORDS)


_FACTORS = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(LONG.base)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class _Table:
    """Minima of the items of one class under one hash function, and a filter of their low bits."""

    def __init__(self, minima: np.ndarray, items: np.ndarray) -> None:
        order = np.argsort(minima, kind="stable")
        self.minima, self.items = minima[order], items[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.minima & np.uint32(0xFFFF)] = True

    def hits(self, minima: np.ndarray) -> Iterator[tuple[int, int]]:
        """Positions of minima that are in the table, with the items that have them."""
        at = np.flatnonzero(self.filter[minima & np.uint32(0xFFFF)])
        low, high = (np.searchsorted(self.minima, minima[at], side=side) for side in ("left", "right"))
        for position, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            for item in self.items[a:b].tolist():
                yield position, item


class _Lookup:
    """All shingle hashes of the items of few distinct shingles, and a filter of their low bits."""

    def __init__(self, members: list[tuple[int, np.ndarray]]) -> None:
        hashes = np.concatenate([h for _, h in members])
        items = np.repeat([i for i, _ in members], [len(h) for _, h in members])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items = hashes[order], items[order]
        self.sizes = np.zeros(int(items.max()) + 1, np.int64)
        self.sizes[[i for i, _ in members]] = [len(h) for _, h in members]
        self.mask = np.uint32((1 << max(16, len(hashes).bit_length() + 3)) - 1)
        self.filter = np.zeros(int(self.mask) + 1, bool)
        self.filter[hashes & self.mask] = True

    def hits(self, hashes: np.ndarray, owner: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """Owners of hashes with the items of which they have a share of at least ``least``."""
        at = np.flatnonzero(self.filter[hashes & self.mask])
        at = at[self.hashes[np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)] == hashes[at]]
        pairs = np.unique((owner[at].astype(np.uint64) << np.uint64(32)) | hashes[at])
        owners, found = (pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32)
        low, high = (np.searchsorted(self.hashes, found, side=side) for side in ("left", "right"))
        many = high - low
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)
        both, shared = np.unique(np.repeat(owners, many) * len(self.sizes) + self.items[entry], return_counts=True)
        owners, items = np.divmod(both, len(self.sizes))
        enough = shared >= least * self.sizes[items]
        yield from zip(owners[enough].tolist(), items[enough].tolist())


class ItemIndex:
    """Minima of items by width and class, hashes of those of few shingles, and all their shingles for the exact check."""

    def __init__(self, items: list[tuple[int | None, bytes]]) -> None:
        self.items, by_class, few = [], {}, {}
        for item_id, text in items:
            words = text.lower().split()
            width = min(SHINGLE, len(words))
            if width:
                wanted, bound = shingles(words, width), size_class(len(words) - width + 1)
                hashes = _shingle_hashes(b" ".join(words), width)
                if len(wanted) <= max(FEW, bound // 2):
                    few.setdefault(width, []).append((len(self.items), self._short(np.unique(hashes))))
                else:
                    hashes = self._short(hashes)
                    minima = np.array([(hashes * f).min() for f in _FACTORS], np.uint32)
                    by_class.setdefault(width, {}).setdefault(bound, []).append((len(self.items), minima))
                self.items.append((item_id, width, wanted))
        self.lookups = {width: _Lookup(members) for width, members in few.items()}
        self.tables = {}
        for width, classes in by_class.items():
            for bound, members in sorted(classes.items()):
                numbers = np.array([i for i, _ in members])
                self.tables.setdefault(width, {})[bound] = [_Table(np.array([m[k] for _, m in members]), numbers) for k in range(HASHES)]

    @staticmethod
    def _short(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(32)).astype(np.uint32)

    def candidates(self, texts: list[bytes], least: float) -> set[tuple[int, int]]:
        """Positions of lower-cased texts and of items that agree in a minimum of some domain, or in enough shingle hashes."""
        found: set[tuple[int, int]] = set()
        for width in self.tables.keys() | self.lookups.keys():
            classes = self.tables.get(width, {})
            parts = [self._short(_shingle_hashes(t, width)) for t in texts]
            sizes = np.array([len(x) for x in parts])
            filled = np.flatnonzero(sizes)
            if not len(filled):
                continue
            hashes, sizes = np.concatenate(parts), sizes[filled]
            if width in self.lookups:
                owner = np.repeat(filled, sizes)
                found.update(self.lookups[width].hits(hashes, owner, least))
            if not classes:
                continue
            blocks = -(-sizes // BLOCK)
            first = np.cumsum(blocks) - blocks  # number of each text's first block
            text = np.repeat(np.arange(len(sizes)), blocks)
            cuts = (np.cumsum(sizes) - sizes)[text] + (np.arange(len(text)) - first[text]) * BLOCK
            domains = {}  # by class: the blocks at which domains begin, and their texts
            for bound in classes:
                n = -(-blocks // (bound // BLOCK))
                owner = np.repeat(np.arange(len(sizes)), n)
                domains[bound] = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * (bound // BLOCK), owner
            within = {}  # by step: the blocks whose text goes on for so many blocks
            step = 1
            while step <= max(classes) // BLOCK:
                within[step] = np.flatnonzero(text[: max(0, len(text) - step)] == text[step:])
                step *= 2
            for k, f in enumerate(_FACTORS):
                minima, step = np.minimum.reduceat(hashes * f, cuts), 1
                while step <= max(classes) // BLOCK:
                    longer, go_on = minima.copy(), within[step]
                    longer[go_on] = np.minimum(minima[go_on], minima[go_on + step])
                    minima = longer  # over twice as many blocks, or to the end of the text
                    if step * BLOCK in classes:
                        at, owner = domains[step * BLOCK]
                        found.update((int(filled[owner[i]]), item) for i, item in classes[step * BLOCK][k].hits(minima[at]))
                    step *= 2
        return found

    def matches(self, texts: list[bytes], least: float) -> list[tuple[int, int | None, int, int]]:
        """Position of the text, item, shared and all shingles, of the items that a text contains."""
        texts = [t.lower() for t in texts]
        out, at, own = [], None, {}
        for text, i in sorted(self.candidates(texts, least)):
            if text != at:
                at, words, own = text, texts[text].split(), {}
            item_id, width, wanted = self.items[i]
            if width not in own:
                own[width] = shingles(words, width)
            shared = len(wanted & own[width])
            if shared >= least * len(wanted):
                out.append((text, item_id, shared, len(wanted)))
        return out


def _passes(items: list) -> Iterator[list]:
    part, size = [], 0
    for item in items:
        if part and (len(part) >= PASS_ITEMS or size + len(item[1]) > PASS_BYTES):
            yield part
            part, size = [], 0
        part.append(item)
        size += len(item[1])
    if part:
        yield part


def _item_passes(benchmark: DataFrame) -> Iterator[list]:
    chosen = benchmark.select(F.col("item_id").cast("long"), F.encode(F.col("text").cast("string"), "utf-8")).where("text IS NOT NULL")
    return _passes([(r[0], bytes(r[1])) for r in chosen.toLocalIterator()])


def contained_items(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINED) -> DataFrame:
    """Rows ``doc_id, item_id, shared, item_shingles``: items of whose five-word shingles a share of at least ``least`` is in the document.

    Words are those between ASCII white space, A-Z in lower case. Items of fewer than five
    words are one shingle of all their words; items without a word match nothing, as do null
    and empty texts. Repeated documents and repeated items each give their own rows; null ids
    are carried; other columns are ignored. Nothing is shuffled: the items, cut into passes of
    bounded size, travel to the documents.
    """
    ready_for_python(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, shared long, item_shingles long")
    for items in _item_passes(benchmark):

        def search(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items)
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                rows = [(doc_ids[at], *match) for at, *match in index.matches(binary(batch, "text"), least)]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "item_shingles"])

        out = out.unionByName(texts.mapInArrow(search, "doc_id long, item_id long, shared long, item_shingles long"))
    return out


def without_items(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINED) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item by the rule of ``contained_items``."""
    ready_for_python(docs.sparkSession)
    for items in _item_passes(benchmark):

        def drop(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[at for at, *_ in index.matches(binary(batch, "text"), least)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(drop, docs.schema)
    return docs
