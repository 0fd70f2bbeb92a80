"""External suffix sorting by induction, with common-prefix lengths.

The suffixes that start at leftmost S positions are sorted first: their substrings are named in
order and the string of names is sorted by the same procedure. All others are induced from them
in two sweeps. A sweep is a priority queue of suffix tuples: the smallest suffix leaves it, gets
the next rank, and the suffix one position earlier enters with its first symbol and that rank as
key. The length of the common prefix of two suffixes that leave one after the other is one more
than the least such length between their successors, so it is carried along as ranks are given.

The queue keeps a first-in-first-out list of blocks for each range of symbols. Tuples of one
symbol enter in the order in which they must leave, so lists of one symbol are never sorted, and
their tuples are single numbers (order << 32 | position) without the symbol; ranges of several
symbols (only in strings of names) are loaded and sorted when their turn comes.
Blocks beyond ``memory_rows`` tuples are in a file, as are all arrays with a value per position.
These files are scratch of one task: made when memory runs short, read by no other task, and
without a name, so that nothing stays when the task or its executor ends.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY_ROWS = 1 << 22
SEED = 1 << 31  # added to the ranks of seeds: they leave after the induced suffixes of their symbol
RANGES = 512


class Store:
    """Arrays in memory while short, else mapped from files without a name, which go with the process at the latest."""

    def __init__(self, memory_rows: int) -> None:
        self.memory_rows, self.files, self.spilled = memory_rows, [], 0

    def file(self):
        self.files.append(tempfile.TemporaryFile(prefix="induced-"))
        return self.files[-1]

    def array(self, size: int, dtype: type) -> np.ndarray:
        if size <= self.memory_rows:
            return np.zeros(size, dtype)
        self.spilled += size
        file = self.file()
        file.truncate(size * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(size,))

    def close(self) -> None:
        for file in self.files:
            file.close()


class BlockQueue:
    """Rows ``(key, position)`` by range of symbols, key is symbol << 32 | order; of single symbols, numbers order << 32 | position."""

    def __init__(self, store: Store, edges: np.ndarray, single: bool) -> None:
        self.store, self.edges, self.single = store, edges, single  # first symbol of each range but the first
        self.blocks: list[list] = [[] for _ in range(len(edges) + 1)]
        self.file, self.written, self.rows = None, 0, 0

    def push(self, keys: np.ndarray, positions: np.ndarray) -> None:
        """Rows whose keys do not fall for equal symbols, neither here nor against earlier calls."""
        if not len(keys):
            return
        where = np.searchsorted(self.edges, keys >> 32, side="right")
        # Numbers of one or two bytes are sorted by counting.
        where = where.astype(np.uint8 if len(self.blocks) <= 256 else np.uint16)
        order = np.argsort(where, kind="stable")
        self._put(where[order], np.column_stack((keys[order], positions[order])))

    def push_single(self, symbols: np.ndarray, rows: np.ndarray) -> None:
        """Rows in order of their symbols, of which each is a range."""
        if len(rows):
            self._put(symbols, rows)

    def _put(self, where: np.ndarray, rows: np.ndarray) -> None:
        cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            self.blocks[where[a]].append(rows[a:b])
        self.rows += len(rows)
        if self.rows > self.store.memory_rows:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or self.store.file()
        for blocks in self.blocks:
            held = [b for b in blocks if isinstance(b, np.ndarray)]
            if held:
                rows = np.concatenate(held)
                self.file.seek(self.written)
                self.file.write(rows.tobytes())
                blocks[:] = [b for b in blocks if not isinstance(b, np.ndarray)] + [(self.written, len(rows))]
                self.written += rows.nbytes
        self.store.spilled += self.rows
        self.rows = 0

    def _load(self, block: tuple[int, int], most: int) -> Iterator[np.ndarray]:
        at, rows = block
        width = 1 if self.single else 2
        for first in range(0, rows, most):
            n = min(most, rows - first)
            self.file.seek(at + 8 * width * first)
            part = np.frombuffer(self.file.read(8 * width * n), np.int64)
            yield part if self.single else part.reshape(n, 2)

    def stream(self, r: int) -> Iterator[np.ndarray]:
        """The rows of a range in turn, those that enter meanwhile included."""
        while self.blocks[r]:
            held, self.blocks[r] = self.blocks[r], []
            fresh = [b for b in held if isinstance(b, np.ndarray)]  # always after what was spilled
            self.rows -= sum(map(len, fresh))
            for block in held[: len(held) - len(fresh)]:
                yield from self._load(block, self.store.memory_rows)
            if fresh:
                yield np.concatenate(fresh) if len(fresh) > 1 else fresh[0]

    def all(self, r: int) -> np.ndarray:
        parts = [np.zeros((0, 2), np.int64), *self.stream(r)]
        rows = np.concatenate(parts)
        return rows[np.argsort(rows[:, 0], kind="stable")]


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the last symbol counts as S."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    nearest = np.repeat(differs, np.diff(differs, prepend=-1))  # the end differs from all
    out = np.ones(n, bool)
    out[:-1] = text[nearest] < text[nearest + 1]
    return out


class Sweep:
    """One induction over a string: L suffixes upwards, or S suffixes downwards on mirrored symbols."""

    def __init__(self, store: Store, symbols: np.ndarray, induced: np.ndarray, cap: int) -> None:
        self.symbols, self.induced, self.cap, self.store = symbols, induced, cap, store
        counts = np.bincount(symbols)
        if len(counts) <= RANGES:
            self.edges = np.arange(1, len(counts))
        else:
            share = np.cumsum(counts) * RANGES // counts.sum()
            self.edges = np.unique(np.flatnonzero(np.diff(share)) + 1)
        self.single = len(self.edges) + 1 == len(counts)
        self.order = store.array(len(symbols), np.int64)
        self.common = store.array(len(symbols) + 1, np.uint16)
        self.rank = 0
        self.last: tuple | None = None  # the row before: key and position, or symbol, order, position and whether a seed
        if self.single:
            # The symbol before each position, or their number where there is none to induce.
            dtype = np.uint8 if len(counts) < 256 else np.uint16
            self.before = store.array(len(symbols), dtype)
            self.before[0] = self.none = len(counts)
            self.before[1:] = np.where(induced[:-1], symbols[:-1], dtype(self.none))

    def run(self, seeds: np.ndarray, seed_common: np.ndarray | None) -> None:
        """Seeds in order, and the common prefix of each with the seed before (where their symbols agree)."""
        queue = BlockQueue(self.store, self.edges, self.single)
        self.seed_common = seed_common
        late = BlockQueue(self.store, self.edges, self.single)  # seeds leave after the induced rows of their symbol
        for a in range(0, len(seeds), self.store.memory_rows):
            part = np.asarray(seeds[a : a + self.store.memory_rows])
            if self.single:
                symbols = self.symbols[part].astype(self.before.dtype)
                order = np.argsort(symbols, kind="stable")
                late.push_single(symbols[order], (a + order) << 32 | part[order])
            else:
                late.push(self.symbols[part].astype(np.int64) << 32 | (SEED + a + np.arange(len(part))), part)
        for r in range(len(self.edges) + 1):
            if self.single:
                for rows in queue.stream(r):
                    queue.push_single(*self._accept_single(rows, r, False))
                for rows in late.stream(r):
                    queue.push_single(*self._accept_single(rows, r, True))
                continue
            rows = np.concatenate((queue.all(r), late.all(r)))
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            while len(rows):
                keys, _ = self._earlier(rows, 0)
                least = np.minimum.accumulate(keys)
                over = np.flatnonzero(rows[1:, 0] > least[:-1])
                cut = int(over[0]) + 1 if len(over) else len(rows)
                queue.push(*self._accept(rows[:cut]))
                more = queue.all(r)
                rows = rows[cut:]
                if len(more):
                    rows = np.concatenate((rows, more))
                    rows = rows[np.argsort(rows[:, 0], kind="stable")]

    def _earlier(self, rows: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the suffixes one position earlier (the largest number where there is none to induce)."""
        before = rows[:, 1] - 1
        good = (before >= 0) & self.induced[before]
        keys = np.where(good, self.symbols[before].astype(np.int64) << 32 | (rank + np.arange(len(rows))), np.iinfo(np.int64).max)
        return keys, good

    def _accept(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gives ranks and common prefixes to rows that leave the queue; returns the rows that enter."""
        first, n = self.rank, len(rows)
        self.order[first : first + n] = rows[:, 1]
        if self.cap:
            self._carry(rows, first)
        self.rank += n
        keys, good = self._earlier(rows, first)
        return keys[good], rows[good, 1] - 1

    def _accept_single(self, rows: np.ndarray, symbol: int, seed: bool) -> tuple[np.ndarray, np.ndarray]:
        """As ``_accept`` for rows of one symbol that are all seeds or all induced."""
        first, n = self.rank, len(rows)
        positions = rows & 0xFFFFFFFF
        self.order[first : first + n] = positions
        if self.cap:
            self._carry_single(rows >> 32, positions, symbol, seed)
        self.rank += n
        before = self.before[positions]
        order = np.argsort(before, kind="stable")[: np.count_nonzero(before != self.none)]
        return before[order], (first + order) << 32 | (positions[order] - 1)

    def _carry_single(self, order: np.ndarray, positions: np.ndarray, symbol: int, seed: bool) -> None:
        out = np.zeros(len(order), np.uint16)
        if seed:
            out[1:] = self.seed_common[order[1:]]
        elif len(order) > 1:
            least = np.minimum.reduceat(self.common[: order[-1] + 1], order[:-1] + 1)
            out[1:] = np.minimum(least, self.cap - 1) + 1
        if self.last is not None and self.last[0] == symbol:
            _, place, position, last_seed = self.last
            if seed != last_seed:
                out[0] = min(self._repeats(position), self._repeats(int(positions[0])))
            elif seed:
                out[0] = self.seed_common[order[0]]
            else:
                out[0] = min(int(self.common[place + 1 : order[0] + 1].min()) + 1, self.cap)
        self.common[self.rank : self.rank + len(out)] = out
        self.last = symbol, int(order[-1]), int(positions[-1]), seed

    def _carry(self, rows: np.ndarray, first: int) -> None:
        keys = rows[:, 0] if self.last is None else np.concatenate(([self.last[0]], rows[:, 0]))
        positions = rows[:, 1] if self.last is None else np.concatenate(([self.last[1]], rows[:, 1]))
        symbol, order = keys >> 32, keys & 0xFFFFFFFF
        seed = order >= SEED
        same = symbol[1:] == symbol[:-1]
        out = np.zeros(len(same), np.uint16)
        pair = np.flatnonzero(same & ~seed[1:] & ~seed[:-1])
        if len(pair):
            ends = np.column_stack((order[pair] + 1, order[pair + 1] + 1)).ravel()
            least = np.minimum.reduceat(self.common, ends)[::2]
            out[pair] = np.minimum(least.astype(np.int64) + 1, self.cap)
        pair = np.flatnonzero(same & seed[1:] & seed[:-1])
        out[pair] = self.seed_common[order[pair + 1] - SEED]
        for i in np.flatnonzero(same & (seed[1:] != seed[:-1])).tolist():
            out[i] = min(self._repeats(int(positions[i])), self._repeats(int(positions[i + 1])))
        at = first if self.last is not None else first + 1
        self.common[at : at + len(out)] = out
        self.last = int(keys[-1]), int(positions[-1])

    def _repeats(self, position: int) -> int:
        """How often the first symbol of a suffix follows itself, up to the cap."""
        part = self.symbols[position : position + self.cap]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)


def _refined(place: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits groups of equal ``place`` (the number of smaller elements) by key; ``active``
    is in order of place and key. Returns which of them are still tied."""
    group = place[active]
    begins = np.concatenate(([True], group[1:] != group[:-1]))
    parts = begins.copy()
    parts[1:] |= key[1:] != key[:-1]
    edges = np.flatnonzero(parts)
    counts = np.diff(edges, append=len(active))
    begin = np.flatnonzero(begins)
    at_group = np.repeat(begin, np.diff(begin, append=len(active)))
    place[active] = group + np.repeat(edges, counts) - at_group
    return np.repeat(counts > 1, counts)


def _packed(text: np.ndarray, is_s: np.ndarray, width: int, take: int) -> np.ndarray:
    """At every position the next ``take`` symbols with their types as one number, the first highest."""
    pairs = np.zeros(len(text) + take, np.int64)
    pairs[: len(text)] = text.astype(np.int64) * 2 + is_s + 1
    out = pairs[: len(text)].copy()
    for t in range(1, take):
        out <<= width
        out |= pairs[t : t + len(text)]
    return out


def _names(store: Store, text: np.ndarray, is_s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For the substrings between leftmost S positions (both included): numbers from 1 in their order, equal ones equal."""
    width = (2 * int(text.max()) + 2).bit_length()
    take = max(1, 62 // width)
    sizes = np.diff(starts, append=len(text) - 1) + 1
    names = store.array(len(starts), np.int64)
    packed = _packed(text, is_s, width, take) if len(text) <= store.memory_rows else None
    first = text[starts]
    by_first = np.argsort(first, kind="stable")
    done = 0
    for own in np.split(by_first, np.flatnonzero(np.diff(first[by_first])) + 1):  # substrings of one first symbol at a time
        name = np.full(len(own), done, np.int64)
        active, offset = np.arange(len(own)), 0
        while len(active):
            at = starts[own[active]] + offset
            if packed is not None:
                outside = width * np.maximum(take + offset - sizes[own[active]], 0)
                key = packed[at] >> outside << outside
            else:
                key = np.zeros(len(active), np.int64)
                for t in range(take):
                    i = np.minimum(at + t, len(text) - 1)
                    pair = text[i].astype(np.int64) * 2 + is_s[i] + 1
                    key = key << width | np.where(offset + t < sizes[own[active]], pair, 0)
            order = np.lexsort((key, name[active])) if offset else np.argsort(key)
            offset += take
            active = active[order]
            active = active[_refined(name, active, key[order])]
            active = active[sizes[own[active]] > offset]
        names[own] = name
        done += len(own)
    used = np.zeros(len(names) + 1, np.int64)
    used[names] = 1
    return np.cumsum(used)[names]  # dense


def _eights(text: np.ndarray) -> np.ndarray:
    """At every position the next eight one-byte symbols as one number, the first lowest."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)]).view("<u8").ravel()


def _common(text: np.ndarray, left: np.ndarray, right: np.ndarray, cap: int, eights: np.ndarray | None) -> np.ndarray:
    """Common prefixes of pairs of different suffixes, up to ``cap``; ``eights`` compares eight symbols at once.

    Pairs that agree so far have not come to the end, which is a symbol of its own.
    """
    out = np.zeros(len(left), np.uint16)
    active, done = np.arange(len(left)), 0
    while len(active) and done < cap:
        if eights is not None:
            x = eights[left[active] + done] ^ eights[right[active] + done]
            equal, same = x == 0, np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        else:
            equal = text[left[active] + done] == text[right[active] + done]
            same = equal
        out[active] = np.minimum(done + same, cap)
        active, done = active[equal], done + (1 if eights is None else 8)
    return out


def doubled(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, for a string of small numbers that fits into memory: prefix
    doubling of those that are still tied."""
    counts = np.bincount(text)
    place = (np.cumsum(counts) - counts)[text]
    active, n, step = np.flatnonzero(counts[text] > 1), len(text), 1
    while len(active):
        key = place[np.minimum(active + step, n - 1)] + 1
        key[active + step >= n] = 0
        order = np.argsort(place[active] * (n + 1) + key)
        active = active[order]
        active = active[_refined(place, active, key[order])]
        step *= 2
    out = np.empty(n, np.int64)
    out[place] = np.arange(n)
    return out


def sorted_suffixes(text: np.ndarray, cap: int = 0, memory_rows: int = MEMORY_ROWS, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before (up to ``cap``; not made if 0).

    ``text`` holds numbers from 1 and ends in the only 0. Strings of names of up to
    ``memory_rows`` symbols are sorted in memory, longer ones by recursion.
    """
    own = store or Store(memory_rows)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint16)
    is_s = _types(text)
    starts = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1  # leftmost S; the end is the last of them
    names = _names(own, text, is_s, starts)
    names[-1] = 0
    if int(names.max()) == len(names):
        seeds = starts[np.argsort(names)]
    elif len(names) <= memory_rows:
        seeds = starts[doubled(names)]
    else:
        seeds = starts[sorted_suffixes(names, 0, memory_rows, own)[0]]
    shared = None
    if cap:
        shared = own.array(len(seeds), np.uint16)
        eights = _eights(text) if text.dtype == np.uint8 and n <= memory_rows else None
        for a in range(1, len(seeds), 1 << 16):
            b = min(a + (1 << 16), len(seeds))
            shared[a:b] = _common(text, seeds[a - 1 : b - 1], seeds[a:b], cap, eights)
    up = Sweep(own, text, ~is_s, cap)
    up.run(seeds, shared)
    large = ~is_s[up.order[: up.rank]]
    at = np.flatnonzero(large)[::-1]
    mirrored = (int(text.max()) - text).astype(text.dtype)
    down = Sweep(own, mirrored, is_s, cap)
    if cap:
        # Downwards, a suffix shares with the one before what upwards the later one shares with it.
        shared = np.zeros(len(at), np.uint16)
        shared[1:] = up.common[at[:-1]]
        shared = np.append(shared, 0)
    down.run(np.append(up.order[at], n - 1), shared)
    order = down.order[::-1]
    common = np.zeros(n, np.uint16)
    if cap:
        common[1:] = down.common[1:n][::-1]
    return order, common
