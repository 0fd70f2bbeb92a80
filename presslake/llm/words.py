"""Words and rolling hashes of one text as numpy arrays.

Hashes are polynomials modulo 2**64 with an odd base, so that the hash of any range comes from
two prefix sums and an inverse power. They route and pre-select; texts are compared afterwards.
"""

from __future__ import annotations

import re

import numpy as np

#: A word, as bytes: no space, tab, line feed, vertical tab, form feed or carriage return.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = 0


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = _IS_WORD[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(flags))
    return edges[::2], edges[1::2]


def uneven_gaps(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per word, how many of the gaps before it are not one single space: words between which the
    number is the same stand in the text as they are when joined by one space."""
    out = np.zeros(max(len(starts), 1), np.int64)
    if len(starts) > 1:
        gaps = np.frombuffer(data, np.uint8)[ends[:-1]]
        np.cumsum((gaps != 0x20) | (starts[1:] - ends[:-1] != 1), out=out[1:])
    return out


def joined(data: bytes, starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> bytes:
    """The chosen words (ascending numbers), joined by one space; stretches with even gaps are cut out whole."""
    if not len(chosen):
        return b""
    uneven = uneven_gaps(data, starts, ends)[chosen]
    cuts = np.flatnonzero((np.diff(chosen) != 1) | (np.diff(uneven) != 0)) + 1
    first, last = chosen[np.concatenate(([0], cuts))], chosen[np.concatenate((cuts - 1, [len(chosen) - 1]))]
    return b" ".join([data[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist())])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))))
        return self.up[:n], self.down[:n]


BYTES, WORDS, LONG = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.get(len(values))[0], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Mixed hash of each range of what ``sums`` was made from, its length included."""
    h = (sums[ends] - sums[starts]) * powers.get(len(sums))[1][starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    return range_hashes(prefix_sums(values, BYTES), starts, ends, BYTES)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (``width`` at most their number)."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values
