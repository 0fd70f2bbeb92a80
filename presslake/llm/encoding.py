"""Token ids of the tokenizers library, with every distinct piece of text encoded once.

A byte-level tokenizer first cuts the text; no cut piece holds white space after another
character, nor an ASCII mark or digit after a letter. A text may therefore be cut there
without changing its ids. Pieces recur, so their ids are kept; new pieces of a batch are
encoded by the library in one call and told apart by the bytes that each id stands for.
Texts are cut and short pieces looked up as numpy arrays, a block of texts at a time.
"""

from __future__ import annotations

import os

import numpy as np

from presslake.llm.words import mixed

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Kinds of bytes: of a white space character, of a letter of the Latin blocks (all of them are
#: letters to the tokenizer too), other printable ASCII, and the byte put between texts.
SPACE, LETTER, OTHER, BETWEEN = 1, 2, 3, 4
END = b"\xff"  # never in UTF-8
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = OTHER
KINDS[[ord(c) for c in WHITE_SPACE if c < "\x80"]] = SPACE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KINDS[END[0]] = BETWEEN
_WIDE_SPACES = {n: np.array([int.from_bytes(c.encode()) for c in WHITE_SPACE if len(c.encode()) == n]) for n in (2, 3)}
#: Bytes of a piece that is known by two numbers; longer ones are known by their bytes.
SHORT = 15
_UPTO = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of texts that are cut at once.
BLOCK_BYTES = 1 << 20
#: Pieces kept in one Python worker; beyond that the store starts anew.
KEPT_PIECES = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of every byte of texts in UTF-8 with ``END`` around them."""
    out = KINDS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xF0))  # of characters of two or three bytes
    if not len(lead):
        return out
    code = data[lead].astype(np.int64) << 8 | data[lead + 1]
    latin = lead[(code >= 0xC380) & (code <= 0xC98F) & (code != 0xC397) & (code != 0xC3B7)]
    out[latin] = out[latin + 1] = LETTER
    spaces = lead[np.isin(code, _WIDE_SPACES[2])]
    out[spaces] = out[spaces + 1] = SPACE
    wide = np.isin(code, _WIDE_SPACES[3] >> 8)
    lead, code = lead[wide], code[wide]
    spaces = lead[np.isin(code << 8 | data[lead + 2], _WIDE_SPACES[3])]
    out[spaces] = out[spaces + 1] = out[spaces + 2] = SPACE
    return out


def piece_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts with ``END`` around them, and the number of pieces before each text and in all.

    A piece begins with a text, where white space follows another character, and where a mark
    or digit follows a run of letters that itself follows white space or begins the text.
    """
    kind = kinds(data)
    space, between = kind == SPACE, kind == BETWEEN
    begin = between.copy()
    begin[1:] |= between[:-1]
    begin[1:] |= space[1:] & ~space[:-1]
    letter = kind == LETTER
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    first, after = edges[::2], edges[1::2]
    begin[after[(kind[after] == OTHER) & (space[first - 1] | between[first - 1])]] = True
    bounds = np.flatnonzero(begin)
    pieces = ~between[bounds[:-1]]
    return bounds[:-1][pieces], bounds[1:][pieces], np.searchsorted(bounds[:-1][pieces], np.flatnonzero(between))


def piece_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for every piece of up to ``SHORT`` bytes, which are equal only for equal pieces."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    head = eights[starts] & _UPTO[np.minimum(sizes, 8)]
    tail = eights[starts + 8] & _UPTO[np.clip(sizes - 8, 0, 7)]
    return head, tail | sizes.astype(np.uint64) << np.uint64(56)


class PieceTable:
    """Numbers of short pieces by their keys: cells with the number, taken in turn from that of the key's hash on; 0 is free."""

    def __init__(self) -> None:
        self.cells, self.head, self.tail = np.zeros(1 << 17, np.int32), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)

    def _home(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return (mixed(head ^ tail * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(len(self.cells) - 1)).view(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The number of each key, 0 if it has none."""
        cell = self._home(head, tail)
        out = self.cells[cell]
        active = np.flatnonzero(((self.head[out] != head) | (self.tail[out] != tail)) & (out > 0))
        while len(active):
            cell[active] = (cell[active] + 1) & (len(self.cells) - 1)
            number = out[active] = self.cells[cell[active]]
            active = active[((self.head[number] != head[active]) | (self.tail[number] != tail[active])) & (number > 0)]
        return out

    def add(self, numbers: np.ndarray, head: np.ndarray, tail: np.ndarray) -> None:
        """New different keys and their ascending numbers."""
        last = int(numbers[-1]) + 1
        self.head, self.tail = _room(self.head, last), _room(self.tail, last)
        self.head[numbers], self.tail[numbers] = head, tail
        if 2 * last > len(self.cells):
            self.cells = np.zeros(1 << (2 * last).bit_length(), np.int32)
            numbers = np.flatnonzero(self.tail[:last])
        cell, left = self._home(self.head[numbers], self.tail[numbers]), numbers.astype(np.int32)
        while len(left):
            free = self.cells[cell] == 0
            self.cells[cell[free]] = left[free]  # one of those that meet in a cell stays
            out = self.cells[cell] != left
            cell, left = (cell[out] + 1) & (len(self.cells) - 1), left[out]


class PieceEncoder:
    def __init__(self, path: str, kept: int = KEPT_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.bytes_of = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # byte-level tokens have one character a byte
        self._start()

    def _start(self) -> None:
        self.table, self.longer, self.pieces = PieceTable(), {}, 1  # pieces are numbered from 1
        self.at, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of each text's ids."""
        data = [x.encode() if x else b"" for x in texts]
        block = np.cumsum([0, *map(len, data)]) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block[:-1])) + 1).tolist(), len(data)]
        parts = [self._block(data[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces > self.kept:
            self._start()
        numbers, upto = self._numbers(END.join([b"", *texts, b""]))
        length = self.length[numbers]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.at[numbers] - ends + length, length)]
        return ids, np.diff(np.concatenate(([0], ends))[upto])

    def _numbers(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece, and the number of pieces before each text and in all; new pieces are encoded."""
        view = np.frombuffer(data, np.uint8)
        starts, ends, upto = piece_bounds(view)
        sizes = ends - starts
        head, tail = piece_keys(view, starts, sizes)
        short = sizes <= SHORT
        out = np.zeros(len(starts), np.int64)
        out[short] = self.table.find(head[short], tail[short])
        first, new = self.pieces, []
        missing = np.flatnonzero((out == 0) & short)
        if len(missing):
            missing = missing[np.lexsort((tail[missing], head[missing]))]
            differs = np.ones(len(missing), bool)
            differs[1:] = (head[missing[1:]] != head[missing[:-1]]) | (tail[missing[1:]] != tail[missing[:-1]])
            once = missing[differs]
            out[missing] = first + np.cumsum(differs) - 1
            self.table.add(out[once], head[once], tail[once])
            new = [data[a:b] for a, b in zip(starts[once].tolist(), ends[once].tolist())]
        long = np.flatnonzero(~short)
        for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
            piece = data[a:b]
            number = self.longer.get(piece)
            if number is None:
                number = self.longer[piece] = first + len(new)
                new.append(piece)
            out[i] = number
        if new:
            self.pieces += len(new)
            self._learn([p.decode() for p in new], first)
        return out, upto

    def _learn(self, pieces: list[str], first: int) -> None:
        spaced = np.array([p[0] in WHITE_SPACE and p[-1] not in WHITE_SPACE for p in pieces], bool)
        joined = [p for p, s in zip(pieces, spaced) if s]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum([len(p.encode()) for p in joined], dtype=np.int64)
        upto = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(upto, ends) + 1
        if len(ends) and (cut[-1] != len(ids) or not np.array_equal(upto[cut - 1], ends)):
            spaced[:] = False  # the ids do not tell the pieces apart: encode one by one
            ids, cut = ids[:0], cut[:0]
        alone = [p for p, s in zip(pieces, spaced) if not s]
        more = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)] if alone else []
        length = np.zeros(len(pieces), np.int64)
        length[spaced] = np.diff(cut, prepend=0)
        length[~spaced] = [len(x) for x in more]
        at = np.zeros(len(pieces), np.int64)
        at[spaced] = self.used + np.cumsum(length[spaced]) - length[spaced]
        at[~spaced] = self.used + len(ids) + np.cumsum(length[~spaced]) - length[~spaced]
        new = np.concatenate([ids, *more])
        last = first + len(pieces)
        self.at, self.length = _room(self.at, last), _room(self.length, last)
        self.at[first:last], self.length[first:last] = at, length
        self.ids = _room(self.ids, self.used + len(new))
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate((array, np.zeros(max(size - len(array), len(array)), array.dtype)))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
