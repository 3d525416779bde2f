"""Hashes of the words of many texts at once, with numpy, on the UTF-8 bytes of an Arrow column.

A word's hash is a polynomial over its bytes modulo 2**64, read off a prefix sum and then mixed, so that
no Python object is made per word. Texts are worked off in pieces of bounded size, cut between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.shipping import ship

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at once, so that the arrays stay in a core's cache; a longer text is cut between two words.
PIECE = 1 << 17

_ALL = np.arange(256)
#: Lower case for A-Z only.
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Everything but white space.
NOT_SPACE = ~np.isin(_ALL, [9, 10, 11, 12, 13, 32])
#: ASCII letters and digits, and every byte of a code point from 128 on.
LETTER_OR_DIGIT = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64) if n else out


class WordHasher:
    """words(column) gives each text's word hashes, one after the other, and where each text's begin."""

    def __init__(self, word_bytes: np.ndarray = NOT_SPACE, fold: np.ndarray = LOWER, piece: int = PIECE):
        self.word_bytes, self.fold, self.piece = word_bytes, fold, piece
        self.up = powers(BASE, piece + 1)
        self.down = powers(INVERSE, piece + 1)

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A null text has no words. offsets has one entry more than column has rows."""
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        data = self.fold[data[offsets[0] : offsets[-1]]]
        at = offsets - offsets[0]
        if column.null_count:  # the bytes below a null aren't text
            for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)):
                data[at[i] : at[i + 1]] = 32
        inside = self.word_bytes[data]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
        starts[first], ends[last] = inside[first], inside[last]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return self._hashes(data, starts, ends), np.searchsorted(starts, at)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            base = int(starts[k])
            n = int(np.searchsorted(ends, base + self.piece, "right"))
            if n <= k:  # a word longer than a piece
                out[k] = self._long(data[base : ends[k]])
                k += 1
                continue
            piece = data[base : ends[n - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * self.up[: len(piece)], out=sums[1:])
            s, e = starts[k:n] - base, ends[k:n] - base
            out[k:n] = mixed((sums[e] - sums[s]) * self.down[s])
            k = n
        return out

    def _long(self, word: np.ndarray) -> np.uint64:
        total, scale = 0, 1
        for at in range(0, len(word), self.piece):
            part = word[at : at + self.piece].astype(np.uint64) + np.uint64(1)
            total += int((part * self.up[: len(part)]).sum(dtype=np.uint64)) * scale
            scale = scale * pow(BASE, len(part), 1 << 64) % (1 << 64)
        return mixed(np.array([total % (1 << 64)], np.uint64))[0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; the order of the words counts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mixed(total)


class RunHashes:
    """Karp-Rabin hashes of the runs of an array of words, of any length, read off running sums."""

    def __init__(self, words: np.ndarray):
        powers = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), base, np.uint64)]), dtype=np.uint64)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(BASE)[:-1], dtype=np.uint64, out=self.sums[1:])
        self.down = powers(INVERSE)

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """The hashes of the runs of this length that begin at these places."""
        return mixed((self.sums[at + length] - self.sums[at]) * self.down[at])


ship(__name__)
