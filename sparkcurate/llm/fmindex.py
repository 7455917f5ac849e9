"""A compressed full-text index (FM-index) over word numbers, with numpy.

The Burrows-Wheeler transform of the text is held in a wavelet matrix: one bit vector a level, packed, with
counts of set bits every 64 places, so the occurrences of a word before a place are found in one
look-up a level. Suffixes are sorted by their first ``depth`` words only, which is enough for patterns up
to that length. All searches take arrays of patterns and advance them together.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (U(1) << (at & 63).astype(np.uint64)) - U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class Wavelet:
    """Occurrences of a symbol in a sequence, by the symbol's bits from the highest down."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        self.shifts = range(max(int(top).bit_length(), 1) - 1, -1, -1)
        for shift in self.shifts:
            bit = (symbols >> shift) & 1 == 1
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        first = np.zeros(len(symbol), np.int64)
        for shift, level in zip(self.shifts, self.levels):
            one = (symbol >> shift) & 1 == 1
            ones = level.rank(np.concatenate([first, low, high])).astype(np.int64).reshape(3, -1)
            first, low, high = (np.where(one, level.zeros + r, x - r) for x, r in zip((first, low, high), ones))
        return low - first, high - first


def _renumber(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and their dense ranks from 1 on."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
    return order, rank


class FMIndex:
    """Index of ``text``, word numbers from 1 on with a 0 behind each of its parts, the last one
    included; ``depth`` is at least 2."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        shifted = lambda rank, by: np.concatenate([rank[by:], np.zeros(min(by, n), np.int64)])[:n]
        _, rank = _renumber(text)
        length = 1
        while 2 * length < depth:
            order, rank = _renumber(rank * (n + 1) + shifted(rank, length))
            length *= 2
        order, _ = _renumber(rank * (n + 1) + shifted(rank, depth - length))
        self.suffixes = order
        self.whole = self._groups(rank, shifted, length, depth)
        self.shorter = self._groups(rank, shifted, length, depth - 1)
        self.top = int(text.max()) if n else 0
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.top + 1))])
        self.transform = Wavelet(text[order - 1], self.top)
        self.n = n

    def _groups(self, rank: np.ndarray, shifted, length: int, depth: int) -> np.ndarray:
        """Starts of the runs of suffixes that agree in their first ``depth`` words. ``rank`` is by the
        first ``length`` words, at most ``depth`` and more than half of it."""
        parts = [rank, shifted(rank, depth - length)]
        new = np.zeros(len(rank), bool)
        new[:1] = True
        for part in parts:
            ordered = part[self.suffixes]
            new[1:] |= ordered[1:] != ordered[:-1]
        return np.flatnonzero(new)

    def step(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that start with ``word`` and go on as those in ``[low, high)``."""
        before_low, before_high = self.transform.ranks(word, low, high)
        return self.counts[word] + before_low, self.counts[word] + before_high

    def group(self, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(starts, at, "right") - 1

    def stream(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
        """Stream stretches of the indexed text, ``text[end - size : end]``, from their ends backward and
        yield ``(stretch, start, low)`` whenever ``depth`` words are matched: the first suffix of the
        interval. A step at full depth first lets go of the last word, so the matched length stays at
        the depth; as the stretches are part of the index, no step fails."""
        order = np.argsort(-sizes, kind="stable")
        lane_end, lane_size = ends[order], sizes[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64)
        limits = np.append(self.shorter, self.n)
        for t in range(int(lane_size[0]) if len(lane_size) else 0):
            m = int(np.searchsorted(-lane_size, -t, "left"))  # stretches of more than t words
            low, high = low[:m], high[:m]
            if t >= self.depth:
                group = self.group(self.shorter, low)
                low, high = limits[group], limits[group + 1]
            start = lane_end[:m] - 1 - t
            low, high = self.step(low, high, text[start])
            if t + 1 >= self.depth:
                yield order[:m], start, low
