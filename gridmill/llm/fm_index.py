"""A compressed FM-index over sequences of words, searched backwards for many patterns at once.

The Burrows-Wheeler transform of all sequences is kept as a wavelet matrix, one packed bit a level
and word and a count for every 64 bits. A step of the backward search widens a match by one
word to the left; it costs two ranks a level, for whatever number of matches in the same few numpy
calls.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence of whole numbers below ``1 << levels``."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self.zeros = np.zeros(levels, np.int64)
        words = len(symbols) // 64 + 1
        self.bits = np.zeros((levels, words), np.uint64)
        self.before = np.zeros((levels, words), np.int32)
        for level in range(levels):
            bit = (symbols >> (levels - 1 - level)) & 1
            padded = np.zeros(words * 64, np.uint8)
            padded[: len(bit)] = bit
            self.bits[level] = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(self.bits[level]).astype(np.int32)
            self.before[level] = np.cumsum(ones) - ones
            self.zeros[level] = len(bit) - int(ones.sum())
            # Those with a 0 first, each half in its order.
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the first ``places`` symbols end in the part that holds the symbol, at the last
        level; the difference to the descent from 0 is the symbol's rank."""
        for level in range(self.levels):
            block, rest = places >> 6, (places & 63).astype(np.uint64)
            mask = (np.uint64(1) << rest) - np.uint64(1)
            ones = self.before[level][block] + np.bitwise_count(self.bits[level][block] & mask)
            one = (symbols >> (self.levels - 1 - level)) & 1
            places = np.where(one == 1, self.zeros[level] + ones, places - ones)
        return places

    @property
    def nbytes(self) -> int:
        return self.bits.nbytes + self.before.nbytes


def sorted_suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. ``ends`` are the places of the separators; each is a
    symbol of its own, below all words, so no comparison goes past one."""
    rank = text + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    width = 1
    while True:
        beyond = np.zeros(len(text), np.int64)
        beyond[: max(0, len(text) - width)] = rank[width:]
        key = rank * (int(rank.max()) + 1) + beyond
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if len(new) and new[-1] == len(text) - 1:
            return order
        rank = np.empty(len(text), np.int64)
        rank[order] = new
        width *= 2


class FmIndex:
    """An index of ``text``: words from 1 on, each sequence followed by a 0."""

    def __init__(self, text: np.ndarray):
        text = np.asarray(text, np.int64)
        if not len(text) or text[-1] != 0:
            raise ValueError("each sequence needs its separator")
        self.size = len(text)
        suffixes = sorted_suffixes(text, np.flatnonzero(text == 0))
        words = int(text.max())
        self.matrix = WaveletMatrix(text[suffixes - 1], max(1, words.bit_length()))
        symbols = np.arange(words + 1)
        counts = np.bincount(text, minlength=words + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self._shift = self.first[:-1] - self.matrix.descend(symbols, np.zeros(words + 1, np.int64))

    def whole(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The matches of ``count`` empty patterns."""
        return np.zeros(count, np.int64), np.full(count, self.size, np.int64)

    def widen(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matches with one more word before them; ``high - low`` is their number."""
        ends = self.matrix.descend(np.concatenate([words, words]), np.concatenate([low, high]))
        shift = self._shift[words]
        return ends[: len(words)] + shift, ends[len(words) :] + shift

    def count(self, pattern: np.ndarray) -> int:
        low, high = self.whole(1)
        for word in reversed(np.asarray(pattern, np.int64)):
            low, high = self.widen(np.array([word]), low, high)
        return int(high[0] - low[0])

    def statistics(
        self, text: np.ndarray, ends: np.ndarray, floors: np.ndarray, most: int, least: int = 2
    ) -> np.ndarray:
        """Matching statistics of places in ``text``: the number of words up to and with ``ends[i]``,
        not before ``floors[i]`` and not over ``most``, that occur ``least`` times."""
        length = np.zeros(len(ends), np.int64)
        active = np.arange(len(ends))
        low, high = self.whole(len(ends))
        for step in range(most):
            active_ends = ends[active] - step
            room = active_ends >= floors[active]
            active, low, high, active_ends = active[room], low[room], high[room], active_ends[room]
            if not len(active):
                break
            if step:
                low, high = self.widen(text[active_ends], low, high)
            else:
                low, high = self.first[text[active_ends]], self.first[text[active_ends] + 1]
            enough = high - low >= least
            active, low, high = active[enough], low[enough], high[enough]
            length[active] = step + 1
        return length

    @property
    def nbytes(self) -> int:
        return self.matrix.nbytes + self.first.nbytes + self._shift.nbytes


def repeated_windows(
    index: FmIndex, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int, probe: int = 8
) -> np.ndarray:
    """Which windows of the sequences at ``starts`` (of ``sizes`` words, ``window`` at least) occur
    twice in the index that also holds them: true at the place of a window's first word.

    Statistics are computed to ``probe`` words everywhere. A window that holds a shorter piece that
    occurs once occurs once itself; the others are widened to their full length, from the last
    window of each run to the left, so that a run that repeats whole costs one search.
    """
    found = np.zeros(len(text), bool)
    alive = np.zeros(len(text), bool)
    floor = np.zeros(len(text), np.int64)
    if not len(starts):
        return found
    places = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), sizes.tolist())])
    floor[places] = np.repeat(starts, sizes)
    short = index.statistics(text, places, floor[places], probe)
    # First word of the piece that ends here and occurs once, where one was met.
    single = np.full(len(text), -1, np.int64)
    met = (short < probe) & (places - short >= floor[places])
    single[places[met]] = places[met] - short[met]
    latest = np.maximum.accumulate(single)
    last = window - 1
    first_words = np.concatenate(
        [np.arange(s, s + n - last) for s, n in zip(starts.tolist(), sizes.tolist())]
    )
    alive[first_words] = latest[first_words + last] < first_words
    place = np.arange(len(text))
    opens = alive & ~np.concatenate([[False], alive[:-1] & (floor[1:] == floor[:-1])])
    run = np.maximum.accumulate(np.where(opens, place, -1))
    before = np.maximum.accumulate(np.where(alive, place, -1))
    at = before[starts + sizes - window]
    at = at[at >= starts]
    while len(at):
        length = index.statistics(text, at + last, run[at], int((at - run[at]).max()) + window)
        repeats = length >= window
        low = at + window - length
        for a, b in zip(low[repeats].tolist(), at[repeats].tolist()):
            found[a : b + 1] = True
        following = np.where(repeats, low - 1, at - 1)
        inside = following >= floor[at]
        lane = floor[at[inside]]
        at = before[following[inside]]
        at = at[at >= lane]
    return found
