"""Hashes of word windows, computed for a batch of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two rolling hashes, fixed because stored indexes hold their values.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
REMEMBERED = 200_000


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of any range of a sequence of word hashes: the sum of words[i] * base ** (i - start), modulo 2 ** 64.

    Prefix sums take base ** i; an inverse power of the odd base then moves a
    range to its own start, so equal ranges have equal hashes anywhere.
    """

    def __init__(self, words: np.ndarray, base: int):
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words))[:-1], out=self.prefix[1:])
        self.back = powers(pow(base, -1, 1 << 64), len(words))

    def ranges(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.back[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


class Chunk:
    """Word hashes of several texts in a row, with the text that each word belongs to."""

    def __init__(self, texts: list[np.ndarray]):
        self.words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.of = np.repeat(np.arange(len(texts)), size)
        self.start = np.cumsum(size) - size
        self.rolling = [Rolling(self.words, b) for b in BASES]

    def runs(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """Runs of consecutive windows with the same anchor: anchor hash, run hash, text, first window in it, windows.

        A window's anchor is the gram of it with the least hash, the first of
        equals; so equal windows have equal anchors.  The run hash covers all
        words of the run and where the anchor stands in it.
        """
        if len(self.words) < window:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        places = np.uint64(len(self.words) - 1).item().bit_length()
        grams = np.arange(len(self.words) - gram + 1)
        key = mix(self.rolling[0].ranges(grams, gram)) >> np.uint64(places) << np.uint64(places) | grams.astype(np.uint64)
        anchor = (sliding_min(key, window - gram + 1) & np.uint64((1 << places) - 1)).astype(np.int64)
        at = np.flatnonzero(self.of[: len(anchor)] == self.of[window - 1 :])
        anchor = anchor[at]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)])
        n = np.diff(np.append(new, len(at)))
        low, anchor = at[new], anchor[new]
        where = (anchor - low).astype(np.uint64) * np.uint64(BASES[1]) + n.astype(np.uint64) * np.uint64(BASES[0])
        run = mix(self.rolling[0].ranges(low, n + window - 1) ^ mix(where))
        text = self.of[low]
        return mix(self.rolling[1].ranges(anchor, gram)).view(np.int64), run.view(np.int64), text, low - self.start[text], n

    def windows(self, text: np.ndarray, low: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that start at `low` of `text`."""
        at = self.start[text] + low
        return tuple(mix(r.ranges(at, window)).view(np.int64) for r in self.rolling)
