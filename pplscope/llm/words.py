"""Words of many texts at once, as numpy arrays: hashes, windows and minimisers.

Words are runs of anything but the ASCII blank and control blanks (tab to carriage return).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pplscope.llm.frames import buffers

BYTE_FACTOR, WORD_FACTOR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd factor and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, factor: int):
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            grown = []
            for base in (self.factor, self.inverse):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            if size > 1 << 22:  # a very long text: used once, not kept
                return grown[0][:n], grown[1][:n]
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_bytes, _words = Powers(BYTE_FACTOR), Powers(WORD_FACTOR)


def _totals(values: np.ndarray) -> np.ndarray:
    """Sum of all values before each place, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Words:
    """All words of some texts, end to end: hash of each, and where each text's begin (one more than texts)."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray


def read(texts: pa.Array) -> Words:
    raw, offsets = buffers(texts)
    blank = IS_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], blank[:-1]]) | edge[:-1]
    starts = np.flatnonzero(~blank & before)
    after = np.concatenate([blank[1:], [True]]) | edge[1:]
    ends = np.flatnonzero(~blank & after) + 1
    up, down = _bytes.get(len(raw))
    values = BYTE_VALUE[raw] * up
    total = _totals(values)
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, raw)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` words, those over a text's end included."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _words.get(len(hashes))
    total = _totals(hashes * up)
    return mix((total[length:] - total[:n]) * down[:n])


def whole(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of every window of `length` words inside one text."""
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return np.arange(len(text)) - first[text] + bounds[:-1][text], text


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of every `width` values, in log(width) steps."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = best[step:] < best[: len(best) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        best = np.where(right, best[step:], best[: len(best) - step])
        have += step
    return place


@dataclass
class Pieces:
    """Neighbouring windows that share their minimiser: the anchor, its place, the windows from
    `first` on (counted over all texts), and the text they are in."""

    anchor: np.ndarray
    at: np.ndarray
    first: np.ndarray
    count: np.ndarray
    text: np.ndarray


def pieces(words: Words, length: int, k: int) -> Pieces:
    """Each window of `length` words goes with the smallest of its k-grams, the leftmost of equal ones:
    windows with equal words have equal anchors, in equal places."""
    start, text = whole(words.bounds, length)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Pieces(none.astype(np.uint64), none, none, none, none)
    grams = windows(words.hashes, k)
    at = lowest(grams, length - k + 1)[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    return Pieces(grams[at[first]], at[first], start[first], count, text[first])
