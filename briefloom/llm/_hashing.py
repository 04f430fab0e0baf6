"""Vectorised Rabin-Karp hashes over the code points of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

#: Odd multiplier of the polynomial hash, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each, kept between calls."""
    for k, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[k]) < n:
            p = _powers[k]
            step = np.uint64(pow(base, len(p), 1 << 64))
            _powers[k] = np.concatenate([p, p * step])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes add up to ``most`` at most, or of one larger item."""
    a = total = 0
    for k, n in enumerate(sizes):
        if k > a and total + n > most:
            yield a, k
            a, total = k, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


class Prefix:
    """Prefix hashes of a sequence of numbers; the hash of any window is one subtraction away."""

    def __init__(self, symbols: np.ndarray, seed: int = 0x632BE59BD9B4E019):
        self.n = len(symbols)
        with np.errstate(over="ignore"):
            p, self.inverse = _powers_to(self.n + 1)
            self.sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(seed)) * p[: self.n], dtype=np.uint64, out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all windows of the given width, by start."""
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: self.n - width + 1]) if self.n >= width else np.zeros(0, np.uint64)

    def at(self, starts: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts])


def minimisers(values: np.ndarray, span: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Places that hold the least value of some ``span`` consecutive places, the rightmost of equal ones: any
    ``span`` consecutive places (of one owner) hold one, and which they are depends on these places alone."""
    n = len(values)
    if n < span:
        return np.zeros(0, np.int64)
    key = (values & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    least, width = key, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    if owner is not None:
        least = least[owner[: n - span + 1] == owner[span - 1 :]]
    return np.unique((np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64))


@cache
def letters_and_digits() -> np.ndarray:
    """For each code point whether it is a letter or a digit of any script."""
    return np.fromiter((chr(n).isalnum() for n in range(0x110000)), bool, 0x110000)


@cache
def latin_and_digits() -> np.ndarray:
    """For each code point whether it is one of a-z and 0-9."""
    out = np.zeros(0x110000, bool)
    out[[ord(x) for x in "abcdefghijklmnopqrstuvwxyz0123456789"]] = True
    return out


def word_hashes(texts: Sequence[str], inside: np.ndarray, deleted: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and the number of words of each.

    Words are maximal runs of the code points that ``inside`` marks, after lower-casing and leaving out the deleted ones.
    """
    low = [x.lower() for x in texts]
    symbols = codepoints("".join(low))
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    if deleted:
        keep = np.ones(len(symbols), bool)
        for x in deleted:
            keep &= symbols != x
        ends = np.r_[0, np.cumsum(keep)][ends]
        symbols = symbols[keep]
    hit = inside[symbols]
    first, last = hit.copy(), hit.copy()
    edges = ends[(ends > 0) & (ends < len(hit))]
    first[1:] &= ~hit[:-1]
    first[edges] = hit[edges]
    last[:-1] &= ~hit[1:]
    last[edges - 1] = hit[edges - 1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    return Prefix(symbols).at(starts, np.flatnonzero(last) + 1 - starts), counts


def runs_of(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text, the text of each and its first word's place among all words."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
    return Prefix(hashes).at(at, width), owner[at], at
