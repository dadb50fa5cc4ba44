"""Array kernels over the code points of many texts at once.

Texts are laid end to end in one array of code points, so that character
classes, token bounds and substring hashes cost a few vector passes instead of
a Python step per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
#: Unicode White_Space, a fixed set.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1]) + 1
            table[a:b] = kind
    table[_WHITE] = SPACE
    return table


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """True for letters and digits of any script."""
    table = class_table()
    return (table == LETTER) | (table == NUMBER)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the offset of each text (and the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together (a longer text is a range of its own)."""
    first = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield first, i
            first, total = i, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


class Hashes:
    """Hashes of any substrings of one code point array, equal for equal substrings."""

    def __init__(self, a: np.ndarray):
        self.n = len(a)
        up, _ = _power(self.n + 1)
        x = (a.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F)
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(32)
        x *= up[: self.n]
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _power(self.n + 1)
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k characters; empty if there are fewer."""
        if self.n < k:
            return np.zeros(0, U64)
        _, down = _power(self.n + 1)
        return mix((self.sums[k:] - self.sums[:-k]) * down[: self.n - k + 1] + U64(k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1]) + 1
    return np.cumsum(out)
