"""Words and shingles of texts as 64-bit hashes, the numpy helpers that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash

_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def _table(is_word) -> bytes:
    """Byte table that lower-cases A-Z and blanks what is not part of a word."""
    lowered = (_UPPER.get(c, c) for c in range(256))
    return bytes(c if is_word(c) else 0x20 for c in lowered)


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text, byte by byte (UTF-8 bytes above 0x7F are word bytes).
ALNUM = _table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)
#: Words ``[^\x20\x09-\x0D]+`` of the lower-cased text.
NON_SPACE = _table(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D)


def word_list(text: str | None, table: bytes) -> list[bytes]:
    """Words of a text in UTF-8; a null text has none.

    ``bytes.split()`` cuts at the six ASCII spaces, all of which are blanks in both tables.
    """
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd 64-bit factors of the bytes (a blank counts nothing) and of their place in a word.
_BYTES = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[0x20] = 0
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def word_hashes(text: str | None, table: bytes) -> np.ndarray:
    """64-bit hash of each word of a text, in order, without making the words."""
    global _powers
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(table) if text else b" ", np.uint8)
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(begins):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(begins, len(data)))
    if sizes.max() > len(_powers):
        _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(255, int(sizes.max())), _PLACE)])
    place = np.arange(begins[0], len(data)) - np.repeat(begins, sizes)
    return mix(np.add.reduceat(_BYTES[data[begins[0]:]] * _powers[place], begins - begins[0]))


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (shift, multiply)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter, non-empty sequence is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    step = np.uint64(0x9E3779B97F4A7C15)
    width = min(width, n)
    z = hashes[: n - width + 1].copy()
    for k in range(1, width):
        z = z * step + hashes[k : n - width + 1 + k]
    z = np.sort(mix(z * step + np.uint64(width)))
    return z[np.r_[True, z[1:] != z[:-1]]]
