"""64-bit hashes of words and word windows, as numpy arrays."""

from __future__ import annotations

import functools

import numpy as np

KEPT_WORDS = 400_000
#: Odd multipliers of the window polynomial and the mixers (fixed values: stored hashes depend on them).
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """Hash of each word; those seen are kept, up to KEPT_WORDS."""

    def __init__(self) -> None:
        super().__init__()
        import xxhash

        self.of = xxhash.xxh3_64_intdigest

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        got = self[word] = self.of(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        return got

    def array(self, words: list[str] | list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well-spread bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words, by its first word's place."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have = hashes.copy(), 1
    # polynomials of 2, 4, 8, ... words by doubling, then the rest word by word
    while have * 2 <= length:
        power = np.uint64(pow(int(STEP), have, 1 << 64))
        out = out[: len(out) - have] * power + out[have:]
        have *= 2
    while have < length:
        out = out[:-1] * STEP + hashes[have:]
        have += 1
    return mixed(out)
