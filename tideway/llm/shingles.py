"""Words and word windows of byte texts as 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text).  bytes.split() cuts at exactly the
    six characters that end a word."""
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    hashed = xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(w) for ws in split for w in ws), np.uint64, int(sizes.sum())), sizes


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, over all texts on end: the last k - 1 places of a text are not windows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(MULTIPLIER) + words[j : j + n]
    return mixed(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text: with fewer words the whole sequence as one, without words none."""
    words, sizes = words_hashed(texts)
    every = windows(words, k)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(every[at : at + n - k + 1]))
        elif n:
            short = words[at : at + n]
            out.append(mixed(windows(short, n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
