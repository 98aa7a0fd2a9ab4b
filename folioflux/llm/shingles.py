"""64-bit hashes of a text's words and word shingles, vectorised over bytes."""

from __future__ import annotations

import numpy as np

#: Words of a shingle, and the similarity from which texts are near duplicates.
WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Bytes of a text that are hashed at once.
PIECE = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each run of bytes other than space and \\x09-\\x0D, A-Z lower-cased."""
    data = data.lower()
    found, begin = [], 0
    while begin < len(data):
        end = begin + PIECE
        while end < len(data) and not _SPACE[data[end]]:  # no word is cut
            end += 1
        a = np.frombuffer(data, np.uint8, min(end, len(data)) - begin, begin)
        begin = end
        edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _powers(len(a) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * power[: len(a)], dtype=np.uint64)))
        found.append(mixed((total[ends] - total[starts]) * inverse[starts]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; of the whole sequence if it is shorter; empty without words."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    k = min(WORDS, len(w))
    total = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        total += w[j : len(w) - k + 1 + j] * _PLACE[j]
    return np.unique(mixed(total + np.uint64(k)))


def fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes and its size."""
    with np.errstate(over="ignore"):
        h = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(hashes)) * _PLACE[0]
    return int(mixed(np.array([h], np.uint64)).view(np.int64)[0])
