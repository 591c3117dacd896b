"""Word-shingle sets of whole texts, vectorised over a batch: hashed words, hashed runs of five, distinct per text."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: The bytes that separate words (the blank, and 0x09 to 0x0D).
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[32, *range(9, 14)]] = True
_ODD = 0x9E3779B97F4A7C13
_VALUES = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = [np.uint64(x) for x in np.random.default_rng(2).integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)]


def stirred(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(2 * n, _ODD, np.uint64)
            base[0] = 1
            self.up = np.cumprod(base, dtype=np.uint64)
            base[1:] = pow(_ODD, -1, 1 << 64)
            self.down = np.cumprod(base, dtype=np.uint64)
        return self.up, self.down


def word_hashes(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts (A-Z lower-cased), and how many words each text has."""
    raw = [(t or "").encode("utf-8").lower() for t in texts]
    joined = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    gap = SEPARATORS[joined]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = powers.of(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_VALUES[joined] * up[: len(joined)], out=sums[1:])
    hashes = stirred((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([1, *[len(r) + 1 for r in raw]])
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: list[str | None], powers: Powers) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of five words; of all its words where they are fewer; none without words."""
    words, counts = word_hashes(texts, powers)
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    runs = stirred(sum((padded[j : len(words) + j] * _PLACE[j] for j in range(1, WORDS)), padded[: len(words)] * _PLACE[0]))
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(runs[at : at + n - WORDS + 1]))
        elif n:
            few = sum((words[at + j : at + j + 1] * _PLACE[j] for j in range(1, n)), words[at : at + 1] * _PLACE[0])
            out.append(stirred(few + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
