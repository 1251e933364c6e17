"""Words of texts as numpy arrays: places, hashes, hashes of shingles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Words are runs of digits, letters and everything beyond ASCII; A-Z are lower-cased.
_KEPT = np.zeros(256, np.uint8)
for _code in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _KEPT[_code] = _code
for _code in range(0x41, 0x5B):
    _KEPT[_code] = _code + 0x20

# Words are runs of anything but space and the codes 9 to 13; A-Z are lower-cased, a zero byte counts as a letter.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[0x41:0x5B] += 0x20
SPACED[[0x20, *range(9, 14)]] = 0
SPACED[0] = 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = {}


def _power(base: np.uint64, size: int) -> np.ndarray:
    """``base ** 0 .. size - 1`` modulo 2 ** 64."""
    found = _powers.get(int(base))
    if found is None or len(found) < size:
        steps = np.full(max(size, 1 << 20), base, np.uint64)
        steps[0] = 1
        found = np.cumprod(steps, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[int(base)] = found
    return found[:size]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


@dataclass
class Words:
    """Words of several texts behind each other.

    ``first`` has, per text, the index of its first word, and one past the last at the end.
    """

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self, begin: int, count: int) -> bytes:
        """``count`` words from ``begin``, space-joined."""
        data = self.data
        return b" ".join([data[s:e] for s, e in zip(
            self.starts[begin:begin + count].tolist(), self.ends[begin:begin + count].tolist())])


def find_words(texts: list[bytes], kept: np.ndarray = _KEPT) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    low = kept[data]
    inside = np.concatenate([[0], (low > 0).view(np.int8)])
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return Words(low.tobytes(), starts, ends, np.searchsorted(starts, edges))


def word_hashes(words: Words) -> np.ndarray:
    low = np.frombuffer(words.data, np.uint8).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * _power(_BASE, len(low)), dtype=np.uint64)])
    return mixed((sums[words.ends] - sums[words.starts]) * _power(_INVERSE, len(low) + 1)[words.starts])


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words from each word on; the last ``size - 1`` places are left out.

    Places whose shingle runs into the next text are not left out.
    """
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, np.uint64)
    for j in range(size):
        out = out * _BASE + hashes[j:j + count]
    return mixed(out ^ np.uint64(size))
