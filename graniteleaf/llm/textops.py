"""Words and shingles of many texts at once, on the bytes, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text that are worked on at once.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together; a longer text stands alone."""
    at = size = 0
    for end, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield at, end
            at, size = end, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words (runs without ASCII white space) of some texts: 64-bit hashes in order, and each text's range of them."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # one blank after each text
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        word = ~_SPACE[data]
        edge = np.diff(np.concatenate(([False], word)).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _power(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.offset = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.data = data

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each text's runs of `width` words, and offsets. A shorter text has one shingle of all its words, an empty one a fixed one."""
        n = np.diff(self.offset)
        count = np.maximum(n - width + 1, 1)
        offset = np.concatenate(([0], np.cumsum(count)))
        first = np.repeat(self.offset[:-1] - offset[:-1], count) + np.arange(offset[-1])
        room = np.concatenate((self.hash, np.zeros(width, np.uint64)))
        length = np.repeat(np.minimum(n, width), count)
        out = np.zeros(len(first), np.uint64)
        for k in range(width):
            own = room[first + k]
            out = mix(out * np.uint64(3) + np.where(length > k, own, np.uint64(0)) + np.uint64(k + 1))
        return out, offset
