"""Numpy helpers that run inside Spark tasks: words, shingles and rolling windows of a batch of texts as hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that one call works on; longer texts are worked on alone and whole.
CHUNK = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept between calls while short."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK * 2), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= CHUNK * 4:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(units: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of units[start:end] for each span."""
    n = len(units)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, n + 1)[start])


class Words:
    """The runs of [a-z0-9] of the lower-cased texts: ``hashes`` and byte spans, ``doc`` of each word."""

    _IS_WORD = np.zeros(256, dtype=bool)
    _IS_WORD[[*range(48, 58), *range(97, 123)]] = True

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        self.data = b" ".join([b"", *parts, b""])
        units = np.frombuffer(self.data, dtype=np.uint8)
        inside = self._IS_WORD[units]
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # begins and ends with a blank
        self.start, self.end = turns[::2], turns[1::2]
        self.hashes = span_hashes(units, self.start, self.end)
        first = np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1]
        self.doc = np.searchsorted(first, self.start, side="right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(len(parts) + 1))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the runs of ``width`` consecutive words of one text, the text of each, and the index of its first word."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self.hashes[:n].copy()
        for k in range(1, width):
            h = h * _BASE + self.hashes[k : k + n]
        whole = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return mix(h[whole]), self.doc[whole], whole


def chunks(texts: list[str | None]) -> Iterator[slice]:
    """Slices of the texts of about CHUNK characters."""
    since, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHUNK:
            yield slice(since, i + 1)
            since, size = i + 1, 0
    if since < len(texts):
        yield slice(since, len(texts))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    have = 1
    out = x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])
    return out


def seeds(n: int, stream: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(stream)) | np.uint64(1)
