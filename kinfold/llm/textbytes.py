"""Vectorised text features over UTF-8 bytes: words, substring hashes and word shingles.

All functions work on one packed buffer for many texts, so the cost per text is a few
numpy passes over its bytes. Hashes are 64-bit; equal input gives equal hashes in every
process (nothing depends on Python's hash seed).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_LANES = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))

#: Bytes that end a word when words are split at white space.
SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[list(b" \t\n\r\x0b\x0c")] = False

#: Bytes of words made of letters, digits and any non-ASCII character.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _LANES[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _LANES[1]
    return h ^ (h >> np.uint64(31))


def slices(texts: Sequence[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def pack(texts: Sequence[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer with a newline after each text, and where each text starts. Null is empty."""
    raw = [b"" if t is None else (t.lower() if lower else t).encode("utf-8", "replace") for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), np.cumsum(lens) - lens


def words(buf: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes in ``table``."""
    inside = table[buf].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return ws, we, np.searchsorted(starts, ws, side="right") - 1


class Spans:
    """Hashes of any byte range in constant time, from prefix sums of a polynomial mod 2**64."""

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        base = np.full(n, _BASE, np.uint64)
        base[0] = 1
        inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self._inverse = np.multiply.accumulate(inverse)
        self._sums = np.zeros(n, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(base)[:-1], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start])


def shingles(texts: Sequence[str | None], table: np.ndarray = SPACE_SEPARATED, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` lower-case words, and the bounds of each text's own hashes.

    A text of 1 to k-1 words has one shingle of all its words; one without words has none.
    Hashes of a text stand in the order of its words, repeats included: text i owns
    ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    n = len(texts)
    buf, starts = pack(texts)
    ws, we, wd = words(buf, starts, table)
    count = np.bincount(wd, minlength=n)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(made)])
    if not len(ws):
        return np.zeros(0, np.uint64), bounds
    h = Spans(buf).hash(ws, we)
    first = np.cumsum(count) - count
    # The word each shingle starts at, in order of texts.
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first, made)
    size = np.minimum(count, k)[wd[at]]
    out = size.astype(np.uint64) * _LANES[-1]
    for j in range(k):
        lane = mix(h[np.minimum(at + j, len(h) - 1)] + np.uint64((j + 1) * int(_LANES[2]) % (1 << 64)))
        out = out * _LANES[3] + np.where(j < size, lane, np.uint64(0))
    return mix(out), bounds
