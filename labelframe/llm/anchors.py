"""Content-defined anchors: positions that equal stretches of bytes share.

Each window of ``length`` bytes has one anchor, the start of that ``gram``-byte string within
it whose hash is smallest (the leftmost of equals).  Equal windows have equal anchors at the
same place, whatever surrounds them.
"""

from __future__ import annotations

import numpy as np

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1  # grams in a window
#: Bytes handled at once; longer texts are cut into overlapping parts.
PART = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_ONE = np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base))
    steps[:1] = _ONE
    return np.multiply.accumulate(steps)


class Hasher:
    """Rolling hashes of byte strings: equal strings have equal hashes wherever they stand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = 2 * len(data) + 1
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _ONE) * self.up[: len(data)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
        """Mixed 64-bit hashes of the ``length`` bytes from each start."""
        if isinstance(starts, slice):
            h = (prefix[length:] - prefix[:-length]) * self.down[: len(prefix) - length]
        else:
            h = (prefix[starts + length] - prefix[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors_of(grams: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The anchor of each window: the place of the smallest of ``span`` neighbouring hashes."""
    n = len(grams)
    key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // span) * span, np.uint64(2**64 - 1))
    padded[:n] = key
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    return (best & np.uint64(0xFFFFFF)).astype(np.int64)
