"""Numpy hashes over bytes: substrings by prefix sums, words, and sliding minima."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as needed."""

    def __init__(self, base: int = _ODD):
        self.base, self.inverse_base = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < n:
                more = min(done, n - done)
                out[done : done + more] = out[:more] * np.uint64(step)
                done, step = done + more, step * step & _MASK
        return out

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = self._row(self.base, size), self._row(self.inverse_base, size)
        return self.up, self.down


_POWERS = Powers()
_LETTERS = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64)


class Substrings:
    """Hashes of any substrings of ``data`` (bytes), or of any runs of ``data`` (uint64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _POWERS.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_LETTERS[data] if data.dtype == np.uint8 else data) * up[:n], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[first]) * self.down[first])

    def each(self, length: int) -> np.ndarray:
        """The hash of the substring of this length from each place on."""
        n = max(0, len(self.sums) - length)
        with np.errstate(over="ignore"):
            return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, in two passes over blocks."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[:n], from_left[width - 1 : width - 1 + n])


#: Bytes of words, lower-cased: digits, ASCII letters and everything beyond ASCII.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTES[0x80:] = np.arange(0x80, 0x100)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, text number and hash of each word of the texts that begin ``at``."""
    lower = WORD_BYTES[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = lower != 0
    first = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    starts = at[:-1][np.diff(at) > 0]
    first[starts] = inside[1:-1][starts]
    ends = at[1:][np.diff(at) > 0] - 1
    end[ends] = inside[1:-1][ends]
    first, end = np.flatnonzero(first), np.flatnonzero(end) + 1
    text = np.searchsorted(at, first, "right") - 1
    return first, end, text, Substrings(lower).of(first, end)
