"""Hashes of many pieces of one buffer at once."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes that are hashed at a time.
STEP = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return self.up, self.down


POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def piece_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buffer[start:end] for pieces in ascending order; equal bytes have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + STEP, "right")))
        part = buffer[low : int(ends[to - 1])]
        up, down = POWERS.get(len(part) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTERS[part] * up[: len(part)])))
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(BASE) + hashes[i : i + n]
    return mixed(total)


def least(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of `size` values, by doubling."""
    done, out = 1, values
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        done += step
    return out


def among(values: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Which values are among the wanted ones (sorted; none for None)."""
    if wanted is None or not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values
