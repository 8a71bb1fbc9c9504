"""Hashed word shingles and improved consistent weighted sampling, vectorised over one text at a time (numpy)."""

from __future__ import annotations

import numpy as np

M64 = (1 << 64) - 1
#: Odd multipliers of the rolling word hash and of the places in a shingle.
BASE = 0x9E3779B97F4A7C15
PLACES = np.array([pow(BASE, 2 * k + 3, 1 << 64) for k in range(64)], np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, for i < n."""
    have = len(_powers["up"])
    if have < n:
        size = max(n, 2 * have)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word (run of bytes above the space, lower case) in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = raw > 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def shingles(text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `width` words, sorted, and how often each occurs; a shorter text is one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h, np.zeros(0)
    width = min(width, len(h))
    s = sum(h[k : len(h) - width + 1 + k] * PLACES[k] for k in range(width))
    s, n = np.unique(mixed(s), return_counts=True)
    return s, n.astype(np.float64)


def gamma_quantiles(levels: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of equal steps, by bisection."""
    u = (np.arange(levels) + 0.5) / levels
    lo, hi = np.zeros(levels), np.full(levels, 60.0)
    for _ in range(60):
        x = (lo + hi) / 2
        above = 1 - (1 + x) * np.exp(-x) > u
        lo, hi = np.where(above, lo, x), np.where(above, x, hi)
    return (lo + hi) / 2


class Sampler:
    """Improved consistent weighted sampling: `n` samples (shingle, quantised log weight), hashed to 64 bits."""

    def __init__(self, n: int, seed: int = 1):
        q = gamma_quantiles()
        self.r, self.log_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.seeds = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))
        self.n = n

    def samples(self, keys: np.ndarray, weights: np.ndarray, block: int = 256) -> np.ndarray:
        best, at, step = np.full(self.n, np.inf, np.float32), np.zeros(self.n, np.int64), np.zeros(self.n, np.float32)
        log_w, low, cols = np.log(weights).astype(np.float32), np.uint64(0xFFFF), np.arange(self.n)
        for k in range(0, len(keys), block):
            x = mixed(keys[k : k + block, None] ^ self.seeds[None])
            r = self.r[x & low]
            beta = ((x >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w[k : k + block, None] / r + beta)
            a = self.log_c[(x >> np.uint64(16)) & low] - r * (t - beta) - r
            i = a.argmin(0)
            v = a[i, cols]
            better = v < best
            best = np.where(better, v, best)
            at = np.where(better, i + k, at)
            step = np.where(better, t[i, cols], step)
        return mixed(keys[at] ^ mixed(step.astype(np.int64).astype(np.uint64) + self.seeds))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two sorted weighted sets; 1 for two empty ones."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))
