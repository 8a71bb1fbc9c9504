"""Exact ranks and row spaces of many small 0/1 matrices at once, by elimination modulo primes.

The rank over the rationals is the greatest rank modulo any prime, and is reached unless the prime divides every minor
that shows it. A minor of n columns is at most (n + 1)^((n + 1) / 2) / 2^n (Hadamard), so that fewer primes than its bits
allow can divide it: with one prime more than that, the greatest rank is the exact one. No tolerance is needed. Matrices
of one shape are eliminated together, a column of all of them at a time.
"""

from __future__ import annotations

from functools import cache
from math import ceil, isqrt, log2

import numpy as np

#: Primes lie just below this, so that products of two residues fit 64 bits.
BELOW = 2**31


@cache
def prime(k: int) -> int:
    """The k-th prime below BELOW, from 0."""
    at = BELOW - 1 if k == 0 else prime(k - 1) - 2
    while any(at % d == 0 for d in range(3, isqrt(at) + 1, 2)):
        at -= 2
    return at


def primes_for(columns: int) -> int:
    """How many primes settle the rank of a 0/1 matrix of so many columns."""
    bits = max(0.0, (columns + 1) / 2 * log2(columns + 1) - columns)
    return ceil(bits / 30) + 1  # each prime has more than 30 bits


def _inverse(x: np.ndarray, p: int) -> np.ndarray:
    """x^(p - 2) modulo p."""
    out, power, e = np.ones_like(x), x % p, p - 2
    while e:
        if e & 1:
            out = out * power % p
        power = power * power % p
        e >>= 1
    return out


def eliminated(a: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced row echelon forms modulo p of matrices (batch, rows, columns), their ranks, and the row of each pivot column (-1)."""
    a = a.astype(np.int64) % p
    batch, rows, columns = a.shape
    rank, at, row_of = np.zeros(batch, np.int64), np.arange(rows), np.full((batch, columns), -1)
    for c in range(columns):
        free = (a[:, :, c] != 0) & (at >= rank[:, None])
        which = np.flatnonzero(free.any(1))
        if not len(which):
            continue
        to, pivot = rank[which], free[which].argmax(1)
        row = a[which, pivot] * _inverse(a[which, pivot, c], p)[:, None] % p
        a[which, pivot] = a[which, to]
        a[which, to] = row
        factor = a[which, :, c]
        factor[np.arange(len(which)), to] = 0
        a[which] = (a[which] - factor[:, :, None] * row[:, None, :]) % p
        row_of[which, c] = to
        rank[which] += 1
    return a, rank, row_of


def ranks(matrices: list[np.ndarray]) -> list[int]:
    """Ranks of 0/1 matrices of any shapes."""
    out = [0] * len(matrices)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, m in enumerate(matrices):
        shapes.setdefault(m.shape, []).append(k)
    for (rows, columns), which in shapes.items():
        if rows and columns:
            a = np.stack([matrices[k] for k in which])
            best = np.max([eliminated(a, prime(i))[1] for i in range(primes_for(columns))], axis=0)
            for k, r in zip(which, best.tolist(), strict=True):
                out[k] = r
    return out


class RowSpace:
    """The row space of one 0/1 matrix: an echelon form per prime, made once and used for any number of vectors."""

    def __init__(self, matrix: np.ndarray):
        self.forms = []
        for k in range(primes_for(matrix.shape[1])):
            a, rank, row_of = eliminated(matrix[None], prime(k))
            pivots = np.flatnonzero(row_of[0] >= 0)
            self.forms.append((prime(k), int(rank[0]), pivots, a[0][row_of[0][pivots]]))
        self.rank = max(f[1] for f in self.forms)

    def holds(self, vectors: np.ndarray) -> np.ndarray:
        """Which rows of `vectors` are rational combinations of the matrix's rows."""
        best = np.full(len(vectors), self.rank)
        for p, rank, pivots, basis in self.forms:
            rest = vectors.astype(np.int64) % p
            for c, row in zip(pivots, basis, strict=True):
                rest = (rest - rest[:, c, None] * row) % p
            best = np.maximum(best, rank + rest.any(1))
        return best == self.rank
