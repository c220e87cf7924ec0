"""Rabin-Karp fingerprints of many slices of one array, by prefix polynomials.

A prefix sum of symbol * base^position gives the polynomial of any slice by one
subtraction and one multiplication with an inverse power.  Two hashes: modulo
2^64 (mixed afterwards), and modulo the prime 2^31 - 1 as an independent check.
"""

from __future__ import annotations

import numpy as np

BASE64, BASE31, PRIME = 0x9E3779B97F4A7C15, 1_103_515_245, 2**31 - 1


class Powers:
    """Powers of both bases and of their inverses, as many as were asked for."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> "Powers":
        if n > self.size:
            self.size = n = max(n, 1 << 16)
            self.up, self.down = (self._wrapped(b, n) for b in (BASE64, pow(BASE64, -1, 2**64)))
            self.up31, self.down31 = (self._modular(b, n) for b in (BASE31, pow(BASE31, -1, PRIME)))
        return self

    @staticmethod
    def _wrapped(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    @staticmethod
    def _modular(base: int, n: int) -> np.ndarray:
        """By doubling: the powers known so far times the next one."""
        out, known = np.ones(n, np.uint64), 1
        while known < n:
            step = min(known, n - known)
            out[known:known + step] = out[:step] * np.uint64(pow(base, known, PRIME)) % np.uint64(PRIME)
            known += step
        return out


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Fingerprints of slices of ``symbols`` (below 2^32)."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        powers = POWERS.upto(n + 1)
        plus = symbols.astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(plus * powers.up[:n], out=self.sums[1:])
        self.sums31 = np.zeros(n + 1, np.uint64)      # terms are below 2^31, so 2^33 of them don't overflow
        np.cumsum(plus * powers.up31[:n] % np.uint64(PRIME), out=self.sums31[1:])

    def fingerprints(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64 bits for each slice, not mixed."""
        return (self.sums[ends] - self.sums[starts]) * POWERS.down[starts]

    def checks(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """31 bits for each slice."""
        return (self.sums31[ends] - self.sums31[starts]) % np.uint64(PRIME) * POWERS.down31[starts] % np.uint64(PRIME)
