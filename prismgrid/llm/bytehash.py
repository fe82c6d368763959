"""Hashes of many spans of one byte array at once, by prefix sums of two polynomials."""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse modulo 2**64; and a prime with a base, for the second polynomial.
BASE = 0x9E3779B97F4A7C15
PRIME, PRIME_BASE = (1 << 31) - 1, 1_284_865_837
#: Powers a worker keeps; those of a longer text are made for it alone.
KEPT_POWERS = 1 << 21

_powers: list[np.ndarray] = []


def _prime_powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo ``PRIME``, by doubling."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        more = out[: min(size, n - size)] * np.uint64(pow(base, size, PRIME)) % np.uint64(PRIME)
        out[size : size + len(more)] = more
        size *= 2
    return out


def _grown(n: int) -> list[np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    made += [_prime_powers(base, n) for base in (PRIME_BASE, pow(PRIME_BASE, -1, PRIME))]
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (a bijection of 64-bit integers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of ``raw[start:stop]`` for each span; equal bytes have equal hashes wherever they stand.

    A polynomial modulo 2**64 alone has strings that collide whatever its base (Thue-Morse words); a second one
    modulo a prime is mixed in, for which they differ.
    """
    up, down, prime_up, prime_down = _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    values = raw.astype(np.uint64) + np.uint64(1)
    np.cumsum(values * up[: len(raw)], out=sums[1:])
    first = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
    # values are below 2**64, so they are reduced before products; sums of fewer than 2**33 terms stay below 2**64
    np.cumsum(values % np.uint64(PRIME) * prime_up[: len(raw)] % np.uint64(PRIME), out=sums[1:])
    second = (sums[stops] - sums[starts]) % np.uint64(PRIME) * prime_down[starts] % np.uint64(PRIME)
    return mix(first ^ mix(second + np.uint64(0x632BE59BD9B4E019)))
