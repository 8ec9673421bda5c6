"""Hashes of token sequences in numpy: words, k-grams, minimizers, contexts."""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random odd 64-bit value for each byte.
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0xD6E8FEB86659FD93)
_UNBASE = U(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0x9FB21C651E98DF25)
    x ^= x >> U(29)
    x *= U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix(v: np.ndarray) -> np.ndarray:
    """Sums of v[i] * base**i before each position: substring hashes come from two of them.

    Modulo 2**64, which tells sequences of up to some hundred values apart; of
    longer ones those of the Thue-Morse kind may agree, so that only what is
    verified afterwards, or short, is compared by these alone.
    """
    out = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * powers(len(v))[0], out=out[1:])
    return out


def span(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of v[a:b] from prefix(v)."""
    inverse = powers(len(sums))[1]
    return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * U(0x9E3779B97F4A7C15))


_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """The first n of a fixed sequence of odd 64-bit values without structure, one a place."""
    global _factors
    if len(_factors) < n:
        _factors = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
        if n > 1 << 20:  # an odd case, not worth keeping
            held, _factors = _factors, _factors[: 1 << 12].copy()
            return held[:n]
    return _factors[:n]


def runs(v: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each v[a:b] of runs that follow each other without overlap, none empty.

    Each place of a run has a factor of its own. Powers of one base, as in
    span(), would give sequences of the Thue-Morse kind one hash modulo 2**64.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    size = ends - starts
    bounds = np.empty(2 * n, np.int64)
    bounds[::2], bounds[1::2] = starts, ends
    place = np.arange(len(v))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(v))))
    most = int(size.max())
    weighed = np.zeros(len(v) + 1, np.uint64)
    np.multiply(v, factors(most)[np.minimum(place, most - 1)], out=weighed[:-1])
    return mix(np.add.reduceat(weighed, bounds)[::2] + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))


#: A prime modulus whose remainders come by shifts, for a second hash of sequences of any length.
_PRIME = U(2**31 - 1)
_PRIME_BASE = 1_103_515_245
_prime_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, up to that value itself."""
    x = (x & _PRIME) + (x >> U(31))
    return (x & _PRIME) + (x >> U(31))


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base, and of its inverse, modulo 2**31 - 1."""
    if len(_prime_powers[0]) < n:
        size = max(n, 1 << 12)
        for i, base in enumerate((_PRIME_BASE, pow(_PRIME_BASE, -1, int(_PRIME)))):
            out = np.ones(1, np.uint64)
            while len(out) < size:  # by doubling
                out = np.r_[out, _rest(out * U(pow(base, len(out), int(_PRIME))))]
            _prime_powers[i] = out[:size]
    return _prime_powers[0][:n], _prime_powers[1][:n]


def prime_prefix(v: np.ndarray) -> np.ndarray:
    """Sums before each position of v[i] * base**i modulo 2**31 - 1, themselves not reduced."""
    out = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(_rest((v >> U(33)) * prime_powers(len(v))[0]), out=out[1:])
    return out


def prime_rest(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1."""
    x = _rest(x)
    return np.where(x == _PRIME, U(0), x)


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of text, and a 64-bit hash of each. Words are runs of bytes other than ASCII white space."""
    b = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_SPACE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    return starts, ends, runs(BYTE[b], starts, ends)


def grams(v: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values of v, by doubling."""
    n = len(v) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, h, size = None, 0, v, 1
    while True:
        if k & size:
            part = h[at : at + n]
            out = part.copy() if out is None else mix(out * U(0xA0761D6478BD642F) + part)
            at += size
        if size * 2 > k:
            return out if k > 1 else mix(out)
        h = mix(h[:-size] * U(0xE7037ED1A0B428DB) + h[size:])
        size *= 2


def _slide(h: np.ndarray, w: int, of) -> np.ndarray:
    """min or max of each w consecutive values."""
    m, size = h, 1
    while size * 2 <= w:
        m = of(m[:-size], m[size:])
        size *= 2
    n = len(h) - w + 1
    return of(m[:n], m[w - size : w - size + n])


def minimizers(v: np.ndarray, ends: np.ndarray, k: int, window: int, block: int = 1 << 15) -> np.ndarray:
    """Positions of the k-grams that are least in some window of a sequence.

    v holds sequences one after another, ends where each ends. Every `window`
    consecutive values of one sequence hold a selected k-gram, which depends on
    those values only; equal windows so select the same ones. All of equal
    least hashes are selected. Work goes block by block, to stay in the cache.
    """
    w = window - k + 1
    chosen = np.zeros(len(v), bool)
    # windows that no sequence holds: those that begin less than a window before an end
    begins = np.r_[0, ends[:-1]]
    none = np.zeros(len(v), bool)
    tails = np.maximum(ends - window + 1, begins)
    if len(v):
        none[spread(tails, ends - tails)] = True
    for a in range(0, len(v) - window + 1, block):
        h = orders(v[a : a + block + window - 1], k)
        least = np.zeros(len(h) + w - 1, np.uint32)
        m = _slide(h, w, np.minimum)
        m[none[a : a + len(m)]] = 0
        least[w - 1 : len(h)] = m
        chosen[a : a + len(h)] |= _slide(least, w, np.maximum) == h
    return np.flatnonzero(chosen)


def orders(v: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash above 0 of each k consecutive values of v, by which they are ordered."""
    sums, n = prefix(v), len(v) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    x = sums[k:] - sums[:n]
    x *= powers(n)[1]
    x ^= x >> U(32)
    x *= U(0x9FB21C651E98DF25)
    x >>= U(32)
    return x.astype(np.uint32) | np.uint32(1)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ...: the places of runs, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
