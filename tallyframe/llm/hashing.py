"""Vectorised rolling hashes over bytes and words (numpy, modulo 2**64)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        b = int(BASES[base])
        inverse = pow(b, -1, 2**64)
        made = []
        for x in (b, inverse):
            a = np.full(size, U(x))
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        have = (made[0], made[1])
        if size <= 1 << 20:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def forget_powers() -> None:
    """Lets go of the kept tables, for tasks that have no use for them and need the worker's memory."""
    _POWERS.clear()


def prefix(values: np.ndarray, base: int = 0) -> np.ndarray:
    """Prefix sums P with P[i] = sum of values[j] * base**j over j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0], out=out[1:])
    return out


def rolling(values: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Hash of each run of k values; shorter input gives none."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix(values, base)
    return mix((p[k:] - p[:n]) * powers(n, base)[1])


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of up to ``most`` bytes together (a longer item stands alone)."""
    at, total = 0, 0
    for i, s in enumerate(sizes):
        if i > at and total + s > most:
            yield at, i
            at, total = i, 0
        total += s + 1
    if at < len(sizes):
        yield at, len(sizes)


def words_in(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and 64-bit hash of every word of a byte array that ends in white space."""
    space = IS_SPACE[buf]
    change = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = change[0::2], change[1::2]
    p = prefix(BYTE_VALUE[buf])
    h = (p[ends] - p[starts]) * powers(len(buf))[1][starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * BASES[1])


def word_hashes(blobs: list[bytes], most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text in order, and the number of words of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks([len(x) for x in blobs], most):
        starts, _, h = words_in(np.frombuffer(b" ".join(blobs[a:b]) + b" ", np.uint8))
        hashes.append(h)
        edges = np.cumsum([0] + [len(x) + 1 for x in blobs[a:b]])
        counts.append(np.diff(np.searchsorted(starts, edges)))
    return np.concatenate(hashes), np.concatenate(counts)


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best over each run of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[:n], out[rest:rest + n]) if rest else out[:n]
