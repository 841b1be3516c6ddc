"""Hashed word shingles of one text, with numpy over its UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=_U)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(int(_P), -1, 2**64))
_STEP = _RNG.integers(1, 2**63, SHINGLE, dtype=_U) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(n, base)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words are runs of other bytes than space and 0x09-0x0D."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    up, down = _grown(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the 5-word shingles; fewer words give one hash of all of them, none an empty set."""
    w = words(text or "")
    if not len(w):
        return np.empty(0, np.int64)
    if len(w) < SHINGLE:
        h = np.array([len(w)], _U)
        for x in w:
            h = _mixed(h * _P + x)
    else:
        n = len(w) - SHINGLE + 1
        h = np.full(n, _U(SHINGLE))
        for k in range(SHINGLE):
            h = h + w[k : k + n] * _STEP[k]
        h = _mixed(h)
    h = np.sort((h >> _U(1)).astype(np.int64))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def set_key(tokens: np.ndarray) -> bytes | None:
    """16 bytes that identify a set; none for the empty one."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
