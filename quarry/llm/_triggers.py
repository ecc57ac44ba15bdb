"""Content-defined phrases of byte strings: the parsing step of prefix-free parsing.

A 64-bit rolling hash is taken of every ``k`` bytes.  Inside every window of
``span`` bytes the smallest rolling hash (leftmost on ties) is the window's
trigger.  Neighbouring windows with one trigger form a phrase: the bytes from
the first such window's start to the last one's end.  So

* every window of ``span`` bytes lies inside exactly one phrase,
* equal windows have equal triggers at equal places, wherever they stand.

Everything is vectorised over one block of bytes; texts are laid side by side and
no window crosses from one to the next.
"""

from __future__ import annotations

import numpy as np

from . import _memory

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_INV = np.uint64(pow(int(_Q), -1, 2**64))
POS_BITS = np.uint64(24)
_POS = np.uint64((1 << 24) - 1)
_POWERS: dict[str, np.ndarray] = {}
_memory.cached("powers", _POWERS.clear)  # 16 bytes for each byte of the longest block


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place, so that low and high bits are alike."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def rolling(block: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of ``block[i:i + k]`` for every i, by doubling; empty if the block is shorter."""
    n = len(block) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, size, out, done = _TABLE[0][block], 1, None, 0
    r = int(_R)
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:  # out covers the first ``done`` bytes, h the next ``size``
                m = min(len(out), len(h) - done)
                out = out[:m] * np.uint64(pow(r, size, 2**64)) + h[done : done + m]
                done += size
        if size * 2 > k:
            break
        h = h[: len(h) - size] * np.uint64(pow(r, size, 2**64)) + h[size:]
        size *= 2
    return mix(out[:n].copy())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("q", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("q", _Q), ("inv", _Q_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["q"], _POWERS["inv"]


def prefix(block: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`between` hashes any stretch of the block."""
    q, _ = _powers(len(block) + 1)
    s = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_TABLE[1][block] * q[: len(block)], out=s[1:])
    return s


def between(s: np.ndarray, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the stretches ``[lo, end)``, wherever they stand."""
    _, inv = _powers(len(s))
    return mix((s[end] - s[lo]) * inv[lo] + (end - lo).astype(np.uint64) * _R)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    m, size = x, 1
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
    return m


def phrases(block: np.ndarray, ends: np.ndarray, span: int, k: int):
    """Phrases of texts laid side by side (``ends``: where each ends).

    Returns (text index, start in the block, number of windows, trigger hash,
    place of the trigger in the phrase).  Blocks hold at most 2**24 bytes.
    """
    h = rolling(block, k)
    n = len(block) - span + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.empty(0, np.uint64), empty
    at = np.arange(len(h), dtype=np.uint64)
    at |= h & ~_POS
    a = (window_min(at, span - k + 1)[:n] & _POS).astype(np.int32)
    text = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    valid = text[:n] == text[span - 1 : span - 1 + n]
    new = valid.copy()
    new[1:] &= (a[1:] != a[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.concatenate([(a[1:] != a[:-1]) | ~valid[1:], [True]]))
    return text[lo], lo, stop - lo + 1, h[a[lo]], a[lo] - lo
