"""Hashed byte n-gram histograms of texts, vectorised over blocks of texts."""

from __future__ import annotations

import numpy as np

BUCKETS = 8192
ORDERS = (2, 4)
BLOCK = 1 << 20
#: ASCII letters lower-cased, other ASCII bytes as spaces, all else as it is.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def _pieces(raws):
    """Pieces of at most BLOCK bytes, each with its text's index; a long text's pieces overlap by the longest n-gram."""
    for i, raw in enumerate(raws):
        for at in range(0, max(1, len(raw)), BLOCK):
            yield i, raw[max(0, at - max(ORDERS) + 1) : at + BLOCK]


def histograms(raws) -> np.ndarray:
    """For each text (bytes) the share of each bucket among its n-grams, float32 [texts, BUCKETS]."""
    out = np.zeros((len(raws), BUCKETS), np.float32)
    held, size = [], 0

    def flush():
        nonlocal held, size
        if held:
            block = np.frombuffer(b"".join(b"    " + p + b"    " for _, p in held), np.uint8)
            rows = np.repeat(np.arange(len(held), dtype=np.int64), [len(p) + 8 for _, p in held])
            x = _FOLD[block].astype(np.uint32)
            base = rows * BUCKETS
            total = np.zeros(len(held) * BUCKETS, np.float32)
            code, n = x, 1
            while n < max(ORDERS):
                code = (code[:-n] << np.uint32(8 * n)) | x[n:] if n == 1 else (code[:-n] << np.uint32(16)) | code[n:]
                n *= 2
                if n in ORDERS:
                    at = ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)
                    total += np.bincount(base[: len(at)] + at, minlength=len(total)).astype(np.float32)
            np.add.at(out, np.array([i for i, _ in held]), total.reshape(len(held), BUCKETS))
        held, size = [], 0

    for i, p in _pieces(raws):
        held.append((i, p))
        size += len(p)
        if size >= BLOCK or len(held) >= 256:
            flush()
    flush()
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def groups(texts, limit: int = BLOCK, rows: int = 256):
    """Slices (start, stop) of an Arrow string array of about ``limit`` bytes and at most ``rows`` texts."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size >= limit or b + 1 - a >= rows:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def raw(texts) -> list[bytes]:
    return [memoryview(t.as_buffer()).tobytes() if t.is_valid else b"" for t in texts]
