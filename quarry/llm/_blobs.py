"""Columns of numpy arrays packed into compressed binary values.

Shuffling one value for a task and bucket, instead of a row for an item, keeps a
shuffle near the size of its information and spends no JVM time on items.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of any lengths and kinds; bytes of numbers are stored plane by plane, which compresses better."""
    c = zstandard.ZstdCompressor(level=level)
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes()
        body = c.compress(raw)
        kind = a.dtype.str.encode()
        parts.append(struct.pack("<BII", len(kind), len(a), len(body)) + kind + body)
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    out, at = [], 1
    for _ in range(blob[0]):
        n_kind, n, size = struct.unpack_from("<BII", blob, at)
        at += struct.calcsize("<BII")
        kind = np.dtype(blob[at : at + n_kind].decode())
        at += n_kind
        raw = np.frombuffer(d.decompress(blob[at : at + size], max_output_size=max(1, n * kind.itemsize)), np.uint8)
        at += size
        out.append(raw.reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if kind.itemsize > 1 else raw.view(kind))
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest unsigned type (or as they are, if negative)."""
    if len(a) == 0 or a.min() < 0:
        return a
    top = int(a.max())
    for t in (np.uint8, np.uint16, np.uint32):
        if top <= np.iinfo(t).max:
            return a.astype(t)
    return a
