"""Word shingles of texts as 64-bit hashes, vectorised over a block of texts.

Words are runs of bytes other than space and 9..13, compared as they are.  A text
with fewer words than a shingle takes has one shingle, all its words; a text
without words has none.
"""

from __future__ import annotations

import numpy as np

from . import _triggers
from ._triggers import mix

BLOCK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_F = np.random.default_rng(99).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of one block."""
    inside = ~_SPACE[block]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    lo, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return _triggers.between(_triggers.prefix(block), lo, end), lo


def word_hashes(raws) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (bytes), and how many each text has."""
    hashes, counts = [], np.zeros(len(raws), np.int64)
    parts, owners, size = [], [], 0

    def flush():
        nonlocal parts, owners, size
        if parts:
            block = np.frombuffer(b" ".join(parts), np.uint8)
            h, lo = _words(block)
            ends = np.cumsum([len(p) + 1 for p in parts])
            np.add.at(counts, np.array(owners)[np.searchsorted(ends, lo, side="right")], 1)
            hashes.append(h)
        parts, owners, size = [], [], 0

    for i, raw in enumerate(raws):
        at = 0
        while at < len(raw):
            end = at + BLOCK
            if end < len(raw):  # cut a long text at white space
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
            piece = raw[at:end]
            parts.append(piece)
            owners.append(i)
            size += len(piece)
            at = end
            if size >= BLOCK:
                flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def shingles(raws, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: (text index, hash, count), sorted by text and hash."""
    words, counts = word_hashes(raws)
    total = len(words)
    text = np.repeat(np.arange(len(raws)), counts)
    if not total:
        return text, words, counts[:0]
    w = mix(words.copy())
    held = np.minimum(counts, n)  # words of a text's shingles
    start = np.cumsum(counts) - counts
    left = counts[text] - (np.arange(total) - start[text])  # words from here to the text's end
    first = left >= held[text]
    at = np.flatnonzero(first)
    h = held[text[at]].astype(np.uint64) * _F[63]
    for j in range(n):
        inside = j < held[text[at]]
        h[inside] += w[at[inside] + j] * _F[j]
    h = mix(h)
    owner = text[at]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    spot = np.flatnonzero(new)
    return owner[spot], h[spot], np.diff(np.concatenate([spot, [len(h)]]))


def similarity(a, x, b, y) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted hashes and their weights).

    Sum over common elements d of ``1 / sum_e max(x_e / x_d, y_e / y_d)``; equal to
    plain Jaccard similarity where all weights are alike.
    """
    if not len(a) or not len(b):
        return 0.0
    if x.max() == x.min() and y.max() == y.min():  # plain Jaccard
        n = len(np.intersect1d(a, b, assume_unique=True))
        return n / (len(a) + len(b) - n)
    both = np.union1d(a, b)
    u, v = np.zeros(len(both)), np.zeros(len(both))
    u[np.searchsorted(both, a)] = x
    v[np.searchsorted(both, b)] = y
    common = (u > 0) & (v > 0)
    if not common.any():
        return 0.0
    ratio = np.divide(u, v, out=np.full(len(u), np.inf), where=v > 0)
    order = np.argsort(ratio)
    r, us, vs = ratio[order], u[order], v[order]
    above = np.concatenate([np.cumsum(us[::-1])[::-1], [0.0]])  # u of elements from a place on
    below = np.concatenate([[0.0], np.cumsum(vs)])  # v of elements before a place
    at = np.searchsorted(r, ratio[common])
    return float(np.sum(1.0 / (above[at] / u[common] + below[at] / v[common])))
