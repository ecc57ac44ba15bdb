"""Runs of equal keys in a sorted stream of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, keys):
    """Yields one Arrow batch for each run of equal integer keys, also where a run spans batches."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        edge = np.any([c[1:] != c[:-1] for c in cols], axis=0) if len(batch) > 1 else np.empty(0, bool)
        cuts = np.flatnonzero(np.concatenate([[True], edge, [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[a]) for c in cols)
            if key != last and held:
                yield joined(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield joined(held)


def joined(batches):
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
