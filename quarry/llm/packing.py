"""Packing of documents into sequences of a fixed token capacity.

Method: pattern packing by non-negative least squares.  Lengths fall into
``classes`` classes (a length counts as its class's upper end, so a pattern
always fits).  All patterns of two or three classes that fill a sequence are
enumerated, repeat counts are fitted to the length histogram by non-negative
least squares (active set) and rounded to what is there.  A pattern's last piece is
the longest that still fits, so that classes cost no room.  What is left is packed
best-fit, longest first, into the room that the patterns leave and into new
sequences.  Patterns are used whole, to a half, to a quarter or not at all,
whichever takes the fewest sequences, so they never cost any.  A document longer than
a sequence is first cut into full pieces.

Scale: texts are tokenised where they are read; only (piece, length, checksum)
rows are written to the shared folder.  The driver sees the histogram, at most
``capacity`` rows, and the plan is a table of ranges whose size depends on the
capacity, not on the data: pieces of one length get ranks 0, 1, 2 ... from counts
for each (input partition, length), so no length, however frequent, is gathered
in one task.

Defined results: a null or empty text is one piece holding the end token alone.
Repeated rows are packed as often as they occur.  An empty table gives no rows.
Extra columns are not carried; join on the id.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._memory import trimmed
from .common import materialize

CAPACITY = 4096
AT_ONCE = 1 << 20
RUN = 256


def _tokenise(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        from ._tokens import tokeniser

        tok, rank, pid = tokeniser(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            size = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts])
            cut = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(size) // AT_ONCE])))
            for a, b in zip(cut, [*cut[1:], len(ids)], strict=True):
                flat, n = tok.encode([t or "" for t in texts[a:b].to_pylist()])
                rows: dict = {k: [] for k in ("id", "piece", "start", "length", "crc", "rank", "ids")}
                at = 0
                for doc, m in zip(ids[a:b], n.tolist(), strict=True):
                    own = np.append(flat[at : at + m], np.int32(end_id)).astype("<u4")
                    at += m
                    for piece, start in enumerate(range(0, m + 1, capacity)):
                        part = own[start : start + capacity]
                        rows["id"].append(doc)
                        rows["piece"].append(piece)
                        rows["start"].append(start)
                        rows["length"].append(len(part))
                        rows["crc"].append(zlib.crc32(part.tobytes()))
                        rows["rank"].append(int(rank[len(part)]))
                        rows["ids"].append(part.astype(np.int32) if keep_ids else None)
                        rank[len(part)] += 1
                kinds = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "crc": pa.int64(), "rank": pa.int64(), "ids": pa.list_(pa.int32())}
                cols = [pa.array(rows[k], t) for k, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(rows["id"]), pa.int32()), *cols], names=["pid", *kinds])

    return run


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with least ``|a x - b|`` by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, ab = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(ab).max(initial=0)))
    for _ in range(rounds):
        grad = ab - gram @ x
        grad[free] = -np.inf
        j = int(np.argmax(grad)) if n else 0
        if not n or grad[j] <= tol:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(gram[np.ix_(at, at)], ab[at], rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 1e-12
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def _patterns(classes: int) -> list[tuple[int, ...]]:
    two = [(a, classes - a) for a in range(classes - 1, (classes - 1) // 2, -1) if a >= classes - a]
    three = [(a, b, classes - a - b) for a in range(classes - 2, 0, -1) for b in range(min(a, classes - a - 1), 0, -1) if b >= classes - a - b >= 1]
    return two + three


def fitted(histogram: dict[int, int], capacity: int, classes: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns and their repeat counts, most frequent first."""
    width, b = capacity / classes, np.zeros(classes)
    for n, c in histogram.items():
        b[int(-(-n // width)) - 1] += c
    b[-1] = 0.0  # those fill a sequence alone
    patterns = [p for p in _patterns(classes) if all(b[c - 1] for c in p)]
    a = np.zeros((classes, len(patterns)))
    for j, p in enumerate(patterns):
        np.add.at(a[:, j], np.array(p) - 1, 1)
    x = nnls(a, b)
    return [(patterns[j], float(x[j])) for j in np.argsort(-x, kind="stable") if x[j] > 0]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = 128) -> tuple[np.ndarray, int]:
    """Ranges (length, first rank, count, first sequence, pieces of it in a sequence, offset), and the number of sequences."""
    repeats = fitted(histogram, capacity, classes)
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best = None
    for share in (1.0, 0.5, 0.25, 0.0):
        rows, sequences = _filled(histogram, [(p, x * share) for p, x in repeats], capacity, classes)
        if best is None or sequences < best[1]:
            best = rows, sequences
        if sequences == least:
            break
    return best


def _filled(histogram: dict[int, int], repeats: list[tuple[tuple[int, ...], float]], capacity: int, classes: int) -> tuple[np.ndarray, int]:
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    taken = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    room: list[list] = [[] for _ in range(capacity + 1)]  # room[r]: runs (first sequence, count) with r tokens free
    some = 0  # bit r: room[r] has runs
    sequences = 0
    rising = sorted(left)  # lengths that are left

    def put(n: int, count: int, first: int, per: int, offset: int) -> None:
        rows.append((n, taken[n], count, first, per, offset))
        taken[n] += count
        left[n] -= count

    def longest(top: int, heads: list[int]) -> int | None:
        """The longest length up to ``top`` that is left beside the heads."""
        for at in range(bisect.bisect_right(rising, top) - 1, -1, -1):
            if left[rising[at]] > heads.count(rising[at]):
                return rising[at]
        return None

    width = capacity / classes
    for p, x in repeats:
        count = round(x)
        while count > 0:  # runs of sequences whose pieces have the same lengths
            heads: list[int] = []
            for k, c in enumerate(p):
                last = k == len(p) - 1
                n = longest(capacity - sum(heads) if last else int(c * width), heads)
                if n is None or n <= (c - 1) * width:  # the class is used up
                    break
                heads.append(n)
            if len(heads) < len(p):
                break
            run = min([count, *(left[n] // heads.count(n) for n in heads)])
            offset = 0
            for n in dict.fromkeys(heads):
                k = heads.count(n)
                put(n, run * k, sequences, k, offset)
                offset += n * k
                if not left[n]:
                    rising.remove(n)
            room[capacity - offset].append((sequences, run))
            some |= 1 << capacity - offset
            sequences += run
            count -= run
    for n in left:  # the rest, longest first, where the least room is left over
        while left[n]:
            fits = some >> n << n
            if fits:
                r = (fits & -fits).bit_length() - 1
                first, count = room[r].pop()
                run = min(count, left[n])
                if run < count:
                    room[r].append((first + run, count - run))
                if not room[r]:
                    some &= ~(1 << r)
                put(n, run, first, 1, capacity - r)
                room[r - n].append((first, run))
                some |= 1 << r - n
                continue
            per = capacity // n
            full = left[n] // per
            if full:
                put(n, full * per, sequences, per, 0)
                room[capacity - per * n].append((sequences, full))
                some |= 1 << capacity - per * n
                sequences += full
            if rest := left[n]:
                put(n, rest, sequences, rest, 0)
                room[capacity - rest * n].append((sequences, 1))
                some |= 1 << capacity - rest * n
                sequences += 1
    return np.array(sorted(rows), np.int64).reshape(-1, 6), sequences


def _place(ranges: np.ndarray):
    step = 1 << 44  # ranks of one length
    first = ranges[:, 0] * step + ranges[:, 1]

    def run(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = ranges[np.searchsorted(first, n * step + rank, side="right") - 1]
            at = rank - r[:, 1]
            names = [c for c in batch.schema.names if c != "rank"]
            new = [pa.array(r[:, 3] + at // r[:, 4]), pa.array(r[:, 5] + at % r[:, 4] * n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names=[*names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, classes: int = 128, keep_ids: bool = True
) -> DataFrame:
    """One row per piece: id, piece, start, length, crc (of the ids), ids (if kept), sequence_id, offset.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can open.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = "pid int, id long, piece int, start long, length long, crc long, rank long, ids array<int>"
    pieces = materialize(src.mapInArrow(trimmed(_tokenise(tokenizer, capacity, end_id, keep_ids), uses="tokens"), schema), "pieces")
    if not keep_ids:
        pieces = pieces.drop("ids")
    counts = materialize(pieces.groupBy("pid", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ranges, _ = plan(histogram, capacity, classes)
    of = lambda n: F.floor(n / RUN)  # noqa: E731  runs of ranks, so that no frequent length meets in one task
    offsets = offsets.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), of(F.col("n") - 1))))
    ranked = pieces.withColumn("run", of(F.col("rank"))).join(offsets.hint("shuffle_hash"), ["pid", "length", "run"])  # grows with the input, so it is not broadcast
    kept = ["id", "piece", "start", "length", "crc", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*kept, (F.col("rank") + F.col("base")).alias("rank"))
    out = "id long, piece int, start long, length long, crc long, " + ("ids array<int>, " if keep_ids else "") + "sequence_id long, offset long"
    return ranked.mapInArrow(_place(ranges), out)
