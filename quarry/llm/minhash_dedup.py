"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Every distinct 5-word shingle of a document is an element whose weight is its
count.  Elements arrive as Poisson processes with their weight as rate; each
arrival falls on one register and the earliest arrival names the register's
element; a process ends once it is later than all registers of its document
(early termination).  Two documents agree on a register with a probability that
equals their probability Jaccard similarity.  Bands of registers make buckets,
and pairs from buckets are verified on the exact weighted shingles of the texts.

At the default 32 bands of 5 registers a pair at similarity 0.8 shares no bucket
with a probability below 1e-5.  Nothing else is lost: two members of a bucket end
in one class unless every pair between their classes was found too unlike.

Scale: documents of equal text are folded first (combined map-side) and named by
a number of their own.  Signatures are taken where texts are read; only bucket
keys are shuffled for all documents.  Buckets of the same members count once.  A
bucket is dealt out in blocks bounded in members and in bytes.  In a block pairs
never become rows: members are first joined along a spanning tree of the pairs that
share most buckets, then pairs that are still apart are compared in the first band
that brings them together, by counting common shingles on bit sets; what leaves it
is one edge for a member.  After the edges are joined to components, a bucket of
several blocks that still holds two components is settled between its blocks in the
same way; only for such buckets do rows grow by the number of blocks.

Defined results: null, empty and word-free texts, and rows with a null id, link
with nothing (class = own id, kept).  Texts of fewer than five words have one
shingle.  The class id is the smallest id of the class; rows that repeat an id
and a text are kept alike; rows that repeat an id with another text are judged by
their own text.  Extra columns are not carried; join on the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _buckets, _shingles
from ._grams import groups, raw
from ._memory import trimmed
from ._runs import runs
from ._triggers import mix
from ._unions import roots
from .common import discard, materialize
from .components import components


def registers(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """ProbMinHash: the element that arrives first at each of ``m`` registers of each text (0 where a text has none)."""
    time = np.full(texts * m, np.inf)
    name = np.zeros(texts * m, np.uint64)
    rate = weight.astype(np.float64)
    now = np.zeros(len(element))
    k = 0
    while len(element):
        k += 1
        u = mix(element + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        now = now - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = owner * m + (mix(u ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, slot, now)
        won = time[slot] == now
        name[slot[won]] = element[won]
        alive = now < time.reshape(texts, m).max(1)[owner]
        owner, element, rate, now = owner[alive], element[alive], rate[alive], now[alive]
    return name.reshape(texts, m)


def bucket_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band of registers."""
    factors = np.random.default_rng(5).integers(1, 2**63, size=rows, dtype=np.uint64) | np.uint64(1)
    mixed = (mix(sig.copy()).reshape(len(sig), bands, rows) * factors).sum(2)
    return _buckets.tagged(mix(mixed + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))


def _signatures(n: int, bands: int, rows: int):
    def keys(raws) -> np.ndarray:
        owner, h, count = _shingles.shingles(raws, n)
        return bucket_keys(registers(owner, h, count, len(raws), bands * rows), bands, rows)

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in groups(texts, _shingles.BLOCK, 4096):
                raws = raw(texts[a:b])
                array = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(keys(raws).ravel()))
                size = pa.array([len(r) for r in raws], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("fold")[a:b], size, array], names=["id", "fold", "bytes", "keys"])

    return run


def _keys(column, bands: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), bands)


def tree(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A maximum spanning tree over members: an edge weighs as much as the buckets its ends share."""
    n = len(keys)
    best, near, out = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
    child, at = np.empty(n - 1, np.int64), 0
    for k in range(n - 1):
        out[at] = True
        same = (keys == keys[at]).sum(1)
        closer = (same > best) & ~out
        best[closer], near[closer] = same[closer], at
        at = int(np.argmax(np.where(out, -2, best)))
        child[k] = at
    return child, near[child]


def common(ids: np.ndarray, start: np.ndarray, able: np.ndarray, left: np.ndarray, right: np.ndarray, room: int = 16 << 20) -> np.ndarray:
    """How many elements the able pairs of left and right members share (member k holds ``ids[start[k]:start[k + 1]]``).

    Members are bit sets over a stretch of the elements at a time, so that they take at most ``room`` bytes.
    """
    n, shared = len(start) - 1, np.zeros(able.shape, np.int32)
    owner = np.repeat(np.arange(n), np.diff(start))
    seen = np.bincount(ids)
    rank = np.cumsum(seen > 1) - 1  # elements of one member are in no pair
    ok = seen[ids] > 1
    owner, bit = owner[ok], rank[ids[ok]]
    width = max(64, room // n // 8 * 64)
    order = np.argsort(bit // width, kind="stable")
    owner, bit = owner[order], bit[order]
    stretch = bit // width
    busy = np.flatnonzero(able.any(1))
    edges = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1], [True]])) if len(stretch) else np.zeros(1, int)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = bit[lo:hi] - stretch[lo] * width
        sets = np.zeros((n, int(at.max()) // 64 + 1), np.uint64)
        np.add.at(sets, (owner[lo:hi], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))  # a member holds an element once
        for i in busy:
            to = np.flatnonzero(able[i])
            shared[i, to] += np.bitwise_count(sets[left[i]] & sets[right[to]]).sum(1, dtype=np.int32)
    return shared


def alike(contents: list, able: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The able pairs (places in left and right) whose similarity reaches the threshold.

    ``contents`` are (hashes, counts).  Texts without a repeated shingle are compared by their numbers of common
    shingles.  A pair with any other text is at most as alike as the share of one's weight that the other holds
    too; where that leaves the matter open, the pair is computed.
    """
    size = np.array([len(h) for h, _ in contents])
    start = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate([h for h, _ in contents]), return_inverse=True)[1]
    plain = np.array([len(c) == 0 or c.max() == c.min() for _, c in contents])
    even = plain[left][:, None] & plain[right][None]
    shared = common(ids, start, able & even, left, right)
    union = size[left][:, None] + size[right][None] - shared
    hit = able & even & (shared >= threshold * union) & (union > 0)
    odd = able & ~even
    for side, other, open_ in ((left, right, odd), (right, left, odd.T)):
        for i in np.flatnonzero(open_.any(1) & ~plain[side]):
            c = contents[side[i]][1]
            weight = np.zeros(len(ids) and int(ids.max()) + 1)
            weight[ids[start[side[i]] : start[side[i] + 1]]] = c
            held = np.concatenate([[0.0], np.cumsum(weight[ids])])
            held = held[start[other + 1]] - held[start[other]]
            open_[i] &= held >= (threshold - 1e-9) * c.sum()
    for i, j in zip(*np.nonzero(odd), strict=True):
        hit[i, j] = _shingles.similarity(*contents[left[i]], *contents[right[j]]) >= threshold
    return np.nonzero(hit)


def _contents(texts, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles and their counts of each text."""
    raws = raw(texts)
    owner, h, count = _shingles.shingles(raws, n)
    cut = np.searchsorted(owner, np.arange(len(raws) + 1))
    return [(h[i:j], count[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _batches(batches, keys, limit: int = 1 << 20, rows: int = 1024):
    """Lists of runs of about ``limit`` bytes of text, with the texts of all of them."""
    held, size, many = [], 0, 0
    for batch in runs(batches, keys):
        held.append(batch)
        size += batch.column("text").nbytes
        many += len(batch)
        if size >= limit or many >= rows:
            yield held, pa.chunked_array([x.column("text") for x in held]).combine_chunks()
            held, size, many = [], 0, 0
    if held:
        yield held, pa.chunked_array([x.column("text") for x in held]).combine_chunks()


def _edges(found):
    out, held = [], 0
    for u, v in found:
        out.append((u, v))
        held += len(u)
        if held > 50_000 or len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v"])
            out, held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v"])


def _inside(n: int, bands: int, threshold: float):
    """Links inside each block of a bucket: an edge from each member to the smallest member of its component."""

    def block(rep, band, keys, contents):
        near = lambda i, j: _shingles.similarity(*contents[i], *contents[j]) >= threshold
        tied = [(i, j) for i, j in zip(*tree(keys), strict=True) if near(i, j)]
        every = np.arange(len(rep))
        i, j = (np.array(x, np.int64) for x in (zip(*tied, strict=True) if tied else ((), ())))
        root = roots(len(rep), i, j)
        if len(rep) > 2 and root.any():
            able = (root[:, None] != root[None]) & (every[:, None] < every[None])
            for t in range(band):  # met in an earlier band
                able &= keys[:, t][:, None] != keys[:, t][None]
            if able.any():
                x, y = alike(contents, able, every, every, threshold)
                root = roots(len(rep), np.append(i, x), np.append(j, y))
        at = np.flatnonzero(root != every)
        return rep[at], rep[root[at]]

    def found(batches):
        for held, texts in _batches(batches, ("bucket", "own")):
            contents, at = _contents(texts, n), 0
            for batch in held:
                if len(batch) > 1:
                    yield block(batch.column("rep").to_numpy(), batch.column("bucket")[0].as_py() % _buckets.TABLES, _keys(batch.column("keys"), bands), contents[at : at + len(batch)])
                at += len(batch)

    return lambda batches: _edges(found(batches))


def _between(n: int, bands: int, threshold: float):
    """Edges between components that meet between two blocks of a bucket (first: marks members of the first block)."""

    def block(comp, first, band, keys, contents):
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        able = comp[left][:, None] != comp[right][None]
        for t in range(band):  # met in an earlier band
            able &= keys[left, t][:, None] != keys[right, t][None]
        x, y = alike(contents, able, left, right, threshold) if able.any() else (left[:0], left[:0])
        names, node = np.unique(comp, return_inverse=True)
        root = roots(len(names), node[left[x]], node[right[y]])
        at = np.flatnonzero(root != np.arange(len(names)))
        return names[at], names[root[at]]

    def found(batches):
        for held, texts in _batches(batches, ("bucket", "lo", "hi")):
            contents, at = _contents(texts, n), 0
            for batch in held:
                first = batch.column("first").to_numpy(zero_copy_only=False).astype(bool)
                yield block(batch.column("component").to_numpy(), first, batch.column("bucket")[0].as_py() % _buckets.TABLES, _keys(batch.column("keys"), bands), contents[at : at + len(batch)])
                at += len(batch)

    return lambda batches: _edges(found(batches))


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5, block: int = 2048, block_bytes: int = 8 << 20
) -> DataFrame:
    """One row per document: id, fold (digest of the text), class_id and kept."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(text)).alias("fold"), text.alias("text"))
    worded = src.filter(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    signed = materialize(worded.mapInArrow(trimmed(_signatures(words, bands, rows)), "id long, fold binary, bytes long, keys array<long>"), "signatures")
    reps = signed.groupBy("fold").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes"))  # equal texts have equal keys
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "folds")

    light = reps.select("rep", F.explode("keys").alias("bucket"))
    shared = _buckets.members(light)
    held = shared.join(reps.select("rep", "bytes"), "rep")
    parts = held.groupBy("bucket").agg(F.ceil(F.greatest(F.first("size") / block, F.sum("bytes") / block_bytes)).cast("int").alias("parts"))
    members = held.select("bucket", "rep").join(parts, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    members = materialize(members, "members")
    discard(shared)

    wanted = reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "id", "fold", "keys")
    texts = materialize(src.join(wanted, ["id", "fold"]).select("rep", "keys", "text").dropDuplicates(["rep"]), "texts")
    met = members.join(texts, "rep").repartition("bucket", "own").sortWithinPartitions("bucket", "own", "rep")
    labels = components(met.mapInArrow(trimmed(_inside(words, bands, threshold)), "u long, v long"))
    named = reps.select("fold", "rep", "id").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))

    wide = members.filter("parts > 1")
    if not wide.isEmpty():  # buckets of several blocks
        now = wide.join(named.select("rep", "component"), "rep")
        split = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        sides = now.join(split.select("bucket"), "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("own <> other")
        sides = sides.select("bucket", "rep", "component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") < F.col("other")).alias("first"))
        met = sides.join(texts, "rep").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        late = components(met.mapInArrow(trimmed(_between(words, bands, threshold)), "u long, v long"))  # between components
        late = late.select(F.col("node").alias("component"), F.col("component").alias("final"))
        named = named.join(late, "component", "left").withColumn("component", F.coalesce("final", "component"))

    named = materialize(named.select("fold", "id", "component"), "named")
    discard(signed, reps, members, texts)
    least = named.groupBy("component").agg(F.min("id").alias("class_id"))
    out = src.select("id", "fold").join(named.select("fold", "component").join(least, "component"), "fold", "left")
    own = F.when(F.col("id").isNull() | F.col("class_id").isNull(), F.col("id")).otherwise(F.col("class_id"))
    return out.select("id", "fold", own.alias("class_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)))
