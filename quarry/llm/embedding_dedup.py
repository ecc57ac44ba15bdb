"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into
cells of ``width``; ``hashes`` cells make one table's bucket key, and ``tables``
such keys are taken of each vector.  At cosine 0.98 (distance 0.2) the default
12 x 40 keys of width 1.5 miss a pair with a probability below 1e-5.

Scale: bit-equal vectors of a label are first folded into one with a count, so
copies cost nothing.  Only (bucket, number) is shuffled for all vectors; buckets
with one member end there, and buckets of the same members count once.  The rest
are compared in blocks of at most ``block_bytes`` of doubles a side: a bucket of any
size is dealt out over pairs of blocks, never gathered in one task.  Vectors travel
as they are stored, without their keys, which a block takes again for vectors with
a hit.  Inside a block the comparison is a matrix product in stripes; what leaves it
is a link count and one spanning edge for each vector, not the pairs.  A pair is
counted only in the first table that brings it together, so counts are exact for
all pairs found, with no shuffle of pairs.  Comparisons in a bucket of n different
vectors grow with n squared, and its rows with n times its number of blocks.

Defined results: every row is a vector, also where rows share an id; ``n_links``
counts the other rows that it links with, and its component is the smallest id among
the rows that links reach.  Vectors that are null, of length 0, zero, or hold null or
non-finite components, and rows with a null label or id link with nothing: 0 links,
component = own id, kept.  Vectors of unlike dimensions never link.  Extra columns
pass through; input columns named like output columns give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _buckets
from ._runs import runs
from ._triggers import mix
from ._unions import roots
from .common import discard, materialize
from .components import components


def usable(vector: Column) -> Column:
    """Vectors that can link: a positive finite norm and no null component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first so that no norm over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Keys:
    """Bucket keys of unit vectors, one for each table."""

    def __init__(self, tables: int, hashes: int, width: float, seed: int):
        self.tables, self.hashes, self.width, self.seed = tables, hashes, width, seed
        self.factors = np.random.default_rng(seed + 1).integers(1, 2**63, size=hashes, dtype=np.uint64) | np.uint64(1)
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        n, dim = x.shape
        if dim not in self.planes:
            rng = np.random.default_rng([self.seed, dim])
            self.planes[dim] = rng.standard_normal((dim, self.tables * self.hashes)), rng.uniform(0, self.width, self.tables * self.hashes)
        a, b = self.planes[dim]
        cell = np.floor((x @ a + b) / self.width).astype(np.int64).view(np.uint64).reshape(n, self.tables, self.hashes)
        key = (cell * self.factors).sum(2) + np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return _buckets.tagged(mix(mix(key) + label.view(np.uint64)[:, None] + np.uint64(dim)).view(np.int64))


def _by_dimension(vectors):
    """(rows, unit vectors) of each dimension, of an Arrow column of lists."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, lambda part, dim=dim: _unit(flat[(ends[part] - dim)[:, None] + np.arange(dim)].astype(np.float64))


def _hash(keys: Keys):
    def run(batches):
        for batch in batches:
            label = batch.column("label_hash").to_numpy()
            out = np.empty((len(batch), keys.tables), np.int64)
            for rows, unit in _by_dimension(batch.column("vector")):
                for part in np.array_split(rows, -(-len(rows) // 2048)):
                    out[part] = keys.of(unit(part), label[part])
            array = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * keys.tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), array], names=["rep", "keys"])

    return run


def _compare(keys: Keys, threshold: float, stripe: int = 512):
    def block(table: int, first: np.ndarray, label, copies, unit):
        """Link counts and roots of the members; first: marks members of the first block (all, where a block meets itself)."""
        whole, every = bool(first.all()), np.arange(len(first))
        a = np.flatnonzero(first)
        b = a if whole else np.flatnonzero(~first)
        right, n, root = unit[b].T, np.zeros(len(first), np.int64), every
        own = np.zeros((len(first), table), np.int64)
        known = np.zeros(len(first), bool)
        for at in range(0, len(a) if len(b) else 0, stripe):
            part = a[at : at + stripe]
            hit = unit[part] @ right >= threshold
            if whole:
                hit &= part[:, None] < b[None]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            i, j = part[i], b[j]
            new = np.unique(np.concatenate([i, j]))
            new = new[~known[new]]
            if table and len(new):
                own[new], known[new] = keys.of(unit[new], label[new])[:, :table], True
            fresh = label[i] == label[j]
            for t in range(table):  # met in an earlier table
                fresh &= own[i, t] != own[j, t]
            i, j = i[fresh], j[fresh]
            n += (np.bincount(i, copies[j], len(n)) + np.bincount(j, copies[i], len(n))).astype(np.int64)
            root = roots(len(n), np.concatenate([i, every]), np.concatenate([j, root]))
        return n, root

    def run(batches):
        out, held = [], 0

        def flush():
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["rep", "n", "root"])

        for batch in runs(batches, ("bucket", "lo", "hi")):
            first = batch.column("first").to_numpy(zero_copy_only=False).astype(bool)
            rep, copies, label = (batch.column(c).to_numpy() for c in ("rep", "copies", "label_hash"))
            for rows, unit in _by_dimension(batch.column("vector")):
                n, root = block(batch.column("bucket")[0].as_py() % _buckets.TABLES, first[rows], label[rows], copies[rows], unit(rows))
                at = np.flatnonzero(n)
                out.append((rep[rows][at], n[at], rep[rows][root[at]]))
                held += len(at)
            if held > 50_000 or len(out) > 20_000:
                yield flush()
                held = 0
        if out:
            yield flush()

    return run


def link(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = 0.98,
    tables: int = 40,
    hashes: int = 12,
    width: float = 1.5,
    block_bytes: int = 2 << 20,
    seed: int = 7,
) -> DataFrame:
    """Adds n_links, component_id and kept to every row."""
    names = [c for c in vectors.columns if c.lower() not in ("n_links", "component_id", "kept")]
    src = vectors.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    col = {c: f"c{i}" for i, c in enumerate(names)}
    own_id = F.col(col[id_col]).cast("long")
    label = F.col(col[label_col]) if label_col else F.lit(0)
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    vector = F.col(col[vector_col]).cast("array<double>")
    able = F.coalesce(label.isNotNull() & own_id.isNotNull() & usable(vector), F.lit(False))
    rows = src.withColumn("able", able).withColumn("label", label).withColumn("label_hash", F.xxhash64(label))
    plain = F.transform(vector, lambda x: x + F.lit(0.0)).cast("array<float>" if single else "array<double>")  # one zero
    rows = rows.withColumn("vector", F.when(F.col("able"), plain))
    rows = rows.withColumn("fold", F.xxhash64("label_hash", "vector"))
    on = ["fold", "label", "vector"]
    copies = rows.filter("able").groupBy(*on).agg(F.min(own_id).alias("id"), F.first("label_hash").alias("label_hash"), F.count("*").alias("copies"))
    held = materialize(copies.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    keys = Keys(tables, hashes, width, seed)
    units = materialize(held.select("rep", "label_hash", "vector").mapInArrow(_hash(keys), "rep long, keys array<long>"), "units")

    widest = held.agg(F.max(F.size("vector"))).first()[0] or 1
    found_buckets = _buckets.members(units.select("rep", F.explode("keys").alias("bucket")))
    members = found_buckets.withColumn("parts", F.ceil(F.col("size") * (8 * widest) / block_bytes).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("rep", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("first"))
    met = dealt.join(held.select("rep", "copies", "label_hash", "vector"), "rep").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    found = materialize(met.mapInArrow(_compare(keys, threshold), "rep long, n long, root long"), "links")

    discard(units, found_buckets)
    joined = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    folds = held.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = folds.groupBy("component").agg(F.min("id").alias("component_id"))
    folds = folds.join(least, "component").select(*on, "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    out = rows.join(folds, on, "left")
    component = F.coalesce("component_id", own_id)
    return out.select(
        *[F.col(c).alias(n) for n, c in col.items()],
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == own_id, F.lit(True)).alias("kept"),
    )
