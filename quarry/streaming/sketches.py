"""Stateful sketches on a stream: Bloom filter, Flajolet-Martin and reservoir.

State is kept per shard.  A value always goes to the shard of its hash, so a Bloom
filter of many shards answers as well as one, and no shard is one task's
bottleneck; a reservoir keeps one state per shard and is merged when read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import coefficients, optimal_hash_count

#: Modulus of the stream's hashes; fixed value.
WIDE = (1 << 61) - 1


def _hashes(value: str, family, m: int) -> list[int]:
    # a digest first: texts read as numbers modulo a prime agree in all hashes for as short texts as "31040" and "1013"
    x = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") % WIDE
    return [(a * x + b) % WIDE % m for _, a, b in family]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(seed: int, shard: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in [0, 1) for each row number, by the seed, the shard and the number alone."""
    key = _mixed(_mixed(np.array([seed], np.uint64)) + np.uint64(shard) + np.uint64(1))
    at = n.astype(np.uint64) * np.uint64(2)
    return tuple((_mixed(key + (at + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / float(1 << 53) for k in (0, 1))


def sharded(stream: DataFrame, value: str, shards: int) -> DataFrame:
    return stream.select(value).withColumn("shard", F.pmod(F.xxhash64(value), F.lit(shards)).cast("int"))


def bloom_stream(stream: DataFrame, value: str, bits: int = 69_997, elements: int = 10_000, shards: int = 1) -> DataFrame:
    """(shard, value, seen): whether an earlier row set all the value's bits; the bit vector is the state."""
    family = coefficients(optimal_hash_count(bits, elements))

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        field = bytearray(state.get[0]) if state.exists else bytearray(-(-bits // 8))
        out = []
        for pdf in frames:
            for v in pdf[value]:
                at = _hashes(str(v), family, bits)
                out.append((int(key[0]), str(v), all(field[p >> 3] >> (p & 7) & 1 for p in at)))
                for p in at:
                    field[p >> 3] |= 1 << (p & 7)
        state.update((bytes(field),))
        yield pd.DataFrame(out, columns=["shard", "value", "seen"])

    rows = sharded(stream, value, shards).groupBy("shard")
    return rows.applyInPandasWithState(step, "shard int, value string, seen boolean", "field binary", "append", "NoTimeout")


def reservoir_stream(stream: DataFrame, value: str, size: int = 100, every: int = 100, slots=(0, 20, 40, 60, 80), seed: int = 553, shards: int = 1) -> DataFrame:
    """(shard, seqnum, slot, value): what the slots hold after each ``every`` rows of a shard."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        held, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for pdf in frames:
            values, at = pdf[value].to_numpy(), n + np.arange(len(pdf))
            u, w = _draws(seed, shard, at)
            taken = np.flatnonzero((at < size) | (u * (at + 1) < size))
            out, k = [], 0
            for last in [*np.flatnonzero((at + 1) % every == 0).tolist(), len(pdf)]:
                while k < len(taken) and taken[k] <= last:
                    i = taken[k]
                    if at[i] < size:
                        held.append(str(values[i]))
                    else:
                        held[int(w[i] * size)] = str(values[i])
                    k += 1
                if last < len(pdf):
                    out += [(shard, int(at[last]) + 1, s, held[s]) for s in slots if s < len(held)]
            n += len(pdf)
            yield pd.DataFrame(out, columns=["shard", "seqnum", "slot", "value"])
        state.update((held, n))

    rows = sharded(stream, value, shards).groupBy("shard")
    return rows.applyInPandasWithState(step, "shard int, seqnum long, slot int, value string", "held array<string>, n long", "append", "NoTimeout")


def counts_stream(stream: DataFrame, key: str) -> DataFrame:
    """Running counts by key: the engine's own state, in update mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def micro_batches(stream: DataFrame, value: str, checkpoint: str, hashes: int = 100, splits: int = 5, skip: int = 0) -> list[dict]:
    """Flajolet-Martin estimates and exact counts of each micro-batch; the first ``skip`` batches only warm up."""
    from quarry.operators.sketches import flajolet_martin

    out: list[dict] = []

    def each(batch: DataFrame, number: int) -> None:
        if number >= skip:
            rows = flajolet_martin(batch.select(F.lit(number).alias("batch"), F.col(value).cast("string").alias("value")), "batch", "value", hashes, splits=splits)
            out.extend(r.asDict() for r in rows.collect())  # one row a batch

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out
