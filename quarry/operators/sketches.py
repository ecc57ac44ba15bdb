"""Sketches and samples over an ordered stream of values, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import family, optimal_hash_count, text_to_int_mod, trailing_zeros, universal_hash


def positions(df: DataFrame, value: Column, hashes: int, bits: int) -> DataFrame:
    """One row for each (input row, hash): ``j`` and the bit ``position``."""
    rows = df.withColumn("_x", text_to_int_mod(value.cast("string")))
    return rows.select("*", F.inline(family(hashes))).withColumn("position", universal_hash(F.col("_x"), F.col("a"), F.col("b"), bits)).drop("_x", "a", "b")


def bloom_seen(stream: DataFrame, seq: str, value: str, bits: int = 69_997, hashes: int | None = None, elements: int | None = None) -> DataFrame:
    """Each row with ``seen``: every bit of its value was set by an earlier row.

    A bit's first setter is a grouped minimum, so the filter is one join and no state
    is carried from row to row.
    """
    hashes = hashes or optimal_hash_count(bits, elements or stream.count())
    values = stream.groupBy(value).agg(F.min(seq).alias("_first"))  # only a value's first row can set bits
    at = positions(values, F.col(value), hashes, bits)
    setters = at.groupBy("position").agg(F.min("_first").alias("_set"))
    ready = at.join(setters, "position").groupBy(value).agg(F.max("_set").alias("_ready"))
    return stream.join(ready, value, "left").withColumn("seen", F.coalesce(F.col("_ready") < F.col(seq), F.lit(False))).drop("_ready")


def seen_ratios(seen: DataFrame, seq: str, value: str, batch: str) -> DataFrame:
    """Per batch: share of distinct values judged seen, and the true false-positive rate among values never inserted before."""
    first = Window.partitionBy(value)
    rows = seen.withColumn("_new", F.min(seq).over(first) == F.col(seq))
    by = rows.groupBy(batch, value).agg(F.min(F.struct(seq, "seen", "_new")).alias("r"))
    return by.groupBy(batch).agg(
        F.count("*").alias("n_distinct"),
        F.avg(F.col("r.seen").cast("double")).alias("seen_ratio"),
        F.coalesce(F.avg(F.when(F.col("r._new"), F.col("r.seen").cast("double"))), F.lit(0.0)).alias("false_positive_rate"),
    )


def flajolet_martin(stream: DataFrame, batch: str, value: str, hashes: int = 100, buckets: int = 300, splits: int = 5, zero: int = 6) -> DataFrame:
    """Per batch: exact distinct count and the estimate (median over groups of mean of ``2 ** max trailing zeros``)."""
    distinct = stream.select(batch, value).filter(F.col(value).isNotNull()).distinct()
    at = positions(distinct, F.col(value), hashes, buckets)
    longest = at.groupBy(batch, "j").agg(F.max(trailing_zeros(F.col("position"), zero)).alias("r"))
    size = -(-hashes // splits)
    means = longest.groupBy(batch, F.floor(F.col("j") / size).alias("g")).agg(F.avg(F.pow(F.lit(2.0), F.col("r"))).alias("mean"))
    estimate = means.groupBy(batch).agg(F.median("mean").alias("estimate"))
    return distinct.groupBy(batch).agg(F.count("*").alias("n_distinct")).join(estimate, batch)


def hll(stream: DataFrame, batch: str, value: str, error: float = 0.02) -> DataFrame:
    return stream.groupBy(batch).agg(F.approx_count_distinct(value, error).alias("estimate"))


def reservoir(stream: DataFrame, seq: str, size: int = 100, seed: int = 553) -> DataFrame:
    """A uniform sample of ``size`` rows: smallest seeded hashes of the ordinal (a bounded top-k, no full sort)."""
    order = F.md5(F.concat(F.col(seq).cast("string"), F.lit(f"-{seed}")))
    return stream.orderBy(order, seq).limit(size)


def reservoir_history(stream: DataFrame, seq: str, value: str, size: int = 100, seed: int = 553, every: int = 100, slots: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """What slots of a replacing reservoir hold after each ``every`` rows.

    Row n (from 0) below ``size`` takes slot n; a later one is kept with probability
    size / (n + 1) in a slot by a second seeded hash.  A slot holds its last taker, so
    each report is a last value over the slot's rows: the history of a few slots.
    """
    unit = lambda tag: F.pmod(F.xxhash64(F.col(seq), F.lit(seed), F.lit(tag)), F.lit(1 << 30)) / float(1 << 30)
    n = F.col(seq)
    slot = F.when(n < size, n).when(unit(1) < F.lit(size) / (n + 1), F.floor(unit(2) * size))
    taken = stream.withColumn("slot", slot.cast("int")).filter(F.col("slot").isin(*slots))
    report = F.floor(n / every)
    last = taken.groupBy(report.alias("report"), "slot").agg(F.max_by(value, seq).alias("taker"))
    reports = stream.select(report.alias("report")).groupBy("report").agg(F.count("*").alias("_n")).filter(F.col("_n") == every)
    grid = reports.select("report", F.explode(F.array(*[F.lit(s) for s in slots])).alias("slot"))
    held = F.last("taker", ignorenulls=True).over(Window.partitionBy("slot").orderBy("report"))
    rows = grid.join(last, ["report", "slot"], "left").withColumn("value", held)
    wide = rows.groupBy("report").pivot("slot", list(slots)).agg(F.first("value"))
    return wide.select(((F.col("report") + 1) * every).alias("seqnum"), *[F.col(str(s)).alias(f"{s}_id") for s in slots])
