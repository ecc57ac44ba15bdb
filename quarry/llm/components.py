"""Connected components by alternating large-star and small-star steps on DataFrames.

Each step is a combinable minimum for a node and a join back; rounds needed grow
with the logarithm of the component size.  Edges and labels never leave the
cluster, each round is written to the shared folder (so lineage stays short and
executors may be lost), and the edges of hubs are dealt out evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Rows (u, v) with u's least neighbour m.

    Nodes with more than a thousandth of the edges, of which there are at most
    2000, are met by broadcast, and their rows are then dealt out evenly.
    """
    hubs = least.filter(F.col("k") > max(1000, edges // 1000)).select("u", F.col("m").alias("hub"))
    rows = rows.join(F.broadcast(hubs), "u", "left")
    spread = -1 - F.pmod(F.xxhash64("v"), F.lit(1 << 16))  # no node has such a number
    rows = rows.withColumn("at", F.when(F.col("hub").isNull(), F.col("u")).otherwise(spread))
    met = rows.join(least.withColumnRenamed("u", "at"), "at", "left")
    return met.select("u", "v", F.coalesce("hub", F.when(F.col("k") > 0, F.col("m"))).alias("m"))  # k is read, so that both joins share one exchange


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).withColumn("m", F.least("u", "m"))
    return _with_least(both.filter("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(down: DataFrame, n: int) -> DataFrame:
    """``down``: edges from a node u to a smaller one v, repeats allowed."""
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    moved = _with_least(down, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _step(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The written edges and their digest, taken in the same pass."""
    seen = Observation()
    digest = F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")
    out = materialize(edges.observe(seen, *digest), "edges")
    return out, seen.get


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of longs from 0, any direction, repeats and loops allowed; gives (node, component).

    The component is the smallest node that can be reached.  Nodes without an
    edge to another node are not listed.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, last = _step(down)
    for _ in range(rounds):
        if not last["n"]:
            break
        new, this = _step(_small(_large(now, last["n"]), last["n"]))
        discard(now)
        now = new
        if this == last:  # only stars around each component's smallest node are left
            break
        last = this
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)
