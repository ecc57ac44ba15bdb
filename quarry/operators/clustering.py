"""Incremental clustering over summarised sets (discard, compression, retained).

Points are (point_id, features).  Each round's points are compared with the
summaries as they stand at the round's start, so the result does not depend on
the order of points.  Summaries are a few numbers a cluster; points stay
distributed.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import mahalanobis
from quarry.sources.scratch import cut


def cluster_stats(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, total, squares): count, and per-dimension sums of values and of squares."""
    long = points.select(cluster, F.posexplode("features").alias("dim", "x"))
    dims = long.groupBy(cluster, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    wide = dims.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return wide.select(F.col(cluster).alias("cluster"), "n", F.transform("d", lambda x: x["s"]).alias("total"), F.transform("d", lambda x: x["q"]).alias("squares"))


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Summaries of the same cluster added up."""
    long = a.unionByName(b).select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "v"))
    dims = long.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.total").alias("s"), F.sum("v.squares").alias("q"))
    wide = dims.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return wide.select("cluster", "n", F.transform("d", lambda x: x["s"]).alias("total"), F.transform("d", lambda x: x["q"]).alias("squares"))


def nearest(points: DataFrame, stats: DataFrame) -> DataFrame:
    """(point_id, features, near, distance) to the nearest summary; summaries ride along as one small array."""
    table = stats.agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "total", "squares"))).alias("stats"))  # a row a cluster
    far = points.join(F.broadcast(table))
    each = F.transform("stats", lambda s: F.struct(mahalanobis(F.col("features"), s["n"], s["total"], s["squares"]).alias("distance"), s["cluster"].alias("near")))
    best = far.withColumn("best", F.array_min(each)).drop("stats")
    return best.select("point_id", "features", F.col("best.near").alias("near"), F.col("best.distance").alias("distance"))


def kmeans(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    rows = points.withColumn("_v", array_to_vector("features"))
    model = KMeans(k=k, featuresCol="_v", predictionCol="cluster", seed=seed, maxIter=20).fit(rows)
    return model.transform(rows).select("point_id", "features", F.col("cluster").cast("long").alias("cluster"))


def chunks(points: DataFrame, n: int = 5, seed: int = 1) -> DataFrame:
    """A chunk number by a seeded hash of the id."""
    return points.withColumn("chunk", F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(n)).cast("int"))


def _split(points: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(clustered, singles) of k-means with at most as many clusters as points."""
    n = points.count()
    if n <= 1 or k < 1:
        return points.withColumn("cluster", F.lit(0).cast("long")).limit(0), points
    made = cut(kmeans(points, min(k, n), seed), "kmeans")
    size = made.groupBy("cluster").agg(F.count("*").alias("n"))
    both = made.join(size, "cluster")
    return both.filter("n > 1").drop("n"), both.filter("n = 1").select("point_id", "features")


def bfr(points: DataFrame, k: int, rounds: int = 5, seed: int = 1, factor: int = 5) -> tuple[DataFrame, DataFrame]:
    """(assignment, log): (point_id, cluster) with -1 for outliers, and per round n_ds, n_cs_clusters, n_cs, n_rs."""
    spark = points.sparkSession
    dealt = cut(chunks(points.select("point_id", "features"), rounds, seed), "points")
    d = dealt.select(F.size("features").alias("d")).first()
    limit = 2 * float(d["d"] if d else 1) ** 0.5
    log, next_cs = [], 0

    first = dealt.filter("chunk = 0").select("point_id", "features")
    body, rs = _split(first, factor * k, seed)
    ds = cut(kmeans(body.select("point_id", "features"), min(k, max(2, body.count())), seed), "ds") if not body.isEmpty() else body
    ds_stats = cut(cluster_stats(ds), "stats")
    ds_points = ds.select("point_id", "cluster")

    def compress(rs: DataFrame) -> tuple[DataFrame, DataFrame]:
        nonlocal next_cs
        if rs.count() <= factor * k:
            return rs.withColumn("cluster", F.lit(0).cast("long")).limit(0), rs
        made, single = _split(rs, factor * k, seed)
        made = made.withColumn("cluster", F.col("cluster") + next_cs)
        next_cs += factor * k
        return cut(made, "cs"), cut(single, "rs")

    cs, rs = compress(cut(rs, "rs"))
    cs_stats, cs_points = cut(cluster_stats(cs), "stats"), cs.select("point_id", "cluster")

    def note(i: int) -> None:
        log.append((i, ds_points.count(), cs_stats.count(), cs_points.count(), rs.count()))

    note(1)
    for i in range(1, rounds):
        new = dealt.filter(F.col("chunk") == i).select("point_id", "features")
        near = cut(nearest(new, ds_stats), "near")
        hit = near.filter(F.col("distance") < limit).select("point_id", "features", F.col("near").alias("cluster"))
        rest = near.filter(F.coalesce(F.col("distance") >= limit, F.lit(True))).select("point_id", "features")
        near2 = cut(nearest(rest, cs_stats), "near")
        hit2 = near2.filter(F.col("distance") < limit).select("point_id", "features", F.col("near").alias("cluster"))
        left = near2.filter(F.coalesce(F.col("distance") >= limit, F.lit(True))).select("point_id", "features")
        ds_stats = cut(merge_stats(ds_stats, cluster_stats(hit)), "stats")
        cs_stats = cut(merge_stats(cs_stats, cluster_stats(hit2)), "stats")
        ds_points = cut(ds_points.unionByName(hit.select("point_id", "cluster")), "ds")
        cs_points = cut(cs_points.unionByName(hit2.select("point_id", "cluster")), "cs")
        made, rs = compress(cut(rs.unionByName(left), "rs"))
        cs_stats = cut(cs_stats.unionByName(cluster_stats(made)), "stats")
        cs_points = cut(cs_points.unionByName(made.select("point_id", "cluster")), "cs")
        cs_stats, cs_points = _merge_close(cs_stats, cs_points, limit)
        if i == rounds - 1:
            moved = _centres(cs_stats)
            into = cut(nearest(moved, ds_stats).filter(F.col("distance") < limit).select(F.col("point_id").alias("cluster"), F.col("near").alias("target")), "into")
            ds_points = cut(ds_points.unionByName(cs_points.join(into, "cluster").select("point_id", F.col("target").alias("cluster"))), "ds")
            cs_points = cut(cs_points.join(into, "cluster", "left_anti"), "cs")
            cs_stats = cut(cs_stats.join(into, "cluster", "left_anti"), "stats")
        note(i + 1)
    outside = cs_points.select("point_id").unionByName(rs.select("point_id")).withColumn("cluster", F.lit(-1).cast("long"))
    return ds_points.unionByName(outside), spark.createDataFrame(log, "round int, n_ds long, n_cs_clusters long, n_cs long, n_rs long")


def _centres(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("cluster").alias("point_id"), F.transform("total", lambda s: s / F.col("n")).alias("features"))


def _merge_close(stats: DataFrame, points: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Merge disjoint pairs of summaries whose centres are close, nearest pairs first.

    There are at most a few times ``k`` summaries, so the list of close pairs is short.
    """
    centres = _centres(stats)
    other = stats.select(F.col("cluster").alias("b"), "n", "total", "squares")
    pairs = centres.join(other, F.col("point_id") < F.col("b"))
    distance = mahalanobis(F.col("features"), F.col("n"), F.col("total"), F.col("squares"))
    close = pairs.select(F.col("point_id").alias("a"), "b", distance.alias("distance")).filter(F.col("distance") < limit).orderBy("distance", "a", "b").collect()
    taken, into = set(), []
    for r in close:
        if not {r["a"], r["b"]} & taken:
            taken |= {r["a"], r["b"]}
            into.append((r["b"], r["a"]))
    if not into:
        return stats, points
    moves = stats.sparkSession.createDataFrame(into, "cluster long, target long")
    renamed = lambda df: df.join(F.broadcast(moves), "cluster", "left").withColumn("cluster", F.coalesce("target", "cluster")).drop("target")
    moved = cut(renamed(stats), "stats")
    return cut(merge_stats(moved, moved.limit(0)), "stats"), cut(renamed(points), "cs")
