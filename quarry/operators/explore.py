"""Exploration: counts, top-k, grouped means, profiles and partition reports."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    return df.agg((F.count("*") if where is None else F.count_if(where)).alias(name))


def count_distinct(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.agg(F.count_distinct(col).alias(name))


def top_counts(df: DataFrame, col: str, k: int = 10, name: str = "n") -> DataFrame:
    """The ``k`` most frequent values, ties by value; a TakeOrderedAndProject, no full sort."""
    return df.groupBy(col).agg(F.count("*").alias(name)).orderBy(F.desc(name), col).limit(k)


def mean_by(facts: DataFrame, dimension: DataFrame, on: str, group: str, value: str, name: str) -> DataFrame:
    """Mean of a fact by an attribute of the dimension it joins; facts are pre-aggregated by the join key.

    The join then moves one row per key instead of one per fact.
    """
    sums = facts.groupBy(on).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    joined = sums.join(dimension.select(on, group), on)
    return joined.groupBy(group).agg((F.sum("_s") / F.sum("_n")).alias(name))


def partition_report(df: DataFrame) -> DataFrame:
    """Rows in each partition as it is now."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))


def compare_partitioning(df: DataFrame, key: str, n: int, action=lambda d: d.count()) -> dict:
    """Partitions, their sizes and the time of an action, as it is and dealt by the key into ``n``."""
    out = {}
    for name, frame in (("default", df), ("customized", df.repartition(n, key))):
        began = time.perf_counter()
        action(frame)
        sizes = [r["n_items"] for r in partition_report(frame).orderBy("partition").collect()]  # one row a partition
        out[name] = {"n_partition": len(sizes), "n_items": sizes, "exe_time": time.perf_counter() - began}
    return out


def sentinel_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, nulls, empty texts, zeros and the text 'None'; one pass over the data."""
    aggs = []
    for c in columns:
        s = F.col(c).cast("string")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count("*").alias("n_rows"),
                F.count_if(s.isNull()).alias("n_null"),
                F.count_if(F.coalesce(s == "", F.lit(False))).alias("n_empty"),
                F.count_if(F.coalesce(s.try_cast("double") == 0, F.lit(False))).alias("n_zero"),
                F.count_if(F.coalesce(s == "None", F.lit(False))).alias("n_none"),
            )
        )
    return df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def summary(df: DataFrame) -> DataFrame:
    return df.summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, one pass; 0 where a column is constant."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), F.lit(0.0)).alias("corr")) for c in columns]
    return df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def joined_or_default(facts: DataFrame, dimension: DataFrame, on, defaults: dict[str, Column]) -> DataFrame:
    """Left join; where the dimension has no row its columns take the defaults."""
    joined = facts.join(dimension.withColumn("_hit", F.lit(True)), on, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(c)).otherwise(v) for c, v in defaults.items()}).drop("_hit")


def rmse(df: DataFrame, truth: str, prediction: str, name: str = "rmse") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(prediction), 2))).alias(name))


def error_histogram(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Rows by unit bins of the absolute error."""
    low = F.floor(F.abs(F.col(truth) - F.col(prediction))).cast("long")
    return df.select(low.alias("low")).groupBy("low").agg(F.count("*").alias("n")).select("low", (F.col("low") + 1).alias("high"), "n")
