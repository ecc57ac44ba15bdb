"""Sinks: report files in their exact layouts, Parquet, and models.

Reports are small and ordered, so they are written as one text file through
Spark (``coalesce(1)``), which works on any file system Spark can reach.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """One text file of the ordered frame's lines."""
    df.select(F.col(line).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json_object(values: dict, spark, path: str) -> None:
    """One JSON object as a one-line text file."""
    write_lines(spark.createDataFrame([(json.dumps(values),)], "line string"), path)


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """One line per size from ``items`` arrays: ``('a'),('b')`` then ``('a', 'b')`` ..., each size ordered."""
    text = F.concat(F.lit("("), F.array_join(F.transform("items", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", "), F.lit(")"))
    rows = itemsets.select(F.size("items").alias("size"), "items", text.alias("text"))
    lists = rows.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("items", "text"))).alias("all"))
    return lists.select("size", F.array_join(F.transform("all", lambda x: x["text"]), ",").alias("line")).orderBy("size")


def write_itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """The two sections ``Candidates:`` and ``Frequent Itemsets:``, a blank line between sizes."""
    parts = []
    for k, (title, sets) in enumerate((("Candidates:", candidates), ("Frequent Itemsets:", frequent))):
        lines = itemset_lines(sets).select((F.col("size") * 2).alias("n"), "line")
        blank = lines.select((F.col("n") + 1).alias("n"), F.lit("").alias("line"))
        head = lines.sparkSession.createDataFrame([(0, title)], "n int, line string")
        parts.append(head.unionByName(lines).unionByName(blank).select(F.lit(k).alias("part"), "n", "line"))
    write_lines(parts[0].unionByName(parts[1]).orderBy("part", "n"), path)


def community_lines(communities: DataFrame) -> DataFrame:
    """``'a', 'b'`` per community from ``members`` arrays, smaller communities first."""
    line = F.array_join(F.transform(F.array_sort("members"), lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")
    return communities.select(F.size("members").alias("size"), F.array_min("members").alias("first"), line.alias("line")).orderBy("size", "first")


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """``('a', 'b'),value`` with five decimals, largest first."""
    line = F.concat(F.lit("('"), F.col("a").cast("string"), F.lit("', '"), F.col("b").cast("string"), F.lit("'),"), F.round("betweenness", 5).cast("string"))
    return edges.orderBy(F.desc("betweenness"), "a", "b").select(line.alias("line"))


def clustering_lines(rounds: DataFrame, points: DataFrame) -> DataFrame:
    """``Round i: ds,clusters,cs,rs`` lines and then ``point,cluster`` lines by point."""
    spark = rounds.sparkSession
    head = spark.createDataFrame([(0, 0, "The intermediate results:"), (2, 0, ""), (3, 0, "The clustering results:")], "part int, n long, line string")
    r = rounds.select(F.lit(1).alias("part"), F.col("round").cast("long").alias("n"), F.concat(F.lit("Round "), "round", F.lit(": "), F.concat_ws(",", "n_ds", "n_cs_clusters", "n_cs", "n_rs")).alias("line"))
    p = points.select(F.lit(4).alias("part"), F.col("point_id").alias("n"), F.concat_ws(",", "point_id", "cluster").alias("line"))
    return head.unionByName(r).unionByName(p).orderBy("part", "n").select("line")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
