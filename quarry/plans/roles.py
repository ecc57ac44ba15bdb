"""The roles that the test tables play, as DataFrames and as SQL.

review: user = customer of the order, item = supplier, stars = quantity, date = order date.
business: supplier with nation (city) and region (state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.readers import table
from quarry.sources.scratch import cut

TODAY = "2022-10-28"
#: Ratings before this order date train, pairs after it are predicted.
CUTOFF = "2000-06-01"

REVIEWS_SQL = "reviews as (select o_custkey as user_id, l_suppkey as item_id, l_partkey, l_quantity as stars, o_orderdate from lineitem join orders on l_orderkey = o_orderkey)"
BUSINESS_SQL = "business as (select s_suppkey, s_name, s_acctbal, n_name as city, r_name as state from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
TRAIN_SQL = f"{REVIEWS_SQL}, train as (select user_id, item_id, avg(stars) as stars from reviews where o_orderdate < timestamp '{CUTOFF}' group by 1, 2)"
TEST_SQL = f"test as (select user_id, item_id, avg(stars) as stars from reviews where o_orderdate >= timestamp '{CUTOFF}' group by 1, 2)"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("item_id"), "l_partkey", F.col("l_quantity").alias("stars"), "o_orderdate")


def business(spark: SparkSession, d: str) -> DataFrame:
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", "s_name", "s_acctbal", F.col("n_name").alias("city"), F.col("r_name").alias("state"))


def ratings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): one row per pair, split by order date."""
    rows = reviews(spark, d)
    late = F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz")
    mean = lambda df: df.groupBy("user_id", "item_id").agg(F.avg("stars").alias("stars"))
    return mean(rows.filter(~late)), mean(rows.filter(late))


def kept_ratings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``ratings``, written once for queries that read them several times."""
    train, test = ratings(spark, d)
    return cut(train, "train"), cut(test, "test")
