"""Event-time windows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources import scratch


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Zone-free timestamps as timestamps of the session's zone, which watermarks need."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def tumbling_counts(stream: DataFrame, time: str, keys: list[str], size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window and keys; rows later than ``late`` behind the watermark are dropped by the engine."""
    rows = stream.withWatermark(time, late)
    counts = rows.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n")


def distinct_estimates(stream: DataFrame, time: str, value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Approximate distinct values per window (HyperLogLog++ state)."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.approx_count_distinct(value, 0.02).alias("estimate"))
    return counts.select(F.col("window.start").alias("start"), "estimate")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run what there is to the end; the result table stands in ``folder``, which executors share.

    Append: the rows of all micro-batches.  Complete: the last one's, which holds
    the whole result.  A micro-batch that is run again overwrites its own files.
    """
    spark, schema = stream.sparkSession, stream.schema

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not scratch.exists(spark, f"{folder}/rows"):  # no micro-batch had anything
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
