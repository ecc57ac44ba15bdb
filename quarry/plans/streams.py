"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.plans.registry import query
from quarry.sources.readers import table
from quarry.sources.scratch import root
from quarry.streaming import sketches, windows


def _folder(spark):
    return f"{root(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query("stream_window_counts", "select time_bucket(interval '1 day', ts) as start, event_type, count(*)::bigint as n from events group by 1, 2")
def stream_window_counts(spark, d):
    stream = windows.tumbling_counts(windows.event_time(_events(spark, d)), "ts", ["event_type"], "1 day", "1 hour")
    out = windows.run_available(stream, _folder(spark), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_stateful_counts", "select user_id, count(*)::bigint as n from events group by 1")
def stream_stateful_counts(spark, d):
    return windows.run_available(sketches.counts_stream(_events(spark, d), "user_id"), _folder(spark), "complete")


@query("stream_bloom_seen", "select user_id::varchar as user_id, count(*)::bigint as n, 1::bigint as new from events where user_id is not null group by 1")
def stream_bloom_seen(spark, d):
    """Of each value's rows the filter calls all but the first seen; so many bits leave no false positive."""
    seen = windows.run_available(sketches.bloom_stream(_events(spark, d).filter("user_id is not null"), "user_id", bits=1 << 22, elements=1 << 17, shards=8), _folder(spark))
    return seen.groupBy(F.col("value").alias("user_id")).agg(F.count("*").alias("n"), F.count_if(~F.col("seen")).alias("new"))


@query("stream_reservoir", "select (k + 1) * 100 as seqnum, 5::bigint as slots, 5::bigint as known from range(0, (select count(*) // 100 from events)) r(k)")
def stream_reservoir(spark, d):
    """What five slots of the reservoir hold after each hundred rows: values of the stream."""
    held = windows.run_available(sketches.reservoir_stream(_events(spark, d), "event_id"), _folder(spark))
    values = held.select("value").distinct()  # few, as the reservoir takes ever fewer
    known = held.join(table(spark, d, "events").select(F.col("event_id").cast("string").alias("value")).join(values, "value", "left_semi").distinct().withColumn("hit", F.lit(1)), "value", "left")
    return known.groupBy("seqnum").agg(F.count("*").alias("slots"), F.count("hit").alias("known"))


@query("stream_distinct_by_day", "select time_bucket(interval '1 day', ts) as start, true as near from events group by 1")
def stream_distinct_by_day(spark, d):
    """Estimated distinct users by day, within a tenth of the exact number."""
    stream = windows.distinct_estimates(windows.event_time(_events(spark, d)), "ts", "user_id")
    found = windows.run_available(stream, _folder(spark), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "estimate")
    exact = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start")).agg(F.count_distinct("user_id").alias("n"))
    return exact.join(found, "start", "left").select("start", F.coalesce(F.abs(F.col("estimate") - F.col("n")) <= 1 + F.col("n") / 10, F.lit(False)).alias("near"))


@query("stream_batch_ordinals", "select 0::bigint as batch, count(distinct user_id)::bigint as n_distinct from events")
def stream_batch_ordinals(spark, d):
    """Exact distinct users of each micro-batch, numbered from 0 (the table is one file, so one batch)."""
    rows = sketches.micro_batches(_events(spark, d), "user_id", f"{_folder(spark)}/state")
    return spark.createDataFrame([(int(r["batch"]), int(r["n_distinct"])) for r in rows], "batch long, n_distinct long")
