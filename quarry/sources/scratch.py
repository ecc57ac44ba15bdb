"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder below the warehouse only where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write and reread: ends the lineage, so that loops stay short and lost executors cost nothing before this point."""
    path = f"{root(df.sparkSession)}/quarry-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`cut` wrote, once nothing that is still to run reads them."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            fs, at = _at(t.sparkSession, path)
            fs.delete(at, True)
