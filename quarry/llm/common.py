"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back.

    This cuts the lineage: what follows survives the loss of any executor
    without recomputing what came before, and reading twice gives the same rows.
    """
    return scratch.cut(df, tag)


discard = scratch.drop


def let(value: Column, body) -> Column:
    """Bind an expression once inside a larger expression (``body`` gets the bound value)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hidden(df: DataFrame, name: str) -> str:
    """A column name that the input does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def replace_columns(df: DataFrame, **new: Column) -> DataFrame:
    """Add columns; an input column of the same name (any case) gives way."""
    names = {n.lower() for n in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])
