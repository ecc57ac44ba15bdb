"""Dense surrogate ids, label encoding and multi-hot encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 in the order of ``order``, without gathering rows in one task.

    One range shuffle sorts the rows; a row's place inside its partition is kept in
    the written table, and a partition's first number is the sum of the counts
    before it (one row a partition).
    """
    from quarry.sources.scratch import cut

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(placed, "ranked").withColumn("_pid", F.shiftright("_at", 33)).withColumn("_inside", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_pid").count()
    before = counts.select("_pid", F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_pid").withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_pid", "_before", "_inside", "_at")


def row_index(df: DataFrame, col: str, name: str = "index") -> DataFrame:
    """Every row with its place (from 0) in the order of ``col``; equal values in any order."""
    return _ranked(df.select(col), [col], name)


def dense_index(df: DataFrame, col: str, name: str = "index") -> DataFrame:
    """Distinct non-null values with a dense index from 0 in sorted order."""
    return _ranked(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], name)


def label_encode(df: DataFrame, col: str, name: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """Adds the sorted dense index of ``col``'s values, fitted on ``fitted_on``; null where unseen."""
    codes = dense_index(df if fitted_on is None else fitted_on, col, name)
    return df.join(codes, col, "left")


def multi_hot(df: DataFrame, id_col: str, col: str, sep: str = ", ") -> DataFrame:
    """(id, value) rows, one per distinct element of a separated text: the sparse form of a multi-hot matrix."""
    return df.select(id_col, F.explode(F.array_distinct(F.split(col, sep))).alias("value")).filter("value <> ''")


def one_hot(df: DataFrame, col: str, values: list, prefix: str) -> DataFrame:
    """A 0/1 column for each of the given values."""
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{prefix}{i}") for i, v in enumerate(values)])
