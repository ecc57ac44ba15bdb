"""Members of hash buckets, for operators that compare inside buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A bucket's key holds its table's number in its low bits.
TABLES = 64


def tagged(keys: np.ndarray) -> np.ndarray:
    """Keys [members, tables] with the table's number in the low bits."""
    if keys.shape[1] > TABLES:
        raise ValueError(f"at most {TABLES} tables")
    return (keys & ~np.int64(TABLES - 1)) | np.arange(keys.shape[1], dtype=np.int64)


def members(light: DataFrame) -> DataFrame:
    """(bucket, rep, size) of all buckets with two members or more, from (bucket, rep).

    Of buckets with the same members only the one of the first table is given.
    Same means: equal in number, least, most, sum and a 64-bit digest of the members.
    Only two numbers a bucket and two a member are shuffled for buckets of one.
    """
    ends = light.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most")
    found = materialize(light.join(ends.select("bucket"), "bucket").select("bucket", "rep"), "buckets")
    whose = (F.min("rep").alias("least"), F.max("rep").alias("most"), F.sum("rep").alias("sum"), F.bit_xor(F.xxhash64("rep")).alias("xor"))
    each = found.groupBy("bucket").agg(F.count("*").alias("size"), *whose)
    first = each.groupBy("size", "least", "most", "sum", "xor").agg(F.min_by("bucket", F.col("bucket").bitwiseAND(F.lit(TABLES - 1))).alias("bucket"))
    out = found.join(first.select("bucket", "size"), "bucket")
    out._scratch_path = found._scratch_path  # for ``discard`` when the members are used up
    return out
