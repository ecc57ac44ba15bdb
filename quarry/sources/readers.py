"""Scans: explicit schemas, so that nothing is inferred and columns and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


#: Record layouts of the JSON-lines and CSV inputs; fixed values.
SCHEMAS = {
    "review": _schema(user_id=_S, business_id=_S, stars=_D, date=_S),
    "business": _schema(business_id=_S, name=_S, city=_S, state=_S, stars=_D, latitude=_D, longitude=_D, review_count=_L, categories=_S, attributes=T.MapType(_S, _S)),
    "user": _schema(user_id=_S, average_stars=_D, review_count=_L, yelping_since=_S, compliment_cool=_L, compliment_funny=_L),
    "tip": _schema(user_id=_S, business_id=_S, likes=_L),
    "rating": _schema(user_id=_S, business_id=_S, stars=_D),
    "basket": _schema(user_id=_S, business_id=_S),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).json(path)


def csv(spark: SparkSession, path: str, kind: str, header: bool = True) -> DataFrame:
    """CSV by position, as the inputs' column names vary; quotes are understood."""
    return spark.read.csv(path, schema=SCHEMAS[kind], header=header, enforceSchema=True, ignoreLeadingWhiteSpace=True)


def baskets_csv(spark: SparkSession, path: str, orientation: int = 1) -> DataFrame:
    """(basket, item) rows: orientation 1 takes users as baskets, 2 takes businesses."""
    a, b = ("user_id", "business_id") if orientation == 1 else ("business_id", "user_id")
    return csv(spark, path, "basket").select(F.col(a).alias("basket"), F.col(b).alias("item"))


def numeric_csv(spark: SparkSession, path: str, features: int) -> DataFrame:
    """Headerless numbers: id, label, then ``features`` values as one array."""
    cols = [f"f{i}" for i in range(features)]
    schema = T.StructType([T.StructField("point_id", _L), T.StructField("label", _L), *[T.StructField(c, _D) for c in cols]])
    return spark.read.csv(path, schema=schema).select("point_id", "label", F.array(*cols).alias("features"))


def transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted transaction rows as (date, customer_id, product_id), by positions 0, 1 and 5."""
    cols = T.StructType([T.StructField(f"c{i}", _S) for i in range(9)])
    return spark.read.csv(path, schema=cols, header=True, enforceSchema=True).select(F.col("c0").alias("date"), F.col("c1").alias("customer_id"), F.col("c5").alias("product_id"))


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of text lines: one file, or a few, per micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def resampled_batches(lines: DataFrame, batches: int, size: int, seed: int = 553) -> DataFrame:
    """A simulated stream: (batch, seq, value), ``size`` lines for each batch drawn uniformly with replacement.

    Lines get dense places by their order; a draw is a seeded hash of (batch, seq),
    so a batch can be asked again and gives the same rows.
    """
    from quarry.operators.encode import row_index

    n = lines.count()
    if not n:
        return lines.sparkSession.range(0).select(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("value"))
    placed = row_index(lines, lines.columns[0]).select(F.col("index").alias("place"), F.col(lines.columns[0]).alias("value"))
    asked = lines.sparkSession.range(batches * size).select(F.floor(F.col("id") / size).alias("batch"), (F.col("id") % size).alias("seq"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("place"))
    return asked.join(placed, "place").select("batch", "seq", "value")
