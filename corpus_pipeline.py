"""The training-data pipeline over ``documents``.

Quality rules, near-duplicate removal, redaction of personal data, mixing to
target weights and packing.  Every stage works on all rows its predecessor kept;
stages exchange Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import minhash_dedup, mixing, packing, pii, quality, queries
from quarry.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id.

    What goes is a share of the documents, so it is always joined by sorting, never broadcast.
    """
    seen = minhash_dedup.classes(docs.select("doc_id", "text"))
    gone = materialize(seen.filter("not kept").select("id", "fold").distinct(), "gone")
    fold = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    left = docs.join(gone.hint("merge"), (docs["doc_id"] == gone["id"]) & (fold == gone["fold"]), "left_anti")
    if not docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():  # rows that repeat an id and a text
        left = left.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.filter("doc_id is null"))
    return left.select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text."""
    out = pii.find(docs, redact=True)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says; no document is read less than once."""
    labels = table(spark, sf_dir, "labels").select("doc_id").filter("doc_id is not null").distinct()
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain")).join(labels, "doc_id", "left_semi")
    out = mixing.mix(docs, labelled, queries.TARGETS, total_factor=None, least=1.0)
    times = mixing.repeats(F.col("rate"), F.col("doc_id"))
    return out.withColumn("_reading", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its token ids and its place in a sequence."""
    out = packing.pack(docs.select("doc_id", "text"), queries.tokenizer_path(), keep_ids=True)
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("crc", "ids_crc32")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The stages learn models, so SQL cannot express them; the tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    out = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = materialize(out, f"stage{k}")
    return out
