"""The registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, langid, minhash_dedup, mixing, oracles, packing, pii, quality, secrets, substring_dedup, url_filter
from .common import table


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's verdict."""
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page's URL."""
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "p_block")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and weak-supervision verdict of every document."""
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", *[F.col(c).cast("long") for c in quality.COUNTS], "base_failed", "kept", "p_good")


#: Remainder of crc32(doc_id as text) modulo 4 that is held out from training.
HELD_OUT = 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter is held out from training."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held, F.lit(False)))
    out = langid.identify(docs.select("doc_id", "held_out", "text"), docs.filter("not held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the digest of the base spans and all spans of every document."""
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind))
    counts = [count(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.joined(F.col("spans"), base_only=True).cast("binary"), 256)
    n_added = (F.size("spans") - F.size(base)).cast("long")
    return out.select("doc_id", *counts, digest.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), n_added.alias("n_added"))


#: Target weights of the registered mixing query and of the pipeline, by domain.
TARGETS = {"en": 0.5, "fr": 0.18, "de": 0.18, "es": 0.14}


def mixing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of the domain classifier: documents listed in ``labels``, their language as domain."""
    listed = table(spark, sf_dir, "labels").select("doc_id").filter("doc_id is not null").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    return docs.join(listed, "doc_id", "left_semi")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors and fitted rate of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixing.mix(docs, mixing_labels(spark, sf_dir), TARGETS)
    return out.select("doc_id", "n_tokens", *[F.col("posteriors")[d].alias(f"p_{d}") for d in sorted(TARGETS)], "rate", "gap")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    out = embedding_dedup.link(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", "kept")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack(docs, tokenizer_path(), keep_ids=False)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies and verdict of every document."""
    out = minhash_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 50-byte strings of earlier documents, as digests."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_mixing": op3_mixing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_secrets": op5_secrets,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_packing": op8_packing,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others learn models and are tested by brute force or held-out rows."""
    return {
        "op4_embedding_dedup": oracles.EMBEDDING_DEDUP,
        "op6_url_filter": oracles.url_filter_sql(),
        "op9_minhash_dedup": oracles.MINHASH_DEDUP,
        "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
    }
