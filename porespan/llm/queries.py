"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, lexical, mixing, near_dedup, packing, pieces, quality_rules, substring_dedup, token_counts, toxicity, url_filters, vector_codes, warc
from .common import table
from .oracles import oracle_sql  # noqa: F401


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses_from_pages(table(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", F.md5(F.col("header").cast("binary")).alias("header_md5"), "block")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("word_bpe_49k.json")).drop("text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.url_verdicts(pages).select("page_id", "host", "path", "rule", "template", F.round("purity", 6).alias("purity"), "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, table(spark, sf_dir, "labels")).drop("text")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    return mixing.apportion(sized).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.adaptive_rules(docs, carry=["doc_id"])


def op10_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = pieces.sample_segmentations(docs, vocabulary("piece_bpe_32k.model"))
    return drawn.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"), "log_prob", "perturbed", "inclusion")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_warc, op2_token_counts, op3_substring_dedup, op4_near_dedup, op5_url_filters, op6_toxicity, op7_fingerprints, op8_mixing, op9_quality_rules, op10_segmentations, op11_vector_codes, op12_packing, op13_lexical_search)}
