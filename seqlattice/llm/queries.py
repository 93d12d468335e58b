"""The queries of this subpackage: each applies one operator to its whole table; the SQL beside it gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, hard_negatives, html_extract, license_scan, line_dedup, manifest, minhash, quality_rules, segmentation, substring_dedup, suffix_dedup, token_counts
from .common import table
from .oracles import ORACLES


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.col("__lines")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs))
    return kept.select("doc_id", lines["n_lines"].alias("n_lines"), lines["n_dropped"].alias("n_dropped"), F.sha2(lines["text"].cast("binary"), 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    found = decontaminate.decontaminate(docs, benchmark, {"doc_id": F.col("doc_id")})
    items = F.array_sort(F.array_distinct(F.filter(F.transform("__matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.encode(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = minhash.minhash_dedup(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).withColumn("n_matches", F.size("matches").cast("long"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.usable(table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"))
    return hard_negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document; of those whose id's checksum 5 divides, the text is lower-cased before its proof is tried."""
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf_hash([*(columns | {"text": lowered}).values()]))
    proofs = manifest.merkle_manifest(table(spark, sf_dir, "documents"), manifest.leaf_hash([*columns.values()]), F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "other": other})
    folded = proofs.withColumns({"proof_sha256": manifest.proof_hash(F.col("path")), "folded_root": manifest.fold(F.coalesce("other", "leaf"), F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
