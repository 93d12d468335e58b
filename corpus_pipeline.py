"""From raw documents to sampled token sequences, in five stages; each works on all that the one before kept.

``run`` writes each stage's result as Parquet to the shared folder and reads it again as the next one's documents.  All
stages but the last return the columns of their input, whatever further columns there are and however they are named;
they take empty tables, null and very long texts and repeated rows.  SQL can't express the first stage (a tokenizer's figures) or the
last (a sampler), so there is no SQL for the whole; the tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import decontaminate, line_dedup, minhash, quality_rules, segmentation
from seqlattice.llm.common import materialize, table, text_key

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's bands go: so do null and empty texts.

    Repeated rows go or stay together.
    """
    judged = quality_rules.quality_rules(docs)
    gone = judged.filter(~F.col("kept")).select("doc_id", "tx").distinct().alias("gone")
    rows = docs.alias("rows")
    same = F.col("rows.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")) & (text_key(F.col("rows.text")) == F.col("gone.tx"))
    return rows.join(gone, same, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three or more documents stay in one; ``text`` and ``n_chars`` are those of the kept lines.

    A null text stays null; a text that loses all of its lines is empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.struct(F.lit(None).alias("__"), *others).alias("row"), "doc_id", "text")
    kept = line_dedup.apply_bitmaps(rows, line_dedup.line_dedup(docs))
    text = F.when(F.col("text").isNotNull(), F.col("__lines.text"))
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return kept.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) if c in others else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the smallest id, and among texts of that id the first by hash.

    Rows of null or empty text are in no group; of those that repeat wholly one stays.
    """
    linked = minhash.minhash_dedup(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rep")).alias("first")
    grouped = linked.filter("root IS NOT NULL").groupBy("root").agg(first).select(F.col("first.rep").alias("rep"))
    kept = grouped.unionByName(linked.filter("root IS NULL").select("rep")).withColumnRenamed("rep", "__kept_row")
    rows = docs.select(F.struct(*docs.columns).alias("row"), minhash.row_key().alias("__kept_row"))
    return rows.join(kept, "__kept_row", "left_semi").dropDuplicates(["__kept_row"]).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), {"kept": F.struct(*docs.columns)})
    return found.filter(F.col("__n_hit") == 0).select("kept.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, with the ids of their pieces."""
    return segmentation.encode(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark), ("sentencepiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
