"""Readers of the driver's tables and the views that queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inventory import tokens
from .storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Lower-case runs of a-z."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, word, n): the words of all documents, counted once and written, so that what follows works on words.

    A filter on words would else move below the count and look at every word of the running text.
    """
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    return cut(rows.groupBy("lang", "word").agg(F.count("*").alias("n")))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n) of all languages together, counted once and written."""
    rows = table(spark, sf_dir, "documents").select(F.explode(words_of(F.col("text"))).alias("word"))
    return cut(rows.groupBy("word").agg(F.count("*").alias("n")))


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n, tokens) of the words that the inventory can spell."""
    return vocabulary(spark, sf_dir).withColumn("tokens", tokens(F.col("word"))).filter("tokens is not null")
