"""Streaming queries over the event table: each reads it as a stream until all is read, and returns what came out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir
from . import ngrams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    """Run to the end and read the sink: Parquet for appended rows, the last version of each batch otherwise."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = out.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
    else:
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, ngrams.windowed_counts(_stream(spark, sf_dir), "ts", "event_type"), "complete")


def stream_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, ngrams.keyed_bigrams(_stream(spark, sf_dir), "user_id", "ts", "event_id", "event_type"), "append")
    return rows.groupBy("x", "y").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_windowed_counts, stream_bigrams)}
ORACLES = {
    "stream_windowed_counts": "SELECT to_timestamp(floor(epoch(ts) / 604800) * 604800) AT TIME ZONE 'UTC' AS start, event_type AS symbol, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_bigrams": "WITH s AS (SELECT event_type AS y, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '<s>') AS x FROM events) SELECT x, y, count(*) AS n FROM s GROUP BY 1, 2",
}
