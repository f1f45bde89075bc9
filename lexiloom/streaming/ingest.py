"""Documents that arrive over time: statistics of each as it comes, repeated content dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.reports import text_stats


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def fresh_documents(stream: DataFrame, delay: str = "21 days") -> DataFrame:
    """The first arrival of each content (by a hash of the text) within the watermark of received_at; rows later than the
    delay are dropped by the state store. Null texts are left out."""
    hashed = stream.filter("text is not null and received_at is not null").withColumn("content", F.xxhash64(T.text_of("text")))
    return hashed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["content"])


def stream_stats(stream: DataFrame) -> DataFrame:
    """text_stats of each arriving file: stateless, row by row."""
    return text_stats(stream.withColumnRenamed("file_id", "doc_id"))


def arrivals(stream: DataFrame, window: str = "1 day", delay: str = "21 days") -> DataFrame:
    """start, ext, files, failed: files by window of receipt and kind."""
    ext = F.coalesce(F.lower("ext"), F.lit(""))
    rows = stream.filter("received_at is not null").withWatermark("received_at", delay)
    return rows.groupBy(F.window("received_at", window).alias("w"), ext.alias("ext")).agg(F.count("*").alias("files"), F.count("error").alias("failed")).select(F.col("w.start").alias("start"), "ext", "files", "failed")
