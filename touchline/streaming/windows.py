"""Streaming extension: daily totals per event type with a watermark, and the same as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def totals(events: DataFrame) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", "2 days")
    by = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(spark.read.parquet(f"{sf_dir}/events.parquet"))


def run_once(spark: SparkSession, sf_dir: str, home: str) -> DataFrame:
    """Process what there is, append the days that the watermark has closed, and return them."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    query = totals(stream).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{home}/state").format("parquet").start(f"{home}/out")
    query.awaitTermination()
    return spark.read.schema(batch(spark, sf_dir).schema).parquet(f"{home}/out")
