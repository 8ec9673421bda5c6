"""Continuous aggregates: buckets of a stream, kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bucketed(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates by event-time window and keys; rows later than `late` behind the newest are left out and finished windows leave the state."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("bucket"), *[c for c in out.columns if c != "window"])


def refresh(aggregate: DataFrame, rows: DataFrame, ts: str, width: str, watermark, keys: list[str], *aggs: Column) -> DataFrame:
    """A batch refresh: buckets before the watermark stay, those from it on are computed anew from rows."""
    kept = aggregate.filter(F.col("bucket") < F.lit(watermark))
    new = rows.filter(F.col(ts) >= F.lit(watermark)).groupBy(F.window(ts, width), *keys).agg(*aggs)
    return kept.unionByName(new.select(F.col("window.start").alias("bucket"), *[c for c in new.columns if c != "window"]))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, append finished buckets as Parquet, and stop."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
