"""Edges as a stream: pairs with their types in windows of event time, late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_edges(spark: SparkSession, path: str, schema: str = "src bigint, dst bigint, edge_type string, prob int, ts timestamp", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_pairs(edges: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, src, dst, n, prob) of each window: number of edges and the largest probability."""
    return edges.where("src <> dst").withWatermark("ts", late).groupBy(F.window("ts", width), "src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("prob").alias("prob")).select(F.col("window.start").alias("start"), "src", "dst", "n", "prob")


def write_pairs(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
