"""Readers for the landed parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages``, for work on the page bodies.  That takes far longer than reading them, so a table that is read by
    fewer tasks than the cluster runs at once (few files, which cannot be split) is dealt out first."""
    pages, slots = read_table(spark, sf_dir, "pages"), spark.sparkContext.defaultParallelism
    return pages.repartition(slots) if pages.rdd.getNumPartitions() < slots else pages


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` cast once, on read, from TIMESTAMP_NTZ to TIMESTAMP
    (watermarks and interval maths want the instant type; the session is UTC)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("ts", F.col("ts").cast("timestamp"))
