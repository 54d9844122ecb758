"""Parquet tables by name, read through Spark so that any Hadoop-compatible store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed names of the driver's tables.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table under sf_dir; columns are pruned and filters pushed down by the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
