"""Reading the input tables.

Parquet carries its schema, so nothing is inferred; Catalyst prunes columns and
pushes filters into the scan for every operator built on these readers.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (a parquet file or folder) as a DataFrame."""
    return spark.read.parquet(table_path(sf_dir, name))
