"""Sinks: JSON rows and Parquet snapshots.

Writes are whole-snapshot, atomic per job (Spark's commit protocol), so a
re-run after an executor loss rewrites the same output.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row (the API's row encoding), as a column ``json``."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines export of a result."""
    df.write.mode(mode).json(path)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None,
                   mode: str = "overwrite") -> None:
    """Write a ledger snapshot as Parquet, optionally partitioned (e.g. by calendar month)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def with_month_partition(ledger: DataFrame) -> DataFrame:
    """Add the partition column used for period pruning: override month, else calendar month.

    Billing period m (any start day) then lives in partitions m and m+1 only,
    so month and year filters become partition filters
    (:func:`tallyframe.functions.periods.partition_filter`).
    """
    from ..functions.periods import PARTITION_COL, partition_month
    return ledger.withColumn(PARTITION_COL, partition_month())


def write_ledger_snapshot(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a ledger snapshot partitioned for period pruning."""
    from ..functions.periods import PARTITION_COL
    write_snapshot(with_month_partition(ledger), path, partition_by=[PARTITION_COL], mode=mode)
