"""Flagship plan: ledger -> exact refund pairing -> period x category matrix.

The pairing shuffles only the candidate rows (expenses and refunds) by their
(card, merchant, amount) key; the matrix is a partial + final hash aggregate.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures as fx
from ..operators import matching, reports


def netted_monthly_matrix(spark: SparkSession, sf_dir: str, start_day: int = 15) -> DataFrame:
    ledger = fx.ledger_e(spark, sf_dir)
    return reports.monthly_matrix(matching.apply_pairing(ledger), start_day=start_day)
