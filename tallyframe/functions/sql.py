"""SQL functions for SQL users (UDF surface): inlined SQL expressions, not Python.

``register_sql_functions(spark)`` defines session-scoped SQL functions so that
``spark.sql`` users get the same period logic as the DataFrame operators. A SQL
function body is an ordinary expression: Catalyst inlines and constant-folds it.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

from .. import constants as K

_SPEND = ", ".join(f"'{d}'" for d in K.SPEND_DIRECTIONS)

FUNCTIONS = {
    "billing_period": (
        "t TIMESTAMP_NTZ, d INT", "STRING",
        "CASE WHEN d <= 1 THEN date_format(t, 'yyyy-MM') "
        "ELSE date_format(date_sub(to_date(t), d - 1), 'yyyy-MM') END"),
    "attribution_month": (
        "eff STRING, t TIMESTAMP_NTZ, d INT", "STRING",
        "coalesce(eff, CASE WHEN d <= 1 THEN date_format(t, 'yyyy-MM') "
        "ELSE date_format(date_sub(to_date(t), d - 1), 'yyyy-MM') END)"),
    "clamp_start_day": (
        "v STRING", "INT",
        "CASE WHEN try_cast(trim(v) AS INT) IS NULL THEN 1 "
        "ELSE greatest(1, least(28, try_cast(trim(v) AS INT))) END"),
    "is_spend": ("direction STRING", "BOOLEAN", f"direction IN ({_SPEND})"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
