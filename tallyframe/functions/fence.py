"""Projection fence: evaluate expensive per-row expressions once.

Catalyst's CollapseProject may inline a computed column into every expression
that references it. For cheap columns that is free; for a regex chain or a
JSON parse referenced five times it multiplies the work. Passing the row
through a one-element ``inline`` (a Generate node) keeps the computed values
as materialised columns: projections are never collapsed across a Generate.
The cost is one struct per row, no shuffle and no extra stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))
