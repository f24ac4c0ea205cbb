"""Listings and predicates.

Filters are composed as Column predicates so Catalyst pushes them into the
Parquet scan; sorted pages are ``orderBy().offset().limit()`` which plans as a
per-partition top-k (TakeOrderedAndProject) instead of a global sort.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.periods import (attribution_month, in_attribution_month, in_attribution_year,
                                 partition_filter)

LIST_COLUMNS = ["id", "card_last4", "card_type", "txn_time", "amount", "direction", "merchant_raw",
                "merchant_key", "category", "status", "voided", "offset_of", "merged_into",
                "effective_month", "note"]


def listing_columns(df: DataFrame) -> DataFrame:
    """The listing projection with money as DOUBLE."""
    cols = [F.col(c).cast("double").alias(c) if c == "amount" else F.col(c)
            for c in LIST_COLUMNS if c in df.columns]
    return df.select(*cols)


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only (SQLite LIKE folding, Q13)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_contains(col: Column, q: str) -> Column:
    """``col LIKE '%q%'`` with ASCII-only case folding; '%' and '_' in q stay wildcards."""
    return ascii_fold(col).like("%" + q.translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + "%")


def ledger_filter(df: DataFrame, *, month: str | None = None, year: str | None = None,
                  card: str | None = None, status: str | None = None,
                  category: str | None = None, q: str | None = None,
                  merchant_key: str | None = None, start_day: int = 1) -> DataFrame:
    """Predicate part of the ledger listing (F1, F2).

    ``status='void'`` switches to voided rows; otherwise live rows, optionally
    of one status. ``category='__uncat__'`` selects rows without a category.
    """
    if status == "void":
        df = df.filter(F.col("voided"))
    else:
        df = df.filter(~F.col("voided"))
        if status:
            df = df.filter(F.col("status") == status)
    if merchant_key:
        df = df.filter(F.col("merchant_key") == merchant_key)
    part = partition_filter(df.columns, month=month, year=year, start_day=start_day)
    if part is not None:
        df = df.filter(part)
    if month:
        df = df.filter(in_attribution_month(month, start_day))
    if year:
        df = df.filter(in_attribution_year(year, start_day))
    if card:
        df = df.filter(F.col("card_type") == card)
    if category == K.UNCAT:
        df = df.filter(F.col("category").isNull())
    elif category:
        df = df.filter(F.col("category") == category)
    if q:
        df = df.filter(like_contains(F.col("merchant_raw"), q))
    return df


def ledger_page(df: DataFrame, *, limit: int = K.PAGE_LEDGER, offset: int = 0, **filters) -> DataFrame:
    """One page of the listing, newest first, ties by id."""
    rows = ledger_filter(df, **filters).orderBy(F.col("txn_time").desc(), F.col("id").desc())
    if offset:
        rows = rows.offset(offset)
    return listing_columns(rows.limit(limit))


def deposit_list(deposits: DataFrame, *, amount: float | None = None, since_days: int | None = None,
                 as_of: str | None = None, limit: int = K.PAGE_DEPOSITS) -> DataFrame:
    """Deposits newest first; optional amount match (+-0.01) and look-back window."""
    d = deposits
    if amount is not None:
        d = d.filter(F.abs(F.col("amount") - F.lit(amount).cast("decimal(18,2)")) < F.lit(0.01))
    if since_days is not None:
        since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(int(since_days)))
        d = d.filter(F.col("txn_time") >= since)
    raw = F.col("raw_text") if "raw_text" in deposits.columns else F.lit(None).cast("string").alias("raw_text")
    return (d.orderBy(F.col("txn_time").desc(), F.col("id").desc()).limit(limit)
            .select("id", "source_msg_id", "card_last4", "txn_time",
                    F.col("amount").cast("double").alias("amount"), "kind", "payer", "note", raw))


def pending_count(df: DataFrame) -> DataFrame:
    """New pending rows that have a merchant."""
    return df.filter((F.col("status") == "pending") & ~F.col("voided")
                     & F.col("merchant_key").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


def pending_list(df: DataFrame, *, month: str | None = None, limit: int = K.PAGE_PENDING,
                 start_day: int = 1) -> DataFrame:
    """Pending rows, newest first, default 20."""
    return ledger_page(df, limit=limit, status="pending", month=month, start_day=start_day)


def category_drilldown(df: DataFrame, *, month: str, category: str, start_day: int = 1,
                       sort_key: str = "amount", descending: bool = True) -> DataFrame:
    """Rows of one period x category in the requested order, with the cell total (F8).

    The rows are range-sorted by Spark (distributed sort); the total is a
    partial/final aggregate of the same cell joined back on the period label.
    That side has one row per cell, so it is broadcast by size.
    """
    rows = ledger_filter(df, month=month, category=category, start_day=start_day) \
        .withColumn("m", attribution_month("txn_time", start_day))
    total = rows.groupBy("m").agg(F.round(F.sum("amount"), 2).cast("double").alias("cell_total"))
    key = F.col("amount") if sort_key == "amount" else F.col("txn_time")
    order = [key.desc(), F.col("id").desc()] if descending else [key.asc(), F.col("id").asc()]
    return (rows.join(F.broadcast(total), "m")
            .select("id", "txn_time", F.col("amount").cast("double").alias("amount"),
                    "merchant_raw", "m", "cell_total")
            .orderBy(*order))
