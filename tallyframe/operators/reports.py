"""Spend reports (D1-D12): one declarative aggregation each.

All reports work on a ledger DataFrame (schema of ``fixtures.LEDGER_COLUMNS``)
and take the billing ``start_day`` as an argument. Money is summed as DECIMAL
and converted to DOUBLE once, at the output. Every aggregation is a hash
aggregate with a map-side partial step, so the shuffle carries one row per
(partition, group) and skewed groups are pre-combined before the exchange.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.periods import (attribution_month, billing_period, in_attribution_month,
                                 partition_filter)


def money(c: Column) -> Column:
    """Round a DECIMAL sum to cents and hand it out as DOUBLE."""
    return F.round(c, 2).cast("double")


def live(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("voided"))


def is_spend() -> Column:
    return F.col("direction").isin(*K.SPEND_DIRECTIONS)


def spend_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("voided") & is_spend())


def summary(df: DataFrame, month: str | None = None, start_day: int = 1) -> DataFrame:
    """Totals (D1): live rows, open rows, signed spend; optional attribution month.

    One pass with conditional aggregates. ``total`` and ``pending`` count every
    direction; only ``spend`` filters on the spend directions (Q2).
    """
    rows = live(df)
    if month:
        part = partition_filter(df.columns, month=month, start_day=start_day)
        if part is not None:
            rows = rows.filter(part)
        rows = rows.filter(in_attribution_month(month, start_day))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin(*K.OPEN_STATUSES)).alias("pending"),
        F.coalesce(money(F.sum(F.when(is_spend(), F.col("amount")))), F.lit(0.0)).alias("spend"),
    )


def category_stats(df: DataFrame) -> DataFrame:
    """All-time {n, spend} per category over live spend rows (D2); null category excluded."""
    return (spend_rows(df).filter(F.col("category").isNotNull())
            .groupBy(F.col("category").alias("c"))
            .agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("spend")))


def monthly_matrix(df: DataFrame, start_day: int = 1, ordered: bool = True) -> DataFrame:
    """Attribution month x category -> spend, n (D3), newest month first (streams: ``ordered=False``)."""
    out = (spend_rows(df)
            .groupBy(attribution_month("txn_time", start_day).alias("m"),
                     F.coalesce(F.col("category"), F.lit(K.UNCAT)).alias("c"))
            .agg(money(F.sum("amount")).alias("spend"), F.count(F.lit(1)).alias("n")))
    return out.orderBy(F.desc("m"), "c") if ordered else out


def annual_matrix(df: DataFrame, start_day: int = 1, annual_from: str = "2026") -> DataFrame:
    """Attribution year x category for years >= ``annual_from`` (D4), newest year first."""
    y = F.substring(attribution_month("txn_time", start_day), 1, 4)
    return (spend_rows(df).filter(y >= F.lit(annual_from))
            .groupBy(y.alias("y"), F.coalesce(F.col("category"), F.lit(K.UNCAT)).alias("c"))
            .agg(money(F.sum("amount")).alias("spend"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("y"), "c"))


def spend_rollup(df: DataFrame, start_day: int = 1) -> DataFrame:
    """Spend of every year, month and category, of every year and month, of every year, and of all (D3, D4 and the
    total) as grouping sets of one aggregation over one scan.

    ``level``: 0 a cell, 1 a month, 3 a year, 7 the total; columns below a row's level are null.
    """
    rows = spend_rows(df).select(attribution_month("txn_time", start_day).alias("m"),
                                 F.coalesce(F.col("category"), F.lit(K.UNCAT)).alias("c"), "amount")
    cells = rows.rollup(F.substring("m", 1, 4).alias("y"), "m", "c").agg(
        F.grouping_id().cast("int").alias("level"), money(F.sum("amount")).alias("spend"), F.count(F.lit(1)).alias("n"))
    return cells.orderBy(F.desc_nulls_last("y"), F.desc_nulls_last("m"), F.asc_nulls_last("c"))


def period_list(df: DataFrame, start_day: int = 1) -> DataFrame:
    """Distinct raw billing periods, voided rows and overrides included (D6, Q1), newest first."""
    return df.select(billing_period("txn_time", start_day).alias("m")).distinct().orderBy(F.desc("m"))


def monthly_summary(df: DataFrame, start_day: int = 1, month: str | None = None) -> DataFrame:
    """Per-category totals re-aggregated from the month matrix.

    Keeps categories whose |spend| > 0.004; the uncategorised bucket gets its label.
    Largest spend first. A month is cut out before anything is aggregated, by a
    range of times that reaches the scan.
    """
    if month:
        df = df.filter(in_attribution_month(month, start_day))
    cells = monthly_matrix(df, start_day)
    label = F.when(F.col("c") == K.UNCAT, F.lit(K.UNCAT_LABEL)).otherwise(F.col("c"))
    return (cells.groupBy(label.alias("category"))
            .agg(F.sum(F.col("spend").cast("decimal(18,2)")).alias("s"), F.sum("n").alias("n"))
            .filter(F.abs(F.col("s")) > F.lit(0.004))
            .select("category", money(F.col("s")).alias("spend"), F.col("n").cast("bigint").alias("n"))
            .orderBy(F.desc("spend"), "category"))


def _share(cells: DataFrame, period_col: str) -> DataFrame:
    w = Window.partitionBy(period_col)
    total = F.sum(F.col("spend").cast("decimal(18,2)")).over(w).cast("double")
    return (cells.withColumn("total", F.when(total == 0, F.lit(1.0)).otherwise(total))
            .filter(F.col("spend") > 0)
            .withColumn("pct", F.col("spend") / F.col("total"))
            .select(period_col, "c", "spend", "total", "pct"))


def category_share(df: DataFrame, start_day: int = 1) -> DataFrame:
    """Category share of its period total.

    The total includes negative categories; only positive categories get a bar;
    a zero total divides by 1. The window partitions by period over the
    already-aggregated matrix, so it touches one small row per cell.
    """
    return _share(monthly_matrix(df, start_day), "m")


def category_share_annual(df: DataFrame, start_day: int = 1, annual_from: str = "2026") -> DataFrame:
    """D8 over the annual matrix."""
    return _share(annual_matrix(df, start_day, annual_from), "y")


def deposit_monthly(deposits: DataFrame) -> DataFrame:
    """Deposits per calendar month (not billing period): count and total."""
    return (deposits.groupBy(F.date_format("txn_time", "yyyy-MM").alias("m"))
            .agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("total")))


def merchant_totals(df: DataFrame) -> DataFrame:
    """Per merchant: live rows, their signed sum, and how many are still open."""
    return (live(df).filter(F.col("merchant_key").isNotNull())
            .groupBy("merchant_key")
            .agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("total"),
                 F.count_if(F.col("status").isin(*K.OPEN_STATUSES)).alias("pending_n")))


def pending_merchants(df: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Merchants still needing the user.

    Live rows in pending/suggested with a merchant, left-joined to their advice.
    ``spend`` is gross positive; the advice fields are independent maxima (the
    ids maximum is a text maximum of the JSON list). Merchants with most rows
    come first (T3).
    """
    t = live(df).filter(F.col("status").isin(*K.OPEN_STATUSES) & F.col("merchant_key").isNotNull())
    s = suggestions.select(F.col("transaction_id").alias("id"), "operation",
                           "related_transaction_ids", "reason")
    j = t.join(s, "id", "left")
    return (j.groupBy("merchant_key")
            .agg(F.count(F.lit(1)).alias("n"),
                 money(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(0)))).alias("spend"),
                 F.max("merchant_raw").alias("sample"),
                 F.max("card_type").alias("card"),
                 F.max(F.when(F.col("status") == "suggested", F.col("category"))).alias("suggested"),
                 F.max("operation").alias("suggested_operation"),
                 F.max("related_transaction_ids").alias("suggested_related_ids"),
                 F.max("reason").alias("suggested_operation_reason"))
            .orderBy(F.desc("n"), "merchant_key"))


def pending_header(pending: DataFrame) -> DataFrame:
    """Header figures over the pending-merchant list."""
    return pending.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count_if(F.col("suggested").isNotNull()).alias("with_ai"),
        F.count_if(F.col("suggested").isNull()).alias("without_ai"),
    )


def freshness(ledger: DataFrame, deposits: DataFrame, mail_log: DataFrame,
              categories: DataFrame, knowledge: DataFrame) -> DataFrame:
    """One-row freshness report.

    The five inputs are narrowed to one tagged schema, unioned, and reduced by a
    single global aggregate with conditional maxima/counts: no join at all, and
    every input is read once with only the columns it contributes.
    """
    def tagged(df, src, **cols):
        names = ["card_type", "voided", "t", "notify_status", "email_type", "active"]
        types = {"card_type": "string", "voided": "boolean", "t": "timestamp_ntz",
                 "notify_status": "string", "email_type": "string", "active": "int"}
        return df.select(F.lit(src).alias("src"),
                         *[(cols[n] if n in cols else F.lit(None)).cast(types[n]).alias(n) for n in names])

    u = (tagged(ledger, "txn", card_type=F.col("card_type"), voided=F.col("voided"),
                t=F.col("txn_time"), notify_status=F.col("notify_status"))
         .unionByName(tagged(ledger.filter(F.col("notify_status") == "sent"), "sent",
                             t=F.col("notified_at")))
         .unionByName(tagged(deposits, "dep", t=F.col("txn_time")))
         .unionByName(tagged(mail_log, "mail", email_type=F.col("email_type"), t=F.col("fetched_at")))
         .unionByName(tagged(categories, "cat", active=F.col("active")))
         .unionByName(tagged(knowledge, "kn")))
    src = F.col("src")
    live_txn = (src == "txn") & ~F.col("voided")
    return u.agg(
        F.max(F.when(live_txn & (F.col("card_type") == "credit"), F.col("t"))).alias("last_credit_txn"),
        F.max(F.when(live_txn & (F.col("card_type") == "debit"), F.col("t"))).alias("last_debit_txn"),
        F.count_if(src == "sent").alias("notify_sent"),
        F.max(F.when(src == "sent", F.col("t"))).alias("notify_last"),
        F.count_if(src == "dep").alias("deposits_n"),
        F.max(F.when(src == "dep", F.col("t"))).alias("deposits_last"),
        F.max(F.when((src == "mail") & (F.col("email_type") == K.CREDIT_DAILY), F.col("t"))).alias("last_credit_email"),
        F.count_if((src == "cat") & (F.col("active") == 1)).alias("categories_n"),
        F.count_if(src == "kn").alias("knowledge_n"),
    )
