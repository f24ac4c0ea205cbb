"""Billing-period column functions.

A billing period is labelled 'YYYY-MM'. With start day 1 it is the calendar
month; with start day d > 1 a timestamp belongs to the period whose label is the
month of (date - (d - 1) days), i.e. the period runs from day d of the labelled
month to day d - 1 of the next month. The start day is a plain argument of every
operator; nothing is global.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_start_day(value) -> int:
    """Start day as configured: integers clamp to [1, 28]; anything else is 1."""
    try:
        d = int(value)
    except (TypeError, ValueError):
        return 1
    return max(1, min(28, d))


def clamp_start_day_col(c: Column) -> Column:
    """Column form of :func:`clamp_start_day` for a settings table."""
    d = F.trim(c.cast("string")).try_cast("int")
    return F.when(d.isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(28), d)))


def billing_period(ts: Column | str, start_day: int = 1) -> Column:
    """'YYYY-MM' billing period of a timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    d = clamp_start_day(start_day)
    if d <= 1:
        return F.date_format(ts, "yyyy-MM")
    return F.date_format(F.date_sub(F.to_date(ts), d - 1), "yyyy-MM")


def attribution_month(ts: Column | str = "txn_time", start_day: int = 1,
                      effective: Column | str = "effective_month") -> Column:
    """Month a row counts in: explicit override, else its billing period."""
    eff = F.col(effective) if isinstance(effective, str) else effective
    return F.coalesce(eff, billing_period(ts, start_day))


def attribution_year(ts: Column | str = "txn_time", start_day: int = 1) -> Column:
    """First four characters of the attribution month."""
    return F.substring(attribution_month(ts, start_day), 1, 4)


def period_start(label: Column | str, start_day: int = 1) -> Column:
    """First date of a billing period label."""
    label = F.col(label) if isinstance(label, str) else label
    d = clamp_start_day(start_day)
    y = F.substring(label, 1, 4).cast("int")
    m = F.substring(label, 6, 2).cast("int")
    return F.make_date(y, m, F.lit(d))


def period_end(label: Column | str, start_day: int = 1) -> Column:
    """Last date of a billing period label (B12): next start minus one day."""
    return F.date_sub(F.add_months(period_start(label, start_day), 1), 1)


def period_bounds(label: str, start_day: int = 1) -> tuple[_dt.datetime, _dt.datetime]:
    """Half-open ``[lo, hi)`` txn_time range of one period label.

    Used to turn a period predicate into a range predicate on ``txn_time`` that
    Parquet row-group statistics and partition pruning can serve.
    """
    d = clamp_start_day(start_day)
    y, m = int(label[:4]), int(label[5:7])
    lo = _dt.datetime(y, m, d)
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    hi = _dt.datetime(ny, nm, d)
    return lo, hi


def ts_lit(v: _dt.datetime) -> Column:
    """TIMESTAMP_NTZ literal (keeps comparisons on NTZ columns cast-free)."""
    return F.lit(v.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def in_attribution_month(month: str, start_day: int = 1, ts: str = "txn_time",
                         effective: str = "effective_month") -> Column:
    """``coalesce(effective_month, period(ts)) = month`` written so the time part prunes.

    Rows without an override match on a ``txn_time`` range; rows with an override
    match on the override alone. Both halves are plain comparisons that reach
    the scan as pushed filters.
    """
    lo, hi = period_bounds(month, start_day)
    t = F.col(ts)
    eff = F.col(effective)
    return (eff == F.lit(month)) | (eff.isNull() & (t >= ts_lit(lo)) & (t < ts_lit(hi)))


def in_attribution_year(year: str, start_day: int = 1, ts: str = "txn_time",
                        effective: str = "effective_month") -> Column:
    """``substr(attribution_month, 1, 4) = year`` with a prunable time range."""
    lo, _ = period_bounds(f"{year}-01", start_day)
    _, hi = period_bounds(f"{year}-12", start_day)
    t = F.col(ts)
    eff = F.col(effective)
    return (F.substring(eff, 1, 4) == F.lit(year)) | (
        eff.isNull() & (t >= ts_lit(lo)) & (t < ts_lit(hi)))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, independent of the session time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


PARTITION_COL = "attr_month"


def next_month(label: str) -> str:
    y, m = int(label[:4]), int(label[5:7])
    return f"{y + 1}-01" if m == 12 else f"{y}-{m + 1:02d}"


def partition_month(ts: Column | str = "txn_time", effective: Column | str = "effective_month") -> Column:
    """Partition value of a ledger row: its override month, else its calendar month."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    eff = F.col(effective) if isinstance(effective, str) else effective
    return F.coalesce(eff, F.date_format(ts, "yyyy-MM"))


def partition_months_for(month: str, start_day: int = 1) -> list[str]:
    """Partitions that can hold rows attributed to billing period ``month``.

    A row without override has calendar month ``month`` or the next one (the
    period runs from day d of ``month`` to day d-1 of the next); a row with
    override ``month`` is stored in partition ``month``.
    """
    return [month] if clamp_start_day(start_day) <= 1 else [month, next_month(month)]


def partition_filter(df_columns: list[str], month: str | None = None, year: str | None = None,
                     start_day: int = 1) -> Column | None:
    """Partition-only conjunct for a month/year predicate on a snapshot partitioned
    by :data:`PARTITION_COL`; None when the frame has no such column."""
    if PARTITION_COL not in df_columns:
        return None
    c = F.col(PARTITION_COL)
    if month:
        return c.isin(*partition_months_for(month, start_day))
    if year:
        last = partition_months_for(f"{year}-12", start_day)[-1]
        return (c >= F.lit(f"{year}-01")) & (c <= F.lit(last))
    return None
