"""Billing periods, reports and the start-day setting (golden rows)."""
from pyspark.sql import functions as F

from tests_support import ledger, ts
from tallyframe.functions.periods import billing_period, clamp_start_day, period_bounds
from tallyframe.operators import reports


def _period(spark, text, day):
    df = spark.createDataFrame([(ts(text),)], "t timestamp_ntz")
    return df.select(billing_period("t", day).alias("p")).first()["p"]


def test_period_boundary_day15(spark):
    assert _period(spark, "2026-07-14 23:59:59", 15) == "2026-06"
    assert _period(spark, "2026-07-15 00:00:00", 15) == "2026-07"


def test_period_year_edge(spark):
    assert _period(spark, "2027-01-10 12:00:00", 15) == "2026-12"
    assert _period(spark, "2027-01-20 12:00:00", 15) == "2027-01"


def test_period_day1_is_calendar_month(spark):
    assert _period(spark, "2026-07-01 00:00:00", 1) == "2026-07"


def test_clamp():
    assert [clamp_start_day(v) for v in (0, 31, "nope", None, "15")] == [1, 28, 1, 1, 15]


def test_period_bounds():
    lo, hi = period_bounds("2026-12", 15)
    assert (lo, hi) == (ts("2026-12-15"), ts("2027-01-15"))


def test_monthly_matrix_day15(spark):
    df = ledger(spark, [{"txn_time": "2026-07-14 10:00:00", "amount": 100.0},
                        {"txn_time": "2026-07-15 10:00:00", "amount": 200.0}])
    cells = {r["m"]: r["spend"] for r in reports.monthly_matrix(df, 15).collect()}
    assert cells == {"2026-06": 100.0, "2026-07": 200.0}


def test_annual_matrix_day15(spark):
    df = ledger(spark, [{"txn_time": "2027-01-10 10:00:00", "amount": 50.0},
                        {"txn_time": "2027-01-20 10:00:00", "amount": 70.0}])
    cells = {r["y"]: r["spend"] for r in reports.annual_matrix(df, 15, "2026").collect()}
    assert cells == {"2026": 50.0, "2027": 70.0}


def test_summary_counts_all_directions_but_spend_filters(spark):
    df = ledger(spark, [{"txn_time": "2026-07-14 10:00:00", "amount": 100.0},
                        {"txn_time": "2026-07-15 10:00:00", "amount": 5.0, "direction": "transfer"},
                        {"txn_time": "2026-07-16 10:00:00", "amount": -20.0, "direction": "refund",
                         "status": "confirmed"}])
    r = reports.summary(df).first()
    assert (r["total"], r["pending"], r["spend"]) == (3, 2, 80.0)


def test_period_list_ignores_void_and_override(spark):
    df = ledger(spark, [{"txn_time": "2026-07-14 10:00:00", "amount": 1.0, "voided": True},
                        {"txn_time": "2026-08-14 10:00:00", "amount": 1.0, "effective_month": "2020-01"}])
    got = sorted(r["m"] for r in reports.period_list(df, 1).collect())
    assert got == ["2026-07", "2026-08"]


def test_share_total_includes_negative(spark):
    df = ledger(spark, [{"txn_time": "2026-07-10", "amount": 100.0, "category": "a"},
                        {"txn_time": "2026-07-11", "amount": -50.0, "category": "b", "direction": "refund"}])
    rows = reports.category_share(df, 1).collect()
    assert len(rows) == 1 and rows[0]["pct"] == 2.0


def test_month_filter_prunes_on_time(spark):
    df = ledger(spark, [{"txn_time": "2026-07-14 10:00:00", "amount": 1.0},
                        {"txn_time": "2026-09-14 10:00:00", "amount": 2.0, "effective_month": "2026-07"},
                        {"txn_time": "2026-08-14 10:00:00", "amount": 4.0}])
    assert reports.summary(df, month="2026-07").first()["spend"] == 3.0
    plan = reports.summary(df, month="2026-07")._jdf.queryExecution().optimizedPlan().toString()
    assert "txn_time" in plan and "2026-07-01" in plan
