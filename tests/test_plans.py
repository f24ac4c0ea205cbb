"""Physical-plan checks: pruning, pushdown, partial aggregation, pre-shuffle top-k."""
import tempfile

from tallyframe import fixtures as fx
from tallyframe.operators import advice as ADV
from tallyframe.operators import listing, reports

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_pushes_month_range_and_prunes_columns(spark):
    path = tempfile.mkdtemp(prefix="tf-plan-") + "/ledger"
    fx.ledger_o(spark, SF).write.parquet(path)
    led = spark.read.parquet(path)
    plan = _plan(listing.ledger_page(led, month="1997-03", start_day=15))
    assert "PushedFilters" in plan and "txn_time" in plan.split("PushedFilters")[1][:600]
    assert "TakeOrderedAndProject" in plan
    rs = _plan(reports.monthly_matrix(led, 15)).split("ReadSchema: ")[1].split("\n")[0]
    assert "fingerprint" not in rs and "merchant_raw" not in rs and "amount" in rs


def test_matrix_aggregates_before_shuffle(spark):
    plan = _plan(reports.monthly_matrix(fx.ledger_o(spark, SF), 1))
    assert plan.count("HashAggregate") >= 2 and "Exchange hashpartitioning" in plan


def test_top20_per_merchant_limits_before_shuffle(spark):
    le = fx.ledger_e(spark, SF)
    plan = _plan(ADV.merchant_recent(le, ADV.open_merchants(le), 20))
    assert "WindowGroupLimit" in plan


def test_partitioned_snapshot_prunes_months_and_keeps_results(spark):
    from pyspark.sql import functions as F

    from tallyframe.sources import sinks
    path = tempfile.mkdtemp(prefix="tf-part-") + "/ledger"
    led = fx.ledger_o(spark, "/root/testdata/sf0.01")
    sinks.write_ledger_snapshot(led, path)
    snap = spark.read.parquet(path)
    for month, day in [("1999-06", 1), ("1997-12", 15), ("1996-02", 28)]:
        a = listing.ledger_page(snap, month=month, start_day=day, limit=10 ** 6).drop("attr_month")
        b = listing.ledger_page(led, month=month, start_day=day, limit=10 ** 6)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert reports.summary(snap, month, day).first() == reports.summary(led, month, day).first()
    plan = _plan(listing.ledger_page(snap, month="1997-12", start_day=15))
    pf = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "attr_month" in pf and "1997-12" in pf and "1998-01" in pf
    y = listing.ledger_page(snap, year="1998", start_day=15, limit=10 ** 6).drop("attr_month")
    assert y.count() == listing.ledger_page(led, year="1998", start_day=15, limit=10 ** 6).count()


def _final(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_pairing_and_sweep_read_and_send_rows_once(spark):
    from tallyframe.operators import matching
    path = tempfile.mkdtemp(prefix="tf-plan-") + "/ledger"
    fx.ledger_e(spark, SF).write.parquet(path)
    led = spark.read.parquet(path)
    links = _final(matching.pair_links(led))
    assert links.count("FileScan") == 1 and links.count("ReusedExchange") >= 3
    assert sum("REPARTITION_BY_COL" in x and "ReusedExchange" not in x for x in links.split("\n")) == 1
    sweep = _final(matching.merge_candidates(led))
    # the ledger was read by the first sweep; what that left is asked by equi-joins only
    assert "FileScan" not in sweep and "NestedLoop" not in sweep and "Cartesian" not in sweep


def test_reports_come_in_order(spark):
    lo, le = fx.ledger_o(spark, SF), fx.ledger_e(spark, SF)
    periods = [r["m"] for r in reports.period_list(lo, 15).collect()]
    assert periods == sorted(periods, reverse=True) and len(periods) > 12
    months = [r["m"] for r in reports.monthly_matrix(lo).collect()]
    assert months == sorted(months, reverse=True)
    years = [r["y"] for r in reports.annual_matrix(lo, 1, "1992").collect()]
    assert years == sorted(years, reverse=True)
    pending = [(-r["n"], r["merchant_key"]) for r in reports.pending_merchants(le, fx.suggestions_e(spark, SF)).collect()]
    assert pending == sorted(pending)
    spend = [r["spend"] for r in reports.monthly_summary(lo, 1, "1996-03").collect()]
    assert spend == sorted(spend, reverse=True)


def test_month_summary_reads_one_month(spark):
    path = tempfile.mkdtemp(prefix="tf-plan-") + "/ledger"
    fx.ledger_o(spark, SF).write.parquet(path)
    plan = _plan(reports.monthly_summary(spark.read.parquet(path), 15, "1997-03"))
    assert "txn_time" in plan.split("PushedFilters")[1][:600]
