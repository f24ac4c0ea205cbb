"""Driver contract: entry runs; every key has a callable; oracle SQL agrees at sf0.001."""
import collections
import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyframe.sources.tables import DRIVER_TABLES, table_path

SF = "/root/testdata/sf0.001"
ROWS_ONLY: set = set()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"m", "c", "spend", "n"}
    assert df.count() >= 0


def test_every_key_has_oracle_or_is_rows_only():
    assert set(entry.REGISTRY) - set(entry.oracle_sql()) == ROWS_ONLY


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_oracle_agrees_on_smoke_data(spark):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    keys = ["netted_monthly_matrix", "refund_pairs", "merge_candidates", "digest_extract", "html_to_lines",
            "classify_apply", "merge_net", "notify_digest", "reimbursement_match", "alert_normalise"]
    for k in keys:
        df = entry.queries()[k](spark, SF)
        cur = con.execute(entry.oracle_sql()[k])
        dcols = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(dcols), k
        assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(dcols, cur.fetchall()), k


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_survey_check_values(spark):
    from tallyframe import fixtures as fx
    from tallyframe.operators import matching, reports
    le, lo = fx.ledger_e(spark, SF), fx.ledger_o(spark, SF)
    assert (le.count(), lo.count()) == (1000, 1500)
    assert matching.refund_pairs(le).count() == 7
    assert matching.merge_candidates(lo, 15).count() == 71
    assert reports.monthly_matrix(lo, 15).count() == 372
    assert reports.monthly_matrix(le, 15).count() == 10
    assert matching.refund_pairs(lo).count() == 0
