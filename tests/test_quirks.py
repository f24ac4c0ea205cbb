"""One test per semantic quirk not covered elsewhere."""
import re

from pyspark.sql import functions as F

from tests_support import ledger
from tallyframe.operators import advice as ADV
from tallyframe.operators import commands as CMD
from tallyframe.operators import extract, listing, matching, notify


def test_q5_merchant_updates_ignore_voided(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01", "amount": 1.0, "merchant_key": "s", "voided": True}])
    dec = spark.createDataFrame([("s", "餐饮")], "merchant_key string, category string")
    r = ADV.merchant_suggest(df, dec).first()
    assert (r["status"], r["category"]) == ("suggested", "餐饮")


def test_q6_restore_keeps_links_and_partner(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01 10:00:00", "amount": 50.0},
                        {"txn_time": "2026-01-02 10:00:00", "amount": -50.0, "direction": "refund"}])
    paired = matching.apply_pairing(df)
    c = spark.createDataFrame([(2, 1, "restore", None)], "txn_id bigint, seq bigint, op string, payload string")
    out = {r["id"]: (r["voided"], r["offset_of"]) for r in CMD.apply_edits(paired, c).collect()}
    assert out == {1: (True, 2), 2: (False, 1)}


def test_q7_transfer_out_is_booked_as_expense(spark):
    df = spark.createDataFrame([("a1", "{\"type\": \"transfer_out\", \"amount\": 88, \"counterparty\": \"张三\", "
                                       "\"channel\": \"银联\"}")], "source_msg_id string, reply string") \
        .withColumn("received", F.lit("2026-06-19 08:07:06").cast("timestamp_ntz"))
    _, led = extract.alert_route(extract.alert_normalise(df), "debit")
    r = led.first()
    assert (r["direction"], r["action"], r["merchant_raw"]) == ("expense", "转账", "张三")


def test_q13_like_folds_ascii_only(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01", "amount": 1.0, "merchant_raw": "ABC"},
                        {"txn_time": "2026-01-02", "amount": 1.0, "merchant_raw": "Äpfel"}])
    assert listing.ledger_page(df, q="b").count() == 1
    assert listing.ledger_page(df, q="äpfel").count() == 0
    assert listing.ledger_page(df, q="A_C").count() == 1


def test_q17_backfill_cutoff_is_explicit(spark):
    df = ledger(spark, [{"txn_time": "2025-12-01", "amount": 1.0}, {"txn_time": "2026-01-05", "amount": 2.0}])
    empty = spark.createDataFrame([], "transaction_id bigint, operation string, related_transaction_ids string, "
                                      "reason string")
    assert notify.notify_queue(df, empty).count() == 2
    assert [r["id"] for r in notify.notify_queue(df, empty, backfill_before="2026-01-01 00:00:00").collect()] == [2]


def test_q18_split_children_do_not_inherit_category_or_month(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01 10:00:00", "amount": 100.0, "category": "a",
                         "effective_month": "2025-12", "points": 5}])
    sp = spark.createDataFrame([(1, 1, [40.0, 60.0])], "request_id bigint, txn_id bigint, amounts array<double>")
    _, kids, _ = CMD.split_apply(df, sp)
    for r in kids.collect():
        assert (r["category"], r["effective_month"], r["points"], r["status"]) == (None, None, None, "pending")


def test_q15_unicode_white_space_like_python(spark):
    from tallyframe.functions import text as TX
    html = "<div>　 a  b 　</div><div>　</div><div>尾号1234　消费　店 名</div>"
    df = spark.createDataFrame([(html,)], "h string")
    lines = df.select(TX.html_to_lines("h").alias("l")).first()["l"]
    # Python's own reading: str.strip() is Unicode-aware, the inner collapse is [ \t\xa0]+
    py = [re.sub(r"[ \t\xa0]+", " ", ln).strip()
          for ln in html.replace("</div>", "\n").replace("<div>", " ").split("\n") if ln.strip()]
    assert lines == py
    from tallyframe import constants as K
    got = spark.createDataFrame([(lines[1],)], "s string").select(
        F.regexp_extract("s", K.RE_DETAIL, 3).alias("m")).first()["m"]
    assert got == "店 名"
