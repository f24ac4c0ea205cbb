"""Digest extraction (golden + greedy property), router, alerts, text helpers."""
import random
import re

from pyspark.sql import functions as F

from tallyframe import constants as K
from tallyframe.functions import text as TX
from tallyframe.operators import extract

DIGEST = ("<html><body><table><tr><td>截至昨日最后一笔交易，您的额度和积分信息如下：</td></tr></table>"
          "<div>￥12,345.67</div><div>1,234</div><div>可用额度</div><div>积分余额</div>"
          "<p>2026/06/19&nbsp;您的消费明细如下：</p>"
          "<div>09:00:00</div><div>CNY 10.00</div><div>尾号5678 消费 支付宝-示例 商户</div>"
          "<div>10:30:00</div><div>CNY -25.5</div><div>尾号5678 退货 直连商户</div>"
          "<script>var x='<div>11:00:00</div>';</script></body></html>")


def _extract(spark, html):
    df = spark.createDataFrame([("m1", html)], "source_msg_id string, html string")
    return extract.digest_extract(df).orderBy("txn_time").collect()


def test_digest_golden(spark):
    rows = _extract(spark, DIGEST)
    assert len(rows) == 2
    a, b = rows
    assert (float(a["amount"]), a["action"], a["direction"], a["channel"], a["merchant_key"]) == \
        (10.0, "消费", "expense", "支付宝", "示例 商户")
    assert (float(b["amount"]), b["direction"], b["channel"], b["merchant_key"]) == (-25.5, "refund", None, "直连商户")
    assert str(a["txn_time"]) == "2026-06-19 09:00:00" and a["card_last4"] == "5678"
    assert float(a["avail_credit"]) == 12345.67 and a["points"] == 1234


def test_digest_without_date_has_no_rows(spark):
    assert _extract(spark, "<div>09:00:00</div><div>CNY 1.00</div><div>尾号1234 消费 x</div>") == []


def scan(lines):
    """Plain greedy reading of the digest body rule (time, amount, detail in 3 lines)."""
    out, i, n = [], 0, len(lines)
    while i < n:
        if not re.match(r"^\d{2}:\d{2}:\d{2}$", lines[i]):
            i += 1
            continue
        amt = det = None
        j = i + 1
        while j < n and j <= i + 3:
            if amt is None and re.match(r"^CNY\s*(-?[\d,]+\.\d{1,2})$", lines[j]):
                amt = j
                j += 1
                continue
            if amt is not None and re.match(r"^尾号(\d{4})\s+(\S+)\s+(.+)$", lines[j]):
                det = j
                break
            j += 1
        if amt is not None and det is not None:
            out.append((i, amt, det))
            i = det + 1
        else:
            i += 1
    return out


def test_digest_fold_equals_greedy_scan(spark):
    rnd = random.Random(3)
    kinds = ["09:00:00", "CNY 1.00", "尾号1234 消费 x", "junk"]
    cases = [[rnd.choice(kinds) for _ in range(rnd.randint(0, 14))] for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k int, lines array<string>")
    got = df.select("k", extract.digest_triples(extract.line_kinds(F.col("lines"))).alias("t")).collect()
    for r in got:
        assert [(t["i"], t["ja"], t["jd"]) for t in r["t"]] == scan(cases[r["k"]]), cases[r["k"]]


def test_html_to_lines(spark):
    html = "<style>p{}</style><p>a&amp;b &lt;x&gt;</p><br/>  <td>c&nbsp; d</td><!-- z --><li>&copy;</li>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(TX.html_to_lines("h").alias("l")).first()["l"] == ["a&b <x>", "c d", "©"]


def test_router(spark):
    rows = [(K.CREDIT_DAILY_SENDER, "每日信用管家"), (K.CREDIT_DAILY_SENDER, "信用卡电子账单"),
            ("X <95555@message.cmbchina.com>", "一卡通账户变动通知"), (K.DEBIT_SENDER, "香港账户变动"),
            ("hk@cmbchina.com", "月結單"), ("a@b.c", "限时优惠"), ("a@b.c", "hello")]
    df = spark.createDataFrame(rows, "s string, j string")
    got = [r["t"] for r in df.select(TX.mail_type("s", "j").alias("t")).collect()]
    assert got == ["credit_daily", "credit_statement", "debit_event", "other", "hk_statement", "marketing", "other"]


def test_merchant_split_and_direction(spark):
    df = spark.createDataFrame([("支付宝-示例餐厅",), ("直连商户",), ("未知-x",), ("微信 - ",)], "r string")
    ch, key = TX.merchant_split("r")
    got = [(r["c"], r["k"]) for r in df.select(ch.alias("c"), key.alias("k")).collect()]
    assert got == [("支付宝", "示例餐厅"), (None, "直连商户"), (None, "未知-x"), (None, "微信 -")]
    d = spark.createDataFrame([("退货",), ("???",)], "a string").select(TX.direction_of("a").alias("d")).collect()
    assert [r["d"] for r in d] == ["refund", "other"]


def test_fingerprint_matches_python_format(spark):
    import hashlib
    df = spark.createDataFrame([("1234", "2026-06-19 09:00:00", "-25.5", "m", "消费")],
                               "c string, t string, a string, m string, x string")
    fp = df.select(TX.fingerprint("c", F.col("t").cast("timestamp_ntz"), F.col("a").cast("decimal(18,2)"),
                                  "m", "x").alias("f")).first()["f"]
    assert fp == hashlib.sha1(f"1234|2026-06-19 09:00:00|{-25.5:.2f}|m|消费".encode()).hexdigest()


def test_alert_normalise(spark):
    replies = [
        ("a1", "好的 {\"type\": \"expense\", \"amount\": 12.345, \"card_last4\": \" 1234 \", \"counterparty\": \"店\"} 完"),
        ("a2", "{\"type\": \"income\", \"amount\": 100, \"kind\": \"工资\"}"),
        ("a3", "{\"type\": \"ignore\"}"),
        ("a4", "{\"type\": \"bogus\", \"amount\": 1}"),
        ("a5", "{\"type\": \"expense\"}"),
        ("a6", "no json at all"),
        ("a7", "{\"type\": \"transfer_out\", \"amount\": 0}"),
    ]
    df = spark.createDataFrame([(i, r) for i, r in replies], "source_msg_id string, reply string") \
        .withColumn("received", F.lit("2026-06-19 08:07:06").cast("timestamp_ntz"))
    got = {r["source_msg_id"]: r for r in extract.alert_normalise(df).collect()}
    assert set(got) == {"a1", "a2", "a4", "a5", "a6"}
    assert (got["a1"]["amount"], got["a1"]["card_last4"], got["a1"]["txn_time"]) == (12.35, "1234", "2026-06-19 08:07")
    assert got["a4"]["error"] == "invalid type" and got["a5"]["error"] == "missing amount"
    assert got["a6"]["error"] == "invalid type"
    dep, led = extract.alert_route(extract.alert_normalise(df), "debit")
    assert [r["source_msg_id"] for r in dep.collect()] == ["a2"]
    r = led.first()
    assert (r["merchant_raw"], r["direction"], r["action"]) == ("店", "expense", "消费")
