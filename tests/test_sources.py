"""Mail search, watermark scans and log upserts on small inputs."""
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import notify
from tallyframe.sources import mail

MAILS = [(1, "m1", "2026-01-01 10:00:00", "A <ccsvc@message.cmbchina.com>", "每日信用管家"),
         (2, "m2", "2026-01-05 10:00:00", "95555@message.cmbchina.com", "一卡通账户变动通知"),
         (3, "m2", "2026-01-06 10:00:00", "95555@message.cmbchina.com", "一卡通账户变动通知"),
         (4, "m4", "2026-01-07 10:00:00", "x@y.z", "hi")]


def _mails(spark):
    return spark.createDataFrame(MAILS, "uid bigint, msg_id string, r string, sender string, subject string") \
        .withColumn("received", F.col("r").cast("timestamp_ntz")).drop("r")


def test_search_requires_a_sender(spark):
    with pytest.raises(ValueError):
        mail.mail_search(_mails(spark), [])


def test_search_union_and_since(spark):
    m = _mails(spark)
    s = ["ccsvc@message.cmbchina.com", "95555@message.cmbchina.com"]
    got = sorted(r["uid"] for r in mail.mail_search(m, s, since="2026/01/02").collect())
    assert got == [2, 3] == sorted(r["uid"] for r in mail.sender_union(m, s, since="2026/01/02").collect())


def test_watermark_then_newest_n(spark):
    m = _mails(spark)
    assert [r["uid"] for r in mail.scan_newest_n(m, 1, 2).collect()] == [4, 3]
    assert mail.next_watermark(mail.incremental_scan(m, 4), 4).first()["last_uid"] == 4


def test_dedup_first_and_upsert_last(spark):
    m = _mails(spark)
    log = m.filter("uid = 1")
    assert sorted((r["msg_id"], r["uid"]) for r in mail.mail_dedup(m, log).collect()) == [("m2", 2), ("m4", 4)]
    up = mail.mail_log_upsert(log.select("msg_id", "uid"), m.filter("uid > 1").select("msg_id", "uid"))
    assert sorted((r["msg_id"], r["uid"]) for r in up.collect()) == [("m1", 1), ("m2", 3), ("m4", 4)]


def test_digest_summary(spark):
    q = spark.createDataFrame([(1, "pending"), (2, "confirmed"), (3, "suggested")], "id bigint, status string")
    assert tuple(notify.digest_summary(q).first()) == (3, 2)


def test_insert_ignore_stats(spark):
    from tallyframe.sources import ingest
    led = spark.createDataFrame([("f1",)], "fingerprint string")
    batch = spark.createDataFrame([("f1", 1), ("f2", 2), ("f2", 3), ("f3", 4)], "fingerprint string, arrival int")
    ins = ingest.txn_insert_ignore(led, batch)
    assert sorted(r["fingerprint"] for r in ins.collect()) == ["f2", "f3"]
    assert [r["arrival"] for r in ins.filter("fingerprint = 'f2'").collect()] == [2]
    assert tuple(ingest.batch_stats(batch, ins).first()) == (2, 2, 2)


def test_received_local_and_fallback(spark):
    from tallyframe.functions import text as TX
    df = spark.createDataFrame([("2026-06-19 00:30:00",), (None,)], "r string") \
        .select(F.col("r").cast("timestamp_ntz").alias("r"))
    got = [str(x["t"]) for x in df.select(
        TX.received_local("r", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("t")).collect()]
    assert got == ["2026-06-19 08:30:00", "2026-01-01 00:00:00"]


def test_json_export_round_trip(spark):
    import json
    import tempfile

    from tallyframe.sources import sinks
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, -2.0)], "id bigint, c string, amount double")
    rows = [json.loads(r["json"]) for r in sinks.as_json_rows(df).collect()]
    assert rows == [{"id": 1, "c": "a", "amount": 1.5}, {"id": 2, "amount": -2.0}]
    path = tempfile.mkdtemp(prefix="tf-json-") + "/out"
    sinks.write_json(df, path)
    back = spark.read.schema("id bigint, c string, amount double").json(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
