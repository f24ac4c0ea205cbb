"""Streaming ingest equals the batch plan on in-order data; streaming spend matrix."""
import tempfile

from pyspark.sql import functions as F

from tallyframe import fixtures as fx
from tallyframe.operators import extract, matching, reports
from tallyframe.streaming import ingest as ST

SF = "/root/testdata/sf0.001"


def _mails(spark):
    d = fx.digests_e(spark, SF)
    return d.select(F.xxhash64("source_msg_id").alias("uid"), F.col("source_msg_id").alias("msg_id"),
                    F.lit(None).cast("timestamp_ntz").alias("received"), "sender", "subject", "html",
                    F.lit(None).cast("string").alias("text"),
                    F.to_date(F.regexp_extract("source_msg_id", r"-(\d{8})-", 1), "yyyyMMdd").alias("d"))


def test_stream_equals_batch_on_in_order_data(spark):
    root = tempfile.mkdtemp(prefix="tf-stream-")
    mails = _mails(spark)
    drop = f"{root}/drop"
    # three drops in time order (days 1-10, 11-20, 21-31), plus one re-delivered drop
    for i, (lo, hi) in enumerate([(1, 10), (11, 20), (21, 31)]):
        part = mails.filter(F.dayofmonth("d").between(lo, hi)).drop("d")
        part.coalesce(1).write.parquet(f"{drop}/f{i}")
    mails.filter(F.dayofmonth("d") <= 3).drop("d").coalesce(1).write.parquet(f"{drop}/f3")
    q = ST.start_ingest(spark, f"{drop}/*", f"{root}/state", f"{root}/ckpt",
                        trigger={"availableNow": True}, max_files_per_trigger=1)
    q.awaitTermination(600)
    assert q.exception() is None
    led = ST.current_ledger(spark, f"{root}/state")

    batch_txns = extract.digest_extract(fx.digests_e(spark, SF))
    assert sorted(r[0] for r in led.select("fingerprint").collect()) == \
        sorted(r[0] for r in batch_txns.select("fingerprint").distinct().collect())

    batch_ledger = ST._ledger_rows(batch_txns.dropDuplicates(["fingerprint"]))
    want = {(r["refund_id"], r["expense_id"]) for r in matching.refund_pairs(batch_ledger).collect()}
    got = {(r["id"], r["offset_of"]) for r in led.filter(F.col("direction") == "refund")
           .filter(F.col("offset_of").isNotNull()).collect()}
    assert got == want and len(want) > 0

    log = ST._read_or_empty(spark, f"{root}/state/mail_log", ST.LOG_DDL)
    assert log.count() == mails.count()  # the re-delivered drop is skipped by msg_id


def test_streaming_spend_matrix_update_mode(spark):
    root = tempfile.mkdtemp(prefix="tf-matrix-")
    le = fx.ledger_e(spark, SF)
    le.write.parquet(f"{root}/ledger")
    stream = spark.readStream.schema(le.schema).parquet(f"{root}/ledger")
    q = (ST.streaming_spend_matrix(stream, 15).writeStream.outputMode("update").format("memory")
         .queryName("spend_cells").option("checkpointLocation", f"{root}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r["m"], r["c"]): r["spend"] for r in spark.table("spend_cells").collect()}
    want = {(r["m"], r["c"]): r["spend"] for r in reports.monthly_matrix(le, 15).collect()}
    assert got == want


def test_replayed_batch_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="tf-replay-")
    mails = _mails(spark).drop("d").cache()
    ST.process_batch(spark, mails, 0, f"{root}/state")
    first = sorted(r[0] for r in ST.current_ledger(spark, f"{root}/state").select("fingerprint").collect())
    ST.process_batch(spark, mails, 0, f"{root}/state")  # the same batch again after a failure
    again = sorted(r[0] for r in ST.current_ledger(spark, f"{root}/state").select("fingerprint").collect())
    assert first == again and len(first) > 0


def test_notify_step_marks_only_after_successful_send(spark):
    root = tempfile.mkdtemp(prefix="tf-notify-")
    mails = _mails(spark).drop("d")
    ST.process_batch(spark, mails, 0, f"{root}/state")
    n_live = ST.current_ledger(spark, f"{root}/state").filter(~F.col("voided")).count()
    assert not ST.notify_step(spark, f"{root}/state", 0, lambda lines: False, "2024-02-01 00:00:00")
    assert ST.current_ledger(spark, f"{root}/state").filter(F.col("notify_status") == "sent").count() == 0
    seen = {}
    assert ST.notify_step(spark, f"{root}/state", 1, lambda lines: seen.setdefault("n", lines.count()) >= 0,
                          "2024-02-01 00:00:00")
    led = ST.current_ledger(spark, f"{root}/state")
    assert led.filter(F.col("notify_status") == "sent").count() == n_live and seen["n"] >= n_live
    # a retry of the batch sends and marks the same rows again; nothing is lost
    again = []
    assert ST.notify_step(spark, f"{root}/state", 1, lambda lines: again.append(lines.count()) is None, "2024-02-01 00:00:00")
    led = ST.current_ledger(spark, f"{root}/state")
    assert again == [seen["n"]] and led.filter(F.col("notify_status") == "sent").count() == n_live
    # nothing left to send in the next cycle: an empty digest is not sent
    called = []
    assert ST.notify_step(spark, f"{root}/state", 2, lambda lines: called.append(1), "2024-02-02 00:00:00") and not called


def test_plugged_parser_route(spark):
    from tallyframe import constants as K
    from tallyframe.functions.text import fingerprint
    from tallyframe.operators import extract as EX
    root = tempfile.mkdtemp(prefix="tf-route-")
    mails = spark.createDataFrame(
        [(1, "x1", "bank@other.example", "card alert", "2026-01-01 10:00:00|12.50|Shop A")],
        "uid bigint, msg_id string, sender string, subject string, text string") \
        .withColumn("received", F.lit(None).cast("timestamp_ntz")).withColumn("html", F.lit(None).cast("string"))

    def parse(m):
        parts = F.split("text", r"\|")
        rows = m.select("source_msg_id", F.lit("9999").alias("card_last4"), F.lit("credit").alias("card_type"),
                        parts[0].cast("timestamp_ntz").alias("txn_time"),
                        parts[1].cast("decimal(18,2)").alias("amount"), F.lit(K.EXPENSE_ACTION).alias("action"),
                        F.lit("expense").alias("direction"), parts[2].alias("merchant_raw"),
                        parts[2].alias("merchant_key"))
        return rows.withColumn("fingerprint", fingerprint("card_last4", "txn_time", "amount", "merchant_raw", "action"))

    routes = EX.DEFAULT_ROUTES + ({"card_type": "credit", "output": "transactions", "name": "other_bank",
                                    "match": lambda: F.col("sender").contains("other.example"), "parse": parse},)
    ST.process_batch(spark, mails, 0, f"{root}/state", routes)
    led = ST.current_ledger(spark, f"{root}/state").collect()
    assert [(r["merchant_key"], float(r["amount"])) for r in led] == [("Shop A", 12.5)]


ALERT = ("95555@message.cmbchina.com", "一卡通账户变动通知")


def _alert_mails(spark, n=6):
    rows = [(i, f"a{i}", None, *ALERT, None, f"alert {i}") for i in range(n)]
    return spark.createDataFrame(rows, "uid bigint, msg_id string, received timestamp_ntz, sender string, subject string, "
                                 "html string, text string").withColumn(
        "received", F.lit("2026-03-01 08:00:00").cast("timestamp_ntz"))


def _interpret(broken=()):
    def run(pdf):
        out = []
        for text in pdf["text"]:
            i = int(text.split()[1])
            kind = ("income", "expense", "ignore", "transfer_out", "expense", "income")[i]
            time = "昨天 12:30" if i == 4 else "2026-03-01 07:30"
            out.append("no idea" if i in broken else
                       f'{{"type": "{kind}", "card_last4": "1111", "amount": {10 + i}, "time": "{time}", "counterparty": "c{i}"}}')
        return out
    return run


def test_alerts_reach_the_ledger_and_deposits(spark):
    state = tempfile.mkdtemp(prefix="tf-alert-") + "/state"
    mails = _alert_mails(spark)
    ST.process_batch(spark, mails, 0, state, interpret=_interpret(broken=(1, 5)))
    led = {r["source_msg_id"]: r for r in ST.current_ledger(spark, state).collect()}
    assert set(led) == {"a3", "a4"} and str(led["a4"]["txn_time"]) == "2026-03-01 08:00:00"  # unreadable time: received
    dep = ST.current_deposits(spark, state).collect()
    assert [(r["source_msg_id"], r["raw_text"], float(r["amount"])) for r in dep] == [("a0", "alert 0", 10.0)]
    log = {r["msg_id"]: r["status"] for r in ST._read_or_empty(spark, f"{state}/mail_log", ST.LOG_DDL).collect()}
    assert log == {"a0": "parsed", "a2": "skipped", "a3": "parsed", "a4": "parsed"}  # failed ones stay out and wait
    ST.process_batch(spark, mails, 1, state, interpret=_interpret())  # re-delivered, and the waiting ones
    assert {r[0] for r in ST.current_ledger(spark, state).select("source_msg_id").collect()} == {"a1", "a3", "a4"}
    assert {r[0] for r in ST.current_deposits(spark, state).select("source_msg_id").collect()} == {"a0", "a5"}
    totals = {r["total"]: r["n"] for r in ST.run_totals(spark, state, 1).collect()}
    assert totals == {"inserted": 1, "pending": 1, "income": 1, "debit_event:parsed": 2, "already_seen": 4}


def test_corrupt_state_stops_the_batch(spark):
    import os

    import pytest
    state = tempfile.mkdtemp(prefix="tf-corrupt-") + "/state"
    ST.process_batch(spark, _alert_mails(spark), 0, state, interpret=_interpret())
    for folder, _, names in os.walk(f"{state}/rows/batch=0"):
        for name in names:
            if name.endswith(".parquet"):
                with open(f"{folder}/{name}", "wb") as f:
                    f.write(b"not parquet")
    # other mails that bring the same transactions: the parts they touch must be read
    again = _alert_mails(spark).withColumn("msg_id", F.concat(F.lit("b"), "msg_id"))
    with pytest.raises(Exception, match="(?i)parquet|footer|magic|corrupt"):
        ST.process_batch(spark, again, 1, state, interpret=_interpret())


def test_cycle_suggests_and_notifies_and_survives_their_failure(spark):
    import pandas as pd
    root = tempfile.mkdtemp(prefix="tf-cycle-")
    _alert_mails(spark).coalesce(1).write.parquet(f"{root}/drop/f0")
    cats = spark.createDataFrame([("food", "k", 1)], "name string, key string, active int")

    def classifier(pdf):
        keys = sorted(set(pdf["merchant_key"]))
        return pd.DataFrame({"adv_key": keys, "category": ["food"] * len(keys), "operation": [None] * len(keys),
                             "related_ids": [None] * len(keys), "reason": [None] * len(keys)})

    sent = []
    q = ST.start_ingest(spark, f"{root}/drop/*", f"{root}/state", f"{root}/ckpt", trigger={"availableNow": True},
                        interpret=_interpret(), classifier=classifier, categories=cats,
                        send=lambda lines: sent.append(lines.count()) is None, now=lambda: "2026-03-01 09:00:00")
    q.awaitTermination(300)
    assert q.exception() is None and sent == [3]
    led = ST.current_ledger(spark, f"{root}/state").collect()
    assert {(r["category"], r["status"], r["notify_status"]) for r in led} == {("food", "suggested", "sent")}

    def broken(*_):
        raise RuntimeError("down")

    q = ST.start_ingest(spark, f"{root}/drop/*", f"{root}/state2", f"{root}/ckpt2", trigger={"availableNow": True},
                        interpret=_interpret(), classifier=broken, categories=cats, send=broken)
    q.awaitTermination(300)
    assert q.exception() is None and ST.current_ledger(spark, f"{root}/state2").count() == 3


def test_compacted_state_is_the_same(spark):
    root = tempfile.mkdtemp(prefix="tf-compact-")
    mails = _alert_mails(spark)
    for i in range(3):
        ST.process_batch(spark, mails.filter(F.col("uid") % 3 == i), i, f"{root}/a", interpret=_interpret(broken=(5,)))
    ST.notify_step(spark, f"{root}/a", 2, lambda lines: True, "2026-03-01 09:00:00")
    ST.compact_state(spark, f"{root}/a", f"{root}/b")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(ST.current_ledger(spark, f"{root}/a")) == key(ST.current_ledger(spark, f"{root}/b"))
    for state in ("a", "b"):
        ST.process_batch(spark, mails, 3, f"{root}/{state}", interpret=_interpret())
    assert key(ST.current_ledger(spark, f"{root}/a")) == key(ST.current_ledger(spark, f"{root}/b"))
    assert key(ST.current_deposits(spark, f"{root}/a")) == key(ST.current_deposits(spark, f"{root}/b"))
    assert ST.current_deposits(spark, f"{root}/b").count() == 2
