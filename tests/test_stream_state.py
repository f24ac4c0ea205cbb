"""State index, stateful pairing, streaming dedup, the mailbox source, stages as queries of their own."""
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from tests_support import ledger

from tallyframe.operators import matching
from tallyframe.streaming import ingest as ST
from tallyframe.streaming import mailbox, pairing, state
from tallyframe.streaming.dedup import first_deliveries

ONCE = {"availableNow": True}


def finish(q, fails=False):
    try:
        q.awaitTermination(300)
    except Exception:  # noqa: BLE001 - a failed query raises here
        assert fails
    assert (q.exception() is not None) == fails, q.exception()


def files_of(df):
    """Files whose rows a read returns."""
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


# ---- the index -------------------------------------------------------------------


def test_only_touched_parts_are_read(spark):
    path = tempfile.mkdtemp(prefix="tf-index-") + "/t"
    ddl = "k string, v bigint"
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    for b in range(3):
        state.write_state(rows.filter(F.col("v") % 3 == b), path, ddl, b, ["k"], depth=2)
    few = rows.filter("v in (17, 4000)")
    touched = state.touched_parts(few, ["k"])
    got = state.read_state(spark, path, ddl, 3, touched=touched)
    assert {r.v for r in got.join(few.select("k"), "k", "left_semi").collect()} == {17, 4000}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(files_of(got)) <= 2 * 3 < len(files_of(state.read_state(spark, path, ddl, 3))) / 10
    assert state.touched_parts(rows, ["k"]) is None  # too many parts: no filter
    assert state.read_state(spark, path + "-none", ddl, 3).count() == 0


def test_depth_follows_the_size():
    assert [state.depth_for(n, 1000) for n in (0, 16_000, 16_001, 300_000, 10 ** 9)] == [1, 1, 2, 3, 4]


def test_reads_of_a_batch_stay_flat(spark):
    """Twenty batches of eight keys, compacted now and then: a late batch reads no more of the state than an early one."""
    root = tempfile.mkdtemp(prefix="tf-flat-")
    ddl = "k string, v bigint"
    read, where = [], f"{root}/s0"
    for b in range(20):
        if b and b % 5 == 0:
            whole = state.read_state(spark, where, ddl)
            state.rewrite(whole, f"{root}/s{b}", ddl, b - 1, ["k"], rows_per_part=2)
            where = f"{root}/s{b}"
        rows = spark.range(8 * b, 8 * b + 8).select(F.concat(F.lit("m"), "id").alias("k"), F.col("id").alias("v"))
        got = state.read_state(spark, where, ddl, b, touched=state.touched_parts(rows, ["k"]))
        read.append(sum(os.path.getsize(f.removeprefix("file://")) for f in files_of(got)))
        assert got.join(rows.select("k"), "k", "left_semi").isEmpty()
        state.write_state(rows, where, ddl, b, ["k"])
    assert state.read_state(spark, where, ddl).count() == 160
    # what a batch reads: the parts of its eight keys, and the batches since the last compaction
    assert max(read[15:]) <= 1.5 * max(read[5:10]), read


# ---- stateful pairing ------------------------------------------------------------


def pair_in_batches(spark, batches, opened=None):
    root = tempfile.mkdtemp(prefix="tf-pairs-")
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", "1").parquet(f"{root}/in/*")
    for i, df in enumerate(batches):  # the query is started anew for each batch: state survives in the checkpoint
        df.coalesce(1).write.parquet(f"{root}/in/{i}")
        finish(pairing.start_pairing(stream, f"{root}/out", f"{root}/ckpt", ONCE, opened))
    return [(r.refund_id, r.expense_id) for r in spark.read.parquet(f"{root}/out").collect()]


def test_streamed_pairs_equal_batch_pairs_in_order_of_time(spark):
    rng = random.Random(4)
    rows = [{"txn_time": f"2026-01-{1 + i // 10:02d} {i % 10:02d}:00:00", "amount": (-1 if (r := rng.random() < 0.45) else 1) * rng.choice([10, 20]),
             "direction": "refund" if r else "expense", "merchant_key": rng.choice(["a", "b", None]), "voided": rng.random() < 0.1} for i in range(200)]
    led = ledger(spark, rows)
    want = {(r.refund_id, r.expense_id) for r in matching.refund_pairs(led).collect()}
    got = pair_in_batches(spark, [led.filter(F.dayofmonth("txn_time").between(a, b)) for a, b in ((1, 6), (7, 13), (14, 31))])
    assert len(got) == len(set(got)) == len(want) > 20 and set(got) == want


def test_late_rows_pair_with_what_is_open(spark):
    led = ledger(spark, [
        {"txn_time": "2026-01-05 10:00:00", "amount": 10.0}, {"txn_time": "2026-01-06 10:00:00", "amount": -10.0, "direction": "refund"},
        {"txn_time": "2026-01-07 10:00:00", "amount": -10.0, "direction": "refund"},
        {"txn_time": "2026-01-04 10:00:00", "amount": 10.0},    # late: the refund of the 7th is still open
        {"txn_time": "2026-01-05 11:00:00", "amount": 10.0}])   # later still: all refunds are taken
    assert sorted(pair_in_batches(spark, [led.filter("id <= 3"), led.filter("id = 4"), led.filter("id = 5")])) == [(2, 1), (3, 4)]


def test_pairing_goes_on_from_an_opened_ledger(spark):
    old = ledger(spark, [{"txn_time": "2026-01-05 10:00:00", "amount": 10.0}, {"txn_time": "2026-01-05 10:00:00", "amount": 7.0, "voided": True}])
    new = ledger(spark, [{"id": 11, "txn_time": "2026-02-01 10:00:00", "amount": -10.0, "direction": "refund"},
                         {"id": 12, "txn_time": "2026-02-01 10:00:00", "amount": -7.0, "direction": "refund"}])
    assert pair_in_batches(spark, [new], opened=old) == [(11, 1)]


# ---- dedup and the mailbox --------------------------------------------------------

MAILS = "uid bigint, msg_id string, received timestamp_ntz"


def mails_of(spark, rows):
    return spark.createDataFrame([(u, m, t) for u, m, t in rows], "uid bigint, msg_id string, t string").select(
        "uid", "msg_id", F.col("t").cast("timestamp_ntz").alias("received"))


def deliver(spark, batches, **how):
    root = tempfile.mkdtemp(prefix="tf-dedup-")
    stream = spark.readStream.schema(MAILS).option("maxFilesPerTrigger", "1").parquet(f"{root}/in/*")
    for i, rows in enumerate(batches):
        mails_of(spark, rows).coalesce(1).write.parquet(f"{root}/in/{i}")
        finish(first_deliveries(stream, **how).writeStream.format("parquet").option("path", f"{root}/out")
               .option("checkpointLocation", f"{root}/ckpt").trigger(**ONCE).start())
    return sorted((r.uid, r.msg_id) for r in spark.read.parquet(f"{root}/out").collect())


def test_a_message_passes_once(spark):
    batches = [[(1, "a", "2026-01-05 10:00:00"), (2, "b", None)], [(3, "a", "2026-01-06 10:00:00"), (4, "c", "2020-01-01 00:00:00")],
               [(5, "b", None), (6, "c", "2026-01-07 10:00:00"), (7, "d", "2019-01-01 00:00:00")]]
    # by time of arrival nothing is late: old mails and mails without a time pass, once
    assert deliver(spark, batches) == [(1, "a"), (2, "b"), (4, "c"), (7, "d")]


def test_a_time_column_forgets_and_drops_late_mails(spark):
    batches = [[(1, "a", "2026-01-05 10:00:00")], [(2, "x", "2026-01-20 10:00:00")],
               [(3, "late", "2026-01-06 10:00:00"), (4, "a", "2026-01-21 10:00:00"), (5, "x", "2026-01-20 11:00:00")]]
    assert deliver(spark, batches, within="2 days", time="received") == [(1, "a"), (2, "x"), (4, "a")]


def test_mailbox_goes_on_after_its_last_uid(spark):
    root = tempfile.mkdtemp(prefix="tf-mailbox-")
    mailbox.register_mailbox(spark)
    stream = spark.readStream.format("mailbox").option("path", f"{root}/in").option("start_uid", "10").option("split_uids", "7").load()

    def run():
        finish(stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt")
               .trigger(**ONCE).start())
        return [r.uid for r in spark.read.parquet(f"{root}/out").collect()] if os.path.isdir(f"{root}/out") else []

    write = lambda a, b, mode: (spark.range(a, b).select(F.col("id").alias("uid"), F.concat(F.lit("m"), "id").alias("msg_id"))
                                .coalesce(2).write.mode(mode).parquet(f"{root}/in"))
    write(1, 31, "append")
    assert sorted(run()) == list(range(11, 31))
    assert sorted(run()) == list(range(11, 31))  # nothing new: nothing is read again
    write(31, 40, "append")
    assert sorted(run()) == list(range(11, 40))
    write(1, 45, "overwrite")                     # the folder compacted to other files: still only the new ones
    assert sorted(run()) == list(range(11, 45))


def test_ingest_from_the_mailbox_with_dedup(spark):
    root = tempfile.mkdtemp(prefix="tf-mailbox-ingest-")
    mailbox.register_mailbox(spark)
    reply = '{"type": "expense", "card_last4": "1111", "amount": 12, "time": "2026-03-01 07:30", "counterparty": "c"}'
    rows = [(i, f"a{i % 3}", None, "95555@message.cmbchina.com", "一卡通账户变动通知", None, reply) for i in range(1, 7)]
    spark.createDataFrame(rows, "uid bigint, msg_id string, received timestamp_ntz, sender string, subject string, html string, text string") \
        .coalesce(1).write.parquet(f"{root}/in")
    stream = spark.readStream.format("mailbox").option("path", f"{root}/in").load()
    finish(ST.start_ingest(spark, stream, f"{root}/state", f"{root}/ckpt", ONCE, interpret=lambda pdf: pdf["text"], dedup_within="1 day"))
    totals = {r.total: r.n for r in ST.run_totals(spark, f"{root}/state").collect()}
    assert totals == {"inserted": 1, "pending": 1, "dup": 2, "debit_event:parsed": 3}


# ---- stages as queries of their own ------------------------------------------------


def test_a_failing_stage_leaves_the_others_alone(spark):
    import pandas as pd
    root = tempfile.mkdtemp(prefix="tf-stages-")
    reply = '{"type": "expense", "card_last4": "1111", "amount": %d, "time": "2026-03-01 07:30", "counterparty": "c%d"}'
    cats = spark.createDataFrame([("food", "k", 1)], "name string, key string, active int")

    def drop(i):
        spark.createDataFrame([(i, f"a{i}", None, "95555@message.cmbchina.com", "一卡通账户变动通知", None, reply % (10 + i, i))],
                              "uid bigint, msg_id string, received timestamp_ntz, sender string, subject string, html string, text string") \
            .coalesce(1).write.parquet(f"{root}/drop/{i}")

    def classifier(pdf):
        keys = sorted(set(pdf["merchant_key"]))
        return pd.DataFrame({"adv_key": keys, "category": ["food"] * len(keys), "operation": [None] * len(keys),
                             "related_ids": [None] * len(keys), "reason": [None] * len(keys)})

    def broken(*_):
        raise RuntimeError("down")

    def cycle(classify, send, suggest_fails=False, notify_fails=False):
        finish(ST.start_ingest(spark, f"{root}/drop/*", f"{root}/state", f"{root}/ck-ingest", ONCE, interpret=lambda pdf: pdf["text"]))
        finish(ST.start_suggest(spark, f"{root}/state", f"{root}/ck-suggest", classify, cats, ONCE), suggest_fails)
        finish(ST.start_notify(spark, f"{root}/state", f"{root}/ck-notify", send, lambda: "2026-03-01 09:00:00", ONCE), notify_fails)
        return sorted((r.merchant_key, r.category, r.notify_status) for r in ST.current_ledger(spark, f"{root}/state").collect())

    sent = []
    send = lambda lines: sent.append(lines.count()) is None
    drop(0)
    assert cycle(broken, send, suggest_fails=True) == [("c0", None, "sent")] and sent == [1]
    drop(1)
    assert cycle(classifier, lambda lines: False, notify_fails=True) == [("c0", "food", "sent"), ("c1", "food", None)]
    assert cycle(classifier, send) == [("c0", "food", "sent"), ("c1", "food", "sent")] and sent == [1, 1]


def test_totals_of_a_run(spark):
    """Mails seen before, and rows that another mail has brought already, are counted apart."""
    root = tempfile.mkdtemp(prefix="tf-totals-")
    reply = '{"type": "%s", "card_last4": "1111", "amount": %d, "time": "2026-03-01 07:30", "counterparty": "c"}'
    mail = lambda i, kind, amount: (i, f"a{i}", None, "95555@message.cmbchina.com", "一卡通账户变动通知", None, reply % (kind, amount))
    ddl = "uid bigint, msg_id string, received timestamp_ntz, sender string, subject string, html string, text string"
    one = spark.createDataFrame([mail(0, "expense", 5), mail(1, "expense", 5), mail(2, "income", 7), mail(3, "nonsense", 1)], ddl)
    two = spark.createDataFrame([mail(0, "expense", 5), mail(4, "expense", 5), mail(5, "expense", 6)], ddl)
    for b, df in enumerate((one, two)):
        ST.process_batch(spark, df, b, f"{root}/s", interpret=lambda pdf: pdf["text"])
    totals = lambda b=None: {r.total: r.n for r in ST.run_totals(spark, f"{root}/s", b).collect()}
    assert totals(0) == {"inserted": 1, "pending": 1, "dup": 1, "income": 1, "waiting": 1, "debit_event:parsed": 3}
    assert totals(1) == {"inserted": 1, "pending": 1, "dup": 1, "already_seen": 1, "waiting": 1, "debit_event:parsed": 2}
    assert totals() == {"inserted": 2, "pending": 2, "dup": 2, "income": 1, "already_seen": 1, "waiting": 1, "debit_event:parsed": 5}
    ST.compact_state(spark, f"{root}/s", f"{root}/t")
    assert {r.total: r.n for r in ST.run_totals(spark, f"{root}/t").filter("total <> 'waiting'").collect()} == {
        k: v for k, v in totals().items() if k != "waiting"}


@pytest.mark.parametrize("repeat", [1, 2])
def test_replays_of_any_batch_change_nothing(spark, repeat):
    root = tempfile.mkdtemp(prefix="tf-replay2-")
    reply = '{"type": "expense", "card_last4": "1111", "amount": %d, "time": "2026-03-01 07:30", "counterparty": "c"}'
    ddl = "uid bigint, msg_id string, received timestamp_ntz, sender string, subject string, html string, text string"
    for b in range(3):
        df = spark.createDataFrame([(i, f"a{i}", None, "95555@message.cmbchina.com", "一卡通账户变动通知", None, reply % (1 + i % 4))
                                    for i in range(3 * b, 3 * b + 4)], ddl)
        for _ in range(repeat):
            ST.process_batch(spark, df, b, f"{root}/s", interpret=lambda pdf: pdf["text"])
    assert sorted(float(r.amount) for r in ST.current_ledger(spark, f"{root}/s").collect()) == [1, 2, 3, 4]
    assert ST._read_or_empty(spark, f"{root}/s/mail_log", ST.LOG_DDL).count() == 10
