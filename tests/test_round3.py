"""Drops of many files, mails that carry what is known of them, the mailbox's batches, the fold's rows."""
import datetime as dt
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.operators import classify, command_fold, extract
from tallyframe.plans import streams
from tallyframe.streaming import mailbox


def test_a_drop_is_a_batch_in_any_number_of_files(spark):
    root = tempfile.mkdtemp(prefix="tf-drops-")
    rows = spark.range(60).repartition(5).withColumn("at", F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(cast(id % 20 as int))"))
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in/*")
    seen = []
    streams._deliver(rows, root, ["_day <= 10", "_day > 10"], "at", lambda: stream.writeStream.foreachBatch(
        lambda df, i: seen.append((i, df.count(), df.select(F.input_file_name()).distinct().count()))).option("checkpointLocation", f"{root}/ck").trigger(**streams.ONCE).start())
    assert [(i, n) for i, n, _ in seen] == [(0, 30), (1, 30)] and min(files for _, _, files in seen) > 2


def test_mails_carry_columns_through_the_parsers(spark):
    mails = spark.createDataFrame([("a", "x", dt.datetime(2026, 3, 1), 7), ("b", "y", None, None)],
                                  "source_msg_id string, text string, received timestamp_ntz, arrival bigint")
    replies = classify.interpret_alerts(mails, lambda pdf: [f'{{"type": "expense", "amount": 3, "counterparty": "{t}"}}' for t in pdf["text"]],
                                        keep=["text", "arrival"])
    got = extract.alert_normalise(replies, keep=["arrival"])
    assert sorted((r.source_msg_id, r.counterparty, r.arrival) for r in got.collect()) == [("a", "x", 7), ("b", "y", None)]
    _, led = extract.alert_route(got, "debit", keep=["arrival"])
    assert "arrival" in led.columns


def test_the_mailbox_hands_over_few_mails_at_a_time(spark):
    path = tempfile.mkdtemp(prefix="tf-mailbox-rows-") + "/in"
    spark.range(1, 50_001).select(F.col("id").alias("uid"), F.concat(F.lit("m"), "id").alias("msg_id")).coalesce(1).write.parquet(path)
    reader = mailbox.MailboxReader({"path": path, "split_uids": 40_000})
    parts = [list(reader.read(p)) for p in reader.partitions({"uid": 0}, reader.latestOffset())]
    assert [sum(map(len, p)) for p in parts] == [40_000, 10_000]
    assert max(len(b) for p in parts for b in p) <= mailbox.BATCH_ROWS


def test_rows_of_the_fold_come_and_go_by_column():
    kind = pa.struct([("id", pa.int64()), ("note", pa.string())])
    rows = [{"id": 1, "note": "n"}, None, {"id": 2}]
    made = command_fold._struct(rows, kind)
    assert made.to_pylist() == [{"id": 1, "note": "n"}, None, {"id": 2, "note": None}]
    batch = pa.RecordBatch.from_arrays([pa.array(["r", "s", "t"]), made], names=["request_id", "row"])
    assert list(command_fold._steps(batch, ["id", "note"])) == [
        ({"request_id": "r"}, (1, "n")), ({"request_id": "s"}, None), ({"request_id": "t"}, (2, None))]
