"""Registered queries that run a stream to its end and return its final state.

The stand-in mailbox is derived from the driver tables, written as files in order of receipt into the shared folder,
and read by the library's own streaming jobs with an ``availableNow`` trigger: after each drop of files the stream goes
on where it stopped, so a drop is a batch, in however many files its tasks write it.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..session import ensure_checkpoint_dir
from ..streaming import ingest, mailbox, pairing
from ..streaming.dedup import first_deliveries
from .registry import register

ONCE = {"availableNow": True}
THIRDS = ["_day <= 10", "_day > 10 AND _day <= 20", "_day > 20"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _deliver(df: DataFrame, folder: str, conditions: list[str], day: str, start) -> None:
    """One folder of files for each condition on ``day``, in this order; the stream that ``start`` starts runs to its
    end after each."""
    for i, condition in enumerate(conditions):
        df.withColumn("_day", F.dayofmonth(day)).filter(condition).drop("_day").write.parquet(f"{folder}/in/drop{i}")
        _finish(start())


@fx.memo
def ingested(spark: SparkSession, sf: str) -> str:
    """The state folder of an ingest of digests and alerts in two batches, and a third that delivers some digests
    again. The queries below read this one run's tables."""
    folder = _folder(spark, "ingest")
    mails = fx.stream_mails(spark, sf)
    _deliver(mails, folder, ["_day <= 15", "_day > 15", "_day <= 3 AND msg_id LIKE 'g%'"], "received",
             lambda: ingest.start_ingest(spark, f"{folder}/in/*", f"{folder}/state", f"{folder}/checkpoint", trigger=ONCE,
                                         interpret=lambda pdf: pdf["text"]))
    return f"{folder}/state"


@register("stream_ledger")
def q_stream_ledger(spark, sf):
    led = ingest.current_ledger(spark, ingested(spark, sf))
    partner = led.select(F.col("id").alias("offset_of"), F.col("fingerprint").alias("pair_fingerprint"))
    return led.join(partner, "offset_of", "left").select(
        "fingerprint", "card_last4", "card_type", "txn_time", F.col("amount").cast("double").alias("amount"), "direction", "merchant_key",
        "channel", "status", "voided", "pair_fingerprint")


@register("stream_deposits")
def q_stream_deposits(spark, sf):
    return ingest.current_deposits(spark, ingested(spark, sf)).select(
        "source_msg_id", "card_last4", "txn_time", F.col("amount").cast("double").alias("amount"), "kind", "payer", "note")


@register("stream_mail_log")
def q_stream_mail_log(spark, sf):
    log = ingest._read_or_empty(spark, f"{ingested(spark, sf)}/mail_log", ingest.LOG_DDL)
    return log.select("msg_id", "email_type", "status")


@register("run_totals")
def q_run_totals(spark, sf):
    return ingest.run_totals(spark, ingested(spark, sf))


@register("stream_pairs")
def q_stream_pairs(spark, sf):
    folder = _folder(spark, "pairs")
    ledger = fx.ledger_e(spark, sf)
    stream = spark.readStream.schema(ledger.schema).parquet(f"{folder}/in/*")
    _deliver(ledger, folder, THIRDS, "txn_time", lambda: pairing.start_pairing(stream, f"{folder}/out", f"{folder}/checkpoint", ONCE))
    return spark.read.parquet(f"{folder}/out")


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    folder = _folder(spark, "dedup")
    mails = fx.mails_e(spark, sf).select("uid", "msg_id", "received", "sender", "subject")
    stream = spark.readStream.schema(mails.schema).parquet(f"{folder}/in/*")
    _deliver(mails, folder, THIRDS, "received", lambda: first_deliveries(stream).writeStream.format("parquet")
             .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(**ONCE).start())
    return spark.read.parquet(f"{folder}/out").select("msg_id")


@register("stream_incremental")
def q_stream_incremental(spark, sf):
    folder = _folder(spark, "mailbox")
    mails = fx.mails_e(spark, sf)
    mailbox.register_mailbox(spark)
    path = folder.removeprefix("file://") if folder.startswith("file:///") else folder
    stream = spark.readStream.format("mailbox").option("path", f"{path}/in").option("start_uid", "500").load()
    for condition in ("_day <= 15", "_day > 15"):  # the mailbox grows; the stream goes on where it stopped
        part = mails.withColumn("_day", F.dayofmonth("received")).filter(condition).drop("_day")
        part.select("uid", "msg_id", "received", "sender", "subject").write.mode("append").parquet(f"{folder}/in")
        _finish(stream.writeStream.format("parquet").option("path", f"{folder}/out")
                .option("checkpointLocation", f"{folder}/checkpoint").trigger(**ONCE).start())
    return spark.read.parquet(f"{folder}/out").select("uid", "msg_id")
