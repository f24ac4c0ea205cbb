"""Raw-mail scans, incremental pruning, search, dedup and the processing log
(A1-A7, A13, U1).

The mailbox is re-aimed as a table of raw mails (uid, msg_id, received, sender,
subject, html, text). Pruning by UID watermark or received date is a plain
filter that reaches the Parquet scan; dedup and upserts are anti-joins and
unions keyed by message id; "first/last wins" is a ``min_by``/``max_by`` aggregate per key.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mail_type

# Schema of the raw-mail table when it is read from files (never inferred).
MAIL_SCHEMA = T.StructType([
    T.StructField("uid", T.LongType()),
    T.StructField("msg_id", T.StringType()),
    T.StructField("received", T.TimestampNTZType()),
    T.StructField("sender", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("text", T.StringType()),
])


def read_mails(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a raw-mail drop folder with the fixed schema (A1)."""
    return spark.read.schema(MAIL_SCHEMA).format(fmt).load(path)


def mail_scan(mails: DataFrame) -> DataFrame:
    """The scan itself plus the router label (A1 + B3)."""
    return mails.withColumn("email_type", mail_type("sender", "subject"))


def incremental_scan(mails: DataFrame, last_uid: int) -> DataFrame:
    """Mails above the UID watermark (A2); the pushed filter prunes row groups."""
    return mails.filter(F.col("uid") > F.lit(last_uid))


def next_watermark(mails: DataFrame, last_uid: int) -> DataFrame:
    """max(uid) over the scanned mails, never below the previous watermark (A2)."""
    return mails.agg(F.greatest(F.coalesce(F.max("uid"), F.lit(last_uid)), F.lit(last_uid))
                     .cast("bigint").alias("last_uid"))


def scan_newest_n(mails: DataFrame, last_uid: int, n: int) -> DataFrame:
    """The newest N of the mails above the watermark (A3: limit after pruning)."""
    return incremental_scan(mails, last_uid).orderBy(F.col("uid").desc()).limit(n)


def mail_search(mails: DataFrame, senders: list[str], since: str | None = None,
                newer_than_days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Sender/date search (A4, U1): OR over sender tokens, AND received date >= since.

    One filter over the scan (no per-sender passes) gives the union-distinct of
    the per-sender hits, by uid; an empty sender list is an error, as in the
    reference. ``newer_than_days`` counts back from ``as_of``.
    """
    if not senders:
        raise ValueError("mail search needs at least one sender")
    s = F.lower(F.coalesce(F.col("sender"), F.lit("")))
    pred = reduce(lambda a, b: a | b, [F.contains(s, F.lit(x.lower())) for x in senders])
    if since:
        pred = pred & (F.to_date("received") >= F.to_date(F.lit(since.replace("/", "-"))))
    if newer_than_days is not None:
        if as_of is None:
            raise ValueError("newer_than_days counts back from as_of")
        pred = pred & (F.to_date("received") >= F.date_sub(F.to_date(F.lit(as_of)), int(newer_than_days)))
    return mails.filter(pred).select("uid").distinct().orderBy("uid")


def sender_union(mails: DataFrame, senders: list[str], since: str | None = None) -> DataFrame:
    """The union of per-sender searches (U1): a disjunction over one scan, not a scan for each sender."""
    return mail_search(mails, senders, since)


def recent_mail_count(mails: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Mails per sender received in the last ``days`` days before ``as_of`` (A5)."""
    lo = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (mails.filter(F.col("received") >= lo)
            .groupBy("sender").agg(F.count(F.lit(1)).alias("n")))


def first_per_key(df: DataFrame, key: str, order: list, last: bool = False) -> DataFrame:
    """Keep one row per key: the first (or last) in ``order``.

    Written as ``min_by``/``max_by`` aggregation rather than a window, so a hot
    key is reduced map-side (partial aggregation) before the shuffle.
    """
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(pick(row, F.struct(*order)).alias("_r")).select("_r.*")


def mail_dedup(new: DataFrame, log: DataFrame) -> DataFrame:
    """New mails not yet in the log, one per message id, first by uid."""
    fresh = new.join(log.select("msg_id"), "msg_id", "left_anti")
    return first_per_key(fresh, "msg_id", [F.col("uid")])


def mail_log_upsert(log: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-or-replace of log rows by message id; the newest write wins."""
    latest = first_per_key(new, "msg_id", [F.col("uid")], last=True)
    return log.join(latest.select("msg_id"), "msg_id", "left_anti").unionByName(latest)


def ingest_stats(mail_log: DataFrame) -> DataFrame:
    """Counts by 'email_type:status' of one ingest run."""
    return (mail_log.groupBy(F.concat_ws(":", "email_type", "status").alias("type_status"))
            .agg(F.count(F.lit(1)).alias("n")))
