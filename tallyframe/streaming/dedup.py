"""Message ids once each, within a stated time (R3, R4), ahead of the ingest.

A mailbox hands the same message over several times within a short while: moved between folders, or scanned again
after a failure. ``dropDuplicatesWithinWatermark`` keeps the ids seen during the last ``within`` in the state store
and lets the first delivery pass. Older ids are forgotten, so the state is bounded by the time, not by the history; a
copy that comes later than that is caught by the ingest's log (R3).

Time is, by default, that of the micro-batch in which a mail arrives: nothing is ever late, so no mail is lost. With a
time column the watermark follows that column, and Spark drops rows that are older than the watermark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WITHIN = "7 days"


def first_deliveries(mails: DataFrame, within: str = WITHIN, key: str = "msg_id", time: str | None = None) -> DataFrame:
    """The stream without repeated deliveries of a message within ``within``."""
    stamp = F.current_timestamp() if time is None else F.col(time).cast(T.TimestampType())
    timed = mails.withColumn("_event_time", stamp).withWatermark("_event_time", within)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_event_time")
