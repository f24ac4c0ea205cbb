"""Pluggable classifier run (W6, UDF surface): the caller's function sees one
classification batch at a time.

The reference sends merchants to an external agent in batches of 40 with at
most 20 recent rows each. Here the batches are groups of ``applyInPandas``:
merchants are hashed into ceil(n / batch_size) buckets, so a group holds about
``batch_size`` merchants x ``k`` rows, a bound independent of the data size.
The function returns advice rows; the result has the advice-table schema used
by :mod:`tallyframe.operators.advice`.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .advice import merchant_recent, open_merchants

ADVICE_SCHEMA = ("batch_id bigint, adv_key string, pos bigint, category string, operation string, "
                 "related_ids array<bigint>, reason string")


def classification_batches(ledger: DataFrame, batch_size: int = K.CLASSIFY_BATCH,
                           include_suggested: bool = True) -> DataFrame:
    """Open merchants with a batch id (R9: ``include_suggested=False`` only re-evaluates pending).

    Merchants are hashed into about n / ``batch_size`` buckets; a bucket that holds more is cut, so no
    batch exceeds ``batch_size`` merchants (W6).
    """
    m = open_merchants(ledger, include_suggested)
    n = m.count()  # one number: sizes the batches
    nb = max(1, math.ceil(n / batch_size))
    m = m.withColumn("bucket", F.pmod(F.xxhash64("merchant_key"), F.lit(nb)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("merchant_key")) - 1
    part = F.floor(place / batch_size).cast("bigint")
    return m.select("merchant_key", (F.col("bucket") + part * nb).alias("batch_id"))


def run_classifier(ledger: DataFrame, batches: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame],
                   k: int = K.RECENT_PER_MERCHANT) -> DataFrame:
    """Call ``fn`` once per batch with the batch's recent rows; return advice rows.

    ``fn`` receives columns (merchant_key, id, amount, txn_time, direction,
    card_last4) and returns (adv_key, category, operation, related_ids, reason)
    in reply order; the position becomes ``pos``.
    """
    hist = merchant_recent(ledger, batches.select("merchant_key"), k).join(batches, "merchant_key")

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        bid = int(pdf["batch_id"].iloc[0])
        out = fn(pdf.drop(columns=["batch_id", "rn"]).reset_index(drop=True))
        out = out.reset_index(drop=True)
        out.insert(0, "batch_id", bid)
        out.insert(2, "pos", range(len(out)))
        return out[["batch_id", "adv_key", "pos", "category", "operation", "related_ids", "reason"]]

    return hist.groupBy("batch_id").applyInPandas(per_batch, ADVICE_SCHEMA)


def interpret_alerts(mails: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], keep: Sequence[str] = ()) -> DataFrame:
    """Run the caller's alert interpreter over debit-alert mails (UDF surface, C6 input).

    ``fn`` maps a batch (columns source_msg_id, text, received) to the reply
    texts, one per row; the result feeds :func:`extract.alert_normalise`. It is
    called per Arrow batch through ``mapInPandas``: no grouping, no shuffle. The columns in ``keep`` go around ``fn``,
    beside its replies.
    """
    seen = ["source_msg_id", "text", "received"]
    src = mails.select(*seen, *[c for c in keep if c not in seen])
    out = T.StructType([T.StructField("source_msg_id", T.StringType()), T.StructField("received", T.TimestampNTZType()),
                        T.StructField("reply", T.StringType()), *[T.StructField(c, src.schema[c].dataType) for c in keep]])

    def per_batch(batches):
        for pdf in batches:
            told = pdf[["source_msg_id", "received", *keep]].copy()
            told.insert(2, "reply", list(fn(pdf[seen].reset_index(drop=True))))
            yield told

    return src.mapInPandas(per_batch, out)
