"""Refund pairing as keyed streaming state (R5): open rows wait in the state store, pairs come out.

The key is (card, merchant, amount in cents). Its state is the list of rows that have no partner yet. When rows of a
key arrive, they and the open ones are taken in order of (time, expenses first, id): an expense goes on a stack, a
refund takes the stack's top, which is the latest earlier open expense. Pairs are emitted once and for good, as the
ledger's pairing is sticky; both rows leave the state. So a micro-batch costs the rows it brings and the open rows of
their keys; history is not read again. In order of time, or in one batch, the pairs are those of
:func:`tallyframe.operators.matching.refund_pairs`; a late row pairs with what is still open.

State survives in the stream's checkpoint (RocksDB state store, as the operator needs). Rows that repeat an id while
it is open are one row; one that repeats a paired id is for the ingest to keep out (insert-or-ignore, R3).
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.periods import epoch_micros
from ..operators.matching import _is_refund, _pair_candidate

KEY = ["card_last4", "merchant_key", "cents"]
OPEN_ROW = "t long, refund boolean, id long"
PAIR_DDL = "refund_id long, expense_id long, card_last4 string, merchant_key string, cents long, t long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenRows(StatefulProcessor):
    """Open rows of one key; see the module's text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", OPEN_ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = {r[2]: (r[0], r[1], r[2]) for r in self.open.get()}
        for df in rows:
            for t, refund, i in zip(df["t"].tolist(), df["refund"].tolist(), df["id"].tolist()):
                waiting[i] = (t, refund, i)
        expenses, refunds, pairs = [], [], []
        for row in sorted(waiting.values()):
            if not row[1]:
                expenses.append(row)
            elif expenses:
                pairs.append((row[2], expenses.pop()[2], *key, row[0]))
            else:
                refunds.append(row)
        self._keep(expenses + refunds)
        if pairs:
            yield pd.DataFrame(pairs, columns=[c.split()[0] for c in PAIR_DDL.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._keep(list(zip(initialState["t"].tolist(), initialState["refund"].tolist(), initialState["id"].tolist())))

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def open_candidates(ledger: DataFrame) -> DataFrame:
    """Rows that pairing looks at: key, time in microseconds, side and id."""
    cents = (F.abs(F.col("amount")) * 100).cast("bigint")
    return ledger.filter(_pair_candidate() & F.col("amount").isNotNull() & F.col("txn_time").isNotNull()).select(
        "card_last4", "merchant_key", cents.alias("cents"), epoch_micros("txn_time").alias("t"), _is_refund().alias("refund"), "id")


def pair_stream(ledger_stream: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """Stream of ledger rows -> stream of pairs (refund_id, expense_id, card_last4, merchant_key, amount, refund_time).

    ``opened``: a ledger whose open rows the state starts with, for a stream that goes on where batches ended. The
    session must use the RocksDB state store (:func:`start_pairing` sees to that).
    """
    # the processor goes to its workers with its code: the one on the driver does not see shipped packages
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    start = None if opened is None else open_candidates(opened).groupBy(*KEY)
    pairs = open_candidates(ledger_stream).groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=OpenRows(), outputStructType=PAIR_DDL, outputMode="Append", timeMode="None", initialState=start)
    when = F.timestamp_add("MICROSECOND", F.col("t"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return pairs.select("refund_id", "expense_id", "card_last4", "merchant_key",
                        (F.col("cents") / 100).cast("double").alias("amount"), when.alias("refund_time"))


def start_pairing(ledger_stream: DataFrame, out_dir: str, checkpoint_dir: str, trigger: dict | None = None,
                  opened: DataFrame | None = None):
    """Start the pairing query; pairs go to Parquet files under ``out_dir``, each exactly once."""
    spark = ledger_stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (pair_stream(ledger_stream, opened).writeStream.format("parquet").outputMode("append").option("path", out_dir)
                .option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"processingTime": "90 seconds"})).start())
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
