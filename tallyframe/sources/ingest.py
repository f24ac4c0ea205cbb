"""Idempotent loads into the ledger, deposits and category tables.

Insert-or-ignore is "first arrival per key wins inside the batch, then drop
keys the table already has": a ``min_by`` aggregate (map-side combined, so a
key delivered a million times costs one row per map task) followed by a
left-anti join. Nothing is updated in place; callers write the union as the
next snapshot.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mail import first_per_key


def txn_insert_ignore(ledger: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """New ledger rows from a parsed batch (A8): deduped on fingerprint, status pending,
    no category (classification happens later)."""
    ins = first_per_key(batch, "fingerprint", [F.col(arrival)]).join(
        ledger.select("fingerprint"), "fingerprint", "left_anti")
    return (ins.withColumn("status", F.lit("pending"))
            .withColumn("category", F.lit(None).cast("string"))
            .withColumn("category_src", F.lit(None).cast("string")))


def batch_stats(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """inserted / pending / dup counts of one batch (A8 statistics)."""
    b = batch.agg(F.count(F.lit(1)).alias("batch_n"))
    i = inserted.agg(F.count(F.lit(1)).alias("inserted"))
    # two one-row aggregates side by side: a union + max keeps it join-free
    u = (b.select("batch_n", F.lit(None).cast("bigint").alias("inserted"))
         .unionByName(i.select(F.lit(None).cast("bigint").alias("batch_n"), "inserted")))
    r = u.agg(F.max("batch_n").alias("batch_n"), F.max("inserted").alias("inserted"))
    return r.select("inserted", F.col("inserted").alias("pending"),
                    (F.col("batch_n") - F.col("inserted")).alias("dup"))


def deposit_insert_ignore(deposits: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """New deposits, idempotent on source message id."""
    return first_per_key(batch, "source_msg_id", [F.col(arrival)]).join(
        deposits.select("source_msg_id"), "source_msg_id", "left_anti")


def category_seed_upsert(categories: DataFrame, seed: DataFrame) -> DataFrame:
    """Upsert the category seed by stable key.

    ``seed``: (key, name, descr, position). Name, description and sort follow
    the seed; ``active`` is kept for existing keys and 1 for new ones. A full
    outer join on the key (both sides are small dimension tables).
    """
    s = seed.select("key", F.col("name").alias("s_name"), F.col("descr").alias("s_descr"),
                    F.col("position").alias("s_sort"))
    j = categories.join(s, "key", "full_outer")
    return j.select(
        "key",
        F.coalesce(F.col("s_name"), F.col("name")).alias("name"),
        F.coalesce(F.col("s_descr"), F.col("descr")).alias("descr"),
        F.coalesce(F.col("active"), F.lit(1)).alias("active"),
        F.coalesce(F.col("s_sort"), F.col("sort")).cast("bigint").alias("sort"))


def orphan_check(ledger: DataFrame, mail_log: DataFrame) -> DataFrame:
    """Ledger rows whose source message is not in the mail log."""
    return (ledger.filter(F.col("source_msg_id").isNotNull())
            .join(mail_log.select(F.col("msg_id").alias("source_msg_id")), "source_msg_id", "left_anti")
            .select("id", "source_msg_id"))
