"""Notification queue and digest.

Selection is a filter plus a left join to the advice table. The digest is
returned as lines (one row per line with its sort key), as a message in order, or as texts of
bounded length per card (:func:`digest_text`). "Advice printed once" is a global
first-occurrence, computed as a ``min_by`` aggregate per advice key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def notify_queue(ledger: DataFrame, suggestions: DataFrame, backfill_before: str | None = None) -> DataFrame:
    """Live rows never notified, with their advice.

    ``backfill_before`` makes the history cut-off explicit: rows older than it
    are never pushed.
    """
    q = ledger.filter(F.col("notify_status").isNull() & ~F.col("voided"))
    if backfill_before:
        q = q.filter(F.col("txn_time") >= F.lit(backfill_before).cast("timestamp_ntz"))
    s = suggestions.select(F.col("transaction_id").alias("id"), F.col("operation").alias("suggested_operation"),
                           F.col("related_transaction_ids").alias("suggested_related_ids"),
                           F.col("reason").alias("suggested_reason"))
    return q.join(s, "id", "left").select(
        "id", "card_type", "card_last4", "txn_time", "status", "category", "merchant_raw",
        F.col("amount").cast("decimal(18,2)").alias("amount"),
        "suggested_operation", "suggested_related_ids", "suggested_reason")


def notify_digest(queue: DataFrame) -> DataFrame:
    """Digest lines per (card_type, card_last4).

    Row lines: ' #id ¥amount merchant[:18] → tag'. An advice with a known
    operation and a non-empty id list adds two lines after the first row (in
    message order: card type, card group's first row, time, id) that carries
    it; later rows with the same (operation, ids) add nothing.
    """
    uncertain = F.col("status").isin(*K.UNCERTAIN_STATUSES)
    tag = F.when(F.col("category").isNotNull() & (F.col("category") != ""),
                 F.concat(F.lit(K.TAG_CATEGORY), F.col("category"),
                          F.when(uncertain, F.lit(K.TAG_CONFIRM)).otherwise(F.lit(""))))\
        .otherwise(F.lit(K.TAG_OPEN))
    line = F.concat(F.lit(" #"), F.col("id").cast("string"), F.lit(" ¥"), F.col("amount").cast("string"),
                    F.lit(" "), F.substring(F.coalesce(F.col("merchant_raw"), F.lit("")), 1, 18), F.lit(" "), tag)
    rows = queue.select("card_type", "card_last4", "txn_time", "id", F.lit(0).alias("sub"),
                        line.alias("line"), uncertain.alias("need_confirm"))
    # message order: groups by first appearance in (card_type, txn_time, id)
    first = queue.groupBy("card_type", "card_last4").agg(F.min(F.struct("txn_time", "id")).alias("g"))
    labels = F.create_map(*[F.lit(x) for kv in K.OPERATION_LABELS.items() for x in kv])
    ids = F.from_json(F.col("suggested_related_ids"), "array<bigint>")
    adv = (queue.filter(F.col("suggested_operation").isin(*K.OPERATION_LABELS) & (F.size(ids) > 0))
           .join(first, ["card_type", "card_last4"])
           .withColumn("ids", ids))
    once = (adv.groupBy("suggested_operation", "ids")
            .agg(F.min_by(F.struct("card_type", "card_last4", "txn_time", "id", "suggested_reason"),
                          F.struct("card_type", "g", "txn_time", "id")).alias("r")))
    id_text = F.array_join(F.transform("ids", lambda v: F.concat(F.lit("#"), v.cast("string"))), " ")
    label = F.element_at(labels, F.col("suggested_operation"))
    reason = F.coalesce(F.nullif(F.col("r.suggested_reason"), F.lit("")), F.lit(K.ADVICE_REASON))
    a1 = once.select(F.col("r.card_type").alias("card_type"), F.col("r.card_last4").alias("card_last4"),
                     F.col("r.txn_time").alias("txn_time"), F.col("r.id").alias("id"), F.lit(1).alias("sub"),
                     F.concat(F.lit(K.ADVICE_LEAD), label, F.lit(" "), id_text, F.lit(K.ADVICE_COLON), reason).alias("line"),
                     F.lit(False).alias("need_confirm"))
    a2 = once.select(F.col("r.card_type").alias("card_type"), F.col("r.card_last4").alias("card_last4"),
                     F.col("r.txn_time").alias("txn_time"), F.col("r.id").alias("id"), F.lit(2).alias("sub"),
                     F.concat(F.lit(K.ADVICE_REPLY), label, F.lit(" "), id_text, F.lit(K.ADVICE_CLOSE)).alias("line"),
                     F.lit(False).alias("need_confirm"))
    return rows.unionByName(a1).unionByName(a2)


def digest_message(queue: DataFrame, name: str = "tallyframe") -> DataFrame:
    """The whole message (D14): (section, card_type, g, card_last4, txn_time, id, sub, line), in message order.

    A title, per card a heading with its lines, and, if any row needs the user, a
    footer that shows how to answer. Cards come by type and first appearance.
    """
    first = queue.groupBy("card_type", "card_last4").agg(F.min(F.struct("txn_time", "id")).alias("g"))
    body = notify_digest(queue).join(first, ["card_type", "card_last4"]).select(
        F.lit(1).alias("section"), "card_type", "g", "card_last4", "txn_time", "id", "sub", "line")
    kind = F.when(F.col("card_type") == "credit", K.CARD_LABELS["credit"]).otherwise(K.CARD_LABELS["debit"])
    heads = first.select(F.lit(1).alias("section"), "card_type", "g", "card_last4", F.lit(None).cast("timestamp_ntz").alias("txn_time"),
                         F.lit(None).cast("bigint").alias("id"), F.lit(-1).alias("sub"),
                         F.concat(kind, F.coalesce("card_last4", F.lit(""))).alias("line"))
    total = queue.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*K.UNCERTAIN_STATUSES)).alias("open"),
                      F.min_by("id", F.struct("card_type", "txn_time", "id")).alias("example"))
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("card_type", "string"), ("g", first.schema["g"].dataType),
                                                        ("card_last4", "string"), ("txn_time", "timestamp_ntz"), ("id", "bigint"))]
    title = total.filter("n > 0").select(F.lit(0).alias("section"), *blank, F.lit(0).alias("sub"), F.format_string(
        K.DIGEST_TITLE, F.lit(name), F.col("n")).alias("line"))
    footer = total.filter("open > 0").select(F.lit(2).alias("section"), *blank, F.lit(0).alias("sub"), F.format_string(
        K.DIGEST_FOOTER, F.col("open"), F.col("example")).alias("line"))
    out = title.unionByName(heads).unionByName(body).unionByName(footer)
    return out.orderBy("section", F.asc_nulls_first("card_type"), "g", F.asc_nulls_first("card_last4"),
                       F.asc_nulls_first("txn_time"), F.asc_nulls_first("id"), "sub")


MESSAGE_CHARS = 4000


def digest_text(queue: DataFrame, most: int = MESSAGE_CHARS) -> DataFrame:
    """One text per card (D14): (card_type, card_last4, part, n_lines, text), lines in message order under a heading.

    A text ends with the line that reaches ``most`` characters; what follows is the card's next part. Where a line
    falls is known from the characters before it: those of its day, and of the card's earlier days, so neither a
    window nor a text ever holds a whole card that is large.
    """
    card = ["card_type", "card_last4"]
    lines = notify_digest(queue).withColumns({"day": F.to_date("txn_time"), "chars": F.char_length("line") + 1})
    inside = Window.partitionBy(*card, "day").orderBy("txn_time", "id", "sub").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    earlier = Window.partitionBy(*card).orderBy(F.asc_nulls_first("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = lines.groupBy(*card, "day").agg(F.sum("chars").alias("chars")).select(
        F.col("card_type").alias("of_type"), F.col("card_last4").alias("of_card"), F.col("day").alias("of_day"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("earlier"))
    same = (F.col("card_type").eqNullSafe(F.col("of_type")) & F.col("card_last4").eqNullSafe(F.col("of_card"))
            & F.col("day").eqNullSafe(F.col("of_day")))
    parts = lines.join(days, same).withColumn("part", F.floor((F.col("earlier") + F.col("before")) / most).cast("int"))
    kind = F.when(F.col("card_type") == "credit", K.CARD_LABELS["credit"]).otherwise(K.CARD_LABELS["debit"])
    texts = parts.groupBy(*card, "part").agg(
        F.count(F.lit(1)).alias("n_lines"), F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY txn_time, id, sub)").alias("body"))
    heading = F.concat(kind, F.coalesce("card_last4", F.lit("")))
    return texts.select(*card, "part", "n_lines", F.concat(heading, F.lit("\n"), "body").alias("text")).orderBy(*card, "part")


def digest_summary(queue: DataFrame) -> DataFrame:
    """Header figures of one digest (D14): rows in the message and rows needing confirmation."""
    return queue.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.count_if(F.col("status").isin(*K.UNCERTAIN_STATUSES)).alias("need_confirm"))
