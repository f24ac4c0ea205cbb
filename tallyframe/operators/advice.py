"""Classification advice.

The classifier itself (an external agent in the reference) is an input here:
an advice table with one row per reply key,

    (batch_id, adv_key, pos, category, operation, related_ids array<bigint>, reason)

where ``pos`` is the key's position in the reply. Merchants are grouped into
classification batches (``batch_id``); the tolerant key lookup joins beginnings of
names within a batch, so it grows with the length of the names, whatever a batch holds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def open_merchants(ledger: DataFrame, include_suggested: bool = True) -> DataFrame:
    """Merchants with live open rows (J8 input, R9): merchant_key."""
    sts = K.OPEN_STATUSES if include_suggested else ("pending",)
    return (ledger.filter(F.col("status").isin(*sts) & ~F.col("voided") & F.col("merchant_key").isNotNull())
            .select("merchant_key").distinct())


def merchant_recent(ledger: DataFrame, merchants: DataFrame, k: int = K.RECENT_PER_MERCHANT) -> DataFrame:
    """Latest k live rows of each given merchant, any status.

    ``row_number() <= k`` is planned with a WindowGroupLimit before the
    shuffle, so each map task forwards at most k rows per merchant: a hot
    merchant cannot flood one reducer.
    """
    lv = ledger.filter(~F.col("voided")).join(merchants, "merchant_key", "left_semi")
    w = Window.partitionBy("merchant_key").orderBy(F.col("txn_time").desc(), F.col("id").desc())
    return (lv.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select("merchant_key", "id", F.col("amount").cast("double").alias("amount"), "txn_time",
                    "direction", "card_last4", F.col("rn").cast("bigint").alias("rn")))


def _prefixes(text: Column) -> Column:
    """All beginnings of a text, the empty one and itself included."""
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda n: F.substr(text, F.lit(1), n))


def advice_pick(merchants: DataFrame, advice: DataFrame) -> DataFrame:
    """Tolerant advice lookup per merchant.

    Exact key first; otherwise the first key (by reply position) where either
    string is a prefix of the other. ``merchants``: (merchant_key, batch_id).

    A prefix index: a key begins with a merchant's name if the name is one of the key's beginnings, and the other way
    round. So there are two equi-joins on (batch, text), one with the keys' beginnings and one with the merchants';
    of the keys that share a beginning only the first by position is kept, before anything meets. No merchant is
    compared with a key that it does not match.
    """
    fields = ["adv_key", "category", "operation", "related_ids", "reason"]
    a = advice.filter(F.col("adv_key").isNotNull()).select("batch_id", "pos", *fields)
    m = merchants.select("merchant_key", "batch_id")
    key = F.struct("pos", F.struct(*fields).alias("x"))
    begun = a.withColumn("text", F.explode(_prefixes(F.col("adv_key")))).groupBy("batch_id", "text").agg(
        F.min_by(key, "pos").alias("found"))
    whole = a.groupBy("batch_id", F.col("adv_key").alias("text")).agg(F.min_by(key, "pos").alias("found"))
    longer = m.withColumn("text", F.col("merchant_key")).join(begun, ["batch_id", "text"])
    shorter = m.withColumn("text", F.explode(_prefixes(F.col("merchant_key")))).join(whole, ["batch_id", "text"])
    fuzzy = F.col("found.x.adv_key") != F.col("merchant_key")
    best = (longer.unionByName(shorter).groupBy("merchant_key")
            .agg(F.min_by("found.x", F.struct(fuzzy.alias("fuzzy"), F.col("found.pos").alias("pos"))).alias("x"))
            .select("merchant_key", "x.*"))
    # merchants without any matching key keep an empty advice row
    return m.join(best, "merchant_key", "left")


def advice_valid(picked: DataFrame, categories: DataFrame) -> DataFrame:
    """Merchants whose suggested category is an active category (J6, semi-join)."""
    act = categories.filter(F.col("active") == 1).select(F.col("name").alias("category"))
    return picked.join(act, "category", "left_semi")


def advice_uncertain(picked: DataFrame, categories: DataFrame) -> DataFrame:
    """Merchants whose suggestion is missing or not an active category (J6, anti-join)."""
    act = categories.filter(F.col("active") == 1).select(F.col("name").alias("category"))
    return picked.join(act, "category", "left_anti")


def _merchant_update(ledger: DataFrame, decisions: DataFrame, mode: str) -> DataFrame:
    """Merchant-level status update (G10, Q5: voided rows are not excluded)."""
    d = decisions.select("merchant_key", F.col("category").alias("_cat"), F.lit(True).alias("_hit"))
    j = ledger.join(d, "merchant_key", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    st = F.col("status")
    if mode == "suggest":
        on = hit & st.isin(*K.OPEN_STATUSES)
        j = (j.withColumn("category", F.when(on, F.col("_cat")).otherwise(F.col("category")))
             .withColumn("category_src", F.when(on, F.lit(K.CATEGORY_SRC_AI)).otherwise(F.col("category_src")))
             .withColumn("status", F.when(on, F.lit("suggested")).otherwise(st)))
    elif mode == "clear":
        on = hit & (st == "suggested")
        j = (j.withColumn("category", F.when(on, F.lit(None)).otherwise(F.col("category")))
             .withColumn("category_src", F.when(on, F.lit(None)).otherwise(F.col("category_src")))
             .withColumn("status", F.when(on, F.lit("pending")).otherwise(st)))
    elif mode == "confirm":
        on = hit & st.isin(*K.OPEN_STATUSES)
        j = (j.withColumn("category", F.when(on, F.col("_cat")).otherwise(F.col("category")))
             .withColumn("category_src", F.when(on, F.lit(K.CATEGORY_SRC_MANUAL)).otherwise(F.col("category_src")))
             .withColumn("status", F.when(on, F.lit("confirmed")).otherwise(st)))
    else:
        raise ValueError(mode)
    return j.select(*ledger.columns)


def merchant_suggest(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """pending/suggested rows of the merchants -> suggested with the category."""
    return _merchant_update(ledger, decisions, "suggest")


def merchant_clear(ledger: DataFrame, merchants: DataFrame) -> DataFrame:
    """suggested rows of the merchants -> pending without category."""
    return _merchant_update(ledger, merchants.select("merchant_key", F.lit(None).cast("string").alias("category")),
                            "clear")


def merchant_confirm(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """pending/suggested rows of the merchants -> confirmed with the category."""
    return _merchant_update(ledger, decisions, "confirm")


def classify_apply(ledger: DataFrame, merchants: DataFrame, advice: DataFrame,
                   categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply one classification run (G11): suggest valid categories, clear the rest.

    Returns (new ledger, counters[merchants, suggested, uncertain]). Both
    updates are folded into one join of the ledger with the per-merchant
    decision table.
    """
    picked = advice_pick(merchants, advice)
    valid = advice_valid(picked, categories).select("merchant_key", "category", F.lit("suggest").alias("_act"))
    unsure = advice_uncertain(picked, categories).select("merchant_key", F.lit(None).cast("string").alias("category"),
                                                         F.lit("clear").alias("_act"))
    dec = valid.unionByName(unsure)
    d = dec.select("merchant_key", F.col("category").alias("_cat"), "_act")
    j = ledger.join(d, "merchant_key", "left")
    st = F.col("status")
    sug = (F.col("_act") == "suggest") & st.isin(*K.OPEN_STATUSES)
    clr = (F.col("_act") == "clear") & (st == "suggested")
    out = (j.withColumn("category", F.when(sug, F.col("_cat")).when(clr, F.lit(None)).otherwise(F.col("category")))
           .withColumn("category_src", F.when(sug, F.lit(K.CATEGORY_SRC_AI)).when(clr, F.lit(None))
                       .otherwise(F.col("category_src")))
           .withColumn("status", F.when(sug, F.lit("suggested")).when(clr, F.lit("pending")).otherwise(st))
           .select(*ledger.columns))
    counters = dec.agg(F.count(F.lit(1)).alias("merchants"),
                       F.count_if(F.col("_act") == "suggest").alias("suggested"),
                       F.count_if(F.col("_act") == "clear").alias("uncertain"))
    return out, counters


# ---- G12: operation advice ---------------------------------------------------------------

def suggestion_requests(picked: DataFrame, ledger: DataFrame) -> DataFrame:
    """Fan the picked advice out to per-transaction upsert/delete requests (G11 -> G12).

    Valid operations with an id list give one request per listed id; 'none'
    gives a delete request for every open row of the merchant. Invalid
    operations give nothing (Q: the category is still applied elsewhere).
    """
    ops = picked.filter(F.col("operation").isin(*K.VALID_OPERATIONS) & F.col("related_ids").isNotNull())
    ups = ops.select(F.explode("related_ids").alias("transaction_id"), "operation", "related_ids", "reason")
    none = picked.filter(F.col("operation") == "none").select("merchant_key")
    open_rows = (ledger.filter(F.col("status").isin(*K.OPEN_STATUSES) & ~F.col("voided"))
                 .join(none, "merchant_key", "left_semi")
                 .select(F.col("id").alias("transaction_id"), F.lit("none").alias("operation"),
                         F.array().cast("array<bigint>").alias("related_ids"), F.lit("").alias("reason")))
    return ups.unionByName(open_rows)


def suggestion_upsert(existing: DataFrame, requests: DataFrame, ledger: DataFrame, now: str | None = None):
    """Validate and upsert operation advice keyed by transaction id.

    Each request is checked for itself: its operation must be known, and its
    related ids (de-duplicated in order, the subject prepended when missing) must
    all be live rows. Of a subject's valid requests the last by ``seq`` stands (a
    table without ``seq`` is one instant: the largest operation and ids stand);
    'none' deletes the subject's advice. A refused request changes nothing.
    Returns (new suggestions, rejected). Related-id lists are JSON text '[1, 2]'
    as stored by the reference. If ``existing`` has ``created_at``, an update
    keeps it and new advice gets ``now``.
    """
    seq = F.col("seq").cast("bigint") if "seq" in requests.columns else F.lit(0).cast("bigint")
    own = F.col("transaction_id")
    norm = requests.select(own, seq.alias("seq"), "operation", "reason", F.array_distinct(
        F.when(F.array_contains("related_ids", own), F.col("related_ids"))
        .otherwise(F.array_prepend("related_ids", own))).alias("ids"))
    known = F.col("operation").isin(*K.VALID_OPERATIONS)
    live = ledger.filter(~F.col("voided")).select(F.col("id").alias("ref"), F.lit(True).alias("_live"))
    key = ["transaction_id", "seq", "operation", "ids"]
    checked = (norm.withColumn("ref", F.explode(F.when(known, F.col("ids")).otherwise(F.array(F.lit(None).cast("bigint")))))
               .join(live, "ref", "left")
               .groupBy(*key).agg(F.every(F.coalesce("_live", F.lit(False))).alias("all_live"), F.max("reason").alias("reason")))
    error = (F.when(F.col("operation") == "none", F.lit(None))
             .when(~known | F.col("operation").isNull(), F.lit("invalid operation"))
             .when(~F.col("all_live"), F.lit("transaction not found or voided")))
    checked = checked.withColumn("error", error)
    rejected = checked.filter(F.col("error").isNotNull()).select("transaction_id", "operation", "error")
    last = (checked.filter(F.col("error").isNull()).groupBy("transaction_id")
            .agg(F.max_by(F.struct("operation", "ids", "reason"), F.struct("seq", F.col("operation") != "none", "operation", "ids"))
                 .alias("u")).select("transaction_id", "u.*"))
    extra = ["created_at"] if "created_at" in existing.columns else []
    new = last.filter(F.col("operation") != "none").select(
        "transaction_id", "operation",
        F.concat(F.lit("["), F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.lit("]"))
        .alias("related_transaction_ids"),
        strip_reason(F.col("reason")).alias("reason"))
    if extra:
        born = existing.select("transaction_id", F.col("created_at").alias("_born"))
        new = new.join(born, "transaction_id", "left").withColumn("created_at", F.coalesce(
            "_born", F.lit(now).cast(existing.schema["created_at"].dataType))).drop("_born")
    kept = existing.join(last.select("transaction_id"), "transaction_id", "left_anti")
    columns = ["transaction_id", "operation", "related_transaction_ids", "reason", *extra]
    return kept.select(*columns).unionByName(new.select(*columns)), rejected


def amount_hints(ledger: DataFrame) -> DataFrame:
    """Money hint per merchant (B15): merchant_key, n, hint. Amounts are counted once each before they meet;
    at most the four smallest of a merchant are ever held together."""
    from ..functions.text import amount_hint_text
    live = ledger.filter(~F.col("voided")).groupBy("merchant_key", F.round("amount", 2).alias("a")).agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("merchant_key").orderBy("a"))
    g = (live.withColumn("r", rank).groupBy("merchant_key").agg(
        F.sum("c").alias("n"), F.count("a").alias("k"), F.max("a").alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("r") <= 4, F.col("a")))).alias("few")))
    shown = F.when(F.col("k") <= 4, F.col("few")).otherwise(F.concat("few", F.array("top")))
    return g.select("merchant_key", "n", amount_hint_text(F.col("n"), shown).alias("hint"))


def strip_reason(c):
    from ..functions.text import strip_ws
    return strip_ws(F.coalesce(c.cast("string"), F.lit("")))
