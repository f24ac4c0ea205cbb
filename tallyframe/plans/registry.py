"""Registered queries: one callable per operator key of the coverage list.

Each entry takes ``(spark, sf_dir)``, derives its inputs from the driver tables
with Spark (``tallyframe.fixtures``), runs one library operator over the whole
input and returns the result DataFrame. Parameters (start day, months, as-of
time) are fixed per key so the oracle SQL can state the same ones.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from .. import fixtures as fx
from ..operators import listing, matching, reports

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn
    return deco


# ---- reports -----------------------------------------------------------------

@register("monthly_matrix")
def q_monthly_matrix(spark, sf):
    return reports.monthly_matrix(fx.ledger_o(spark, sf), start_day=1)


@register("monthly_matrix_day15")
def q_monthly_matrix_day15(spark, sf):
    return reports.monthly_matrix(fx.ledger_o(spark, sf), start_day=15)


@register("summary_all")
def q_summary_all(spark, sf):
    return reports.summary(fx.ledger_o(spark, sf))


@register("summary_month")
def q_summary_month(spark, sf):
    return reports.summary(fx.ledger_o(spark, sf), month="1999-06", start_day=1)


@register("category_stats")
def q_category_stats(spark, sf):
    return reports.category_stats(fx.ledger_o(spark, sf))


@register("annual_matrix")
def q_annual_matrix(spark, sf):
    return reports.annual_matrix(fx.ledger_o(spark, sf), start_day=1, annual_from="1998")


@register("spend_rollup")
def q_spend_rollup(spark, sf):
    return reports.spend_rollup(fx.ledger_o(spark, sf), start_day=15)


@register("period_list")
def q_period_list(spark, sf):
    return reports.period_list(fx.ledger_o(spark, sf), start_day=15)


@register("monthly_summary")
def q_monthly_summary(spark, sf):
    return reports.monthly_summary(fx.ledger_o(spark, sf), start_day=1, month="1999-06")


@register("category_share")
def q_category_share(spark, sf):
    return reports.category_share(fx.ledger_o(spark, sf), start_day=1)


@register("category_share_annual")
def q_category_share_annual(spark, sf):
    return reports.category_share_annual(fx.ledger_o(spark, sf), start_day=1, annual_from="1998")


@register("deposit_monthly")
def q_deposit_monthly(spark, sf):
    return reports.deposit_monthly(fx.deposits_e(spark, sf))


@register("merchant_totals")
def q_merchant_totals(spark, sf):
    return reports.merchant_totals(fx.ledger_e(spark, sf))


# ---- matching ----------------------------------------------------------------

@register("refund_pairs")
def q_refund_pairs(spark, sf):
    return matching.refund_pairs(fx.ledger_e(spark, sf))


@register("ledger_after_pairing")
def q_ledger_after_pairing(spark, sf):
    return listing.listing_columns(matching.apply_pairing(fx.ledger_e(spark, sf)))


@register("merge_candidates")
def q_merge_candidates(spark, sf):
    return matching.merge_candidates(fx.ledger_o(spark, sf), start_day=15)


@register("reimbursement_match")
def q_reimbursement_match(spark, sf):
    return matching.reimbursement_match(fx.ledger_e(spark, sf), fx.deposits_e(spark, sf), window_days=3)


# ---- listings ----------------------------------------------------------------

@register("ledger_list")
def q_ledger_list(spark, sf):
    return listing.ledger_page(fx.ledger_e(spark, sf))


@register("ledger_list_void")
def q_ledger_list_void(spark, sf):
    return listing.ledger_page(fx.ledger_e(spark, sf), status="void")


@register("ledger_list_uncat")
def q_ledger_list_uncat(spark, sf):
    return listing.ledger_page(fx.ledger_o(spark, sf), category="__uncat__", card="credit")


@register("ledger_list_year")
def q_ledger_list_year(spark, sf):
    return listing.ledger_page(fx.ledger_o(spark, sf), year="1998", start_day=15, status="confirmed")


@register("ledger_page")
def q_ledger_page(spark, sf):
    return listing.ledger_page(fx.ledger_o(spark, sf), limit=300, offset=200, year="1997")


@register("ledger_search")
def q_ledger_search(spark, sf):
    return listing.ledger_page(fx.ledger_e(spark, sf), q="宝-SHOP_")


@register("deposit_list")
def q_deposit_list(spark, sf):
    return listing.deposit_list(fx.deposits_e(spark, sf), since_days=7, as_of=fx.AS_OF)


@register("deposit_match_amount")
def q_deposit_match_amount(spark, sf):
    return listing.deposit_list(fx.deposits_e(spark, sf), amount=30.0)


@register("pending_count")
def q_pending_count(spark, sf):
    return listing.pending_count(fx.ledger_e(spark, sf))


@register("pending_list")
def q_pending_list(spark, sf):
    return listing.pending_list(fx.ledger_o(spark, sf), month="1996-02")


@register("category_drilldown")
def q_category_drilldown(spark, sf):
    return listing.category_drilldown(fx.ledger_o(spark, sf), month="1998-07", category="1-URGENT",
                                      sort_key="time", descending=False)


# ---- flagship ----------------------------------------------------------------

@register("netted_monthly_matrix")
def q_netted_monthly_matrix(spark, sf):
    from .flagship import netted_monthly_matrix
    return netted_monthly_matrix(spark, sf, start_day=15)


# ---- scalar functions ------------------------------------------------------------

from pyspark.sql import functions as F  # noqa: E402

from ..functions import periods as P  # noqa: E402
from ..functions import text as TX  # noqa: E402
from ..operators import extract  # noqa: E402
from ..sources import mail  # noqa: E402
from ..sources.tables import read_table  # noqa: E402


@register("html_to_lines")
def q_html_to_lines(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", TX.html_to_lines("html").alias("lines"))
    return p.select("page_id", F.size("lines").cast("bigint").alias("n_lines"),
                    F.array_join("lines", "\n").alias("text"))


@register("html_entities")
def q_html_entities(spark, sf):
    """Numeric entities (decimal, hexadecimal, Windows-1252, none), named ones with and without ';', and plain '&'."""
    k = F.col("k")
    t = fx.text_inputs(spark, sf).select("event_id", F.concat(
        F.lit("a&#"), (k + 200).cast("string"), F.lit(";b&#x"), F.hex(k + 8000), F.lit("; &#"), (k % 2 + 145).cast("string"),
        F.lit(";&#0;&eacute;&hellip;&copy &ampx &nosuch; & &amp;lt;"), "merchant_raw").alias("text"))
    return t.select("event_id", TX.unescape_entities(F.col("text")).alias("text"))


@register("html_flat_text")
def q_html_flat_text(spark, sf):
    p = read_table(spark, sf, "pages")
    # every third page has a plain part, every ninth an empty one
    plain = F.when(F.col("page_id") % 9 == 0, F.lit("")).when(F.col("page_id") % 3 == 0, F.concat(F.lit(" plain \n\t"), F.col("url")))
    return p.select("page_id", TX.html_flat_text(plain, F.col("html")).alias("flat"))


@register("mail_type")
def q_mail_type(spark, sf):
    return fx.mails_e(spark, sf).select("uid", TX.mail_type("sender", "subject").alias("email_type"))


@register("direction_map")
def q_direction_map(spark, sf):
    t = fx.text_inputs(spark, sf)
    return t.select("event_id", "action", TX.direction_of("action").alias("direction"))


@register("merchant_split")
def q_merchant_split(spark, sf):
    t = fx.text_inputs(spark, sf)
    ch, key = TX.merchant_split("merchant_raw")
    return t.select("event_id", "merchant_raw", ch.alias("channel"), key.alias("merchant_key"))


@register("fingerprint")
def q_fingerprint(spark, sf):
    return fx.ledger_e(spark, sf).select("id", "fingerprint")


@register("parse_amount")
def q_parse_amount(spark, sf):
    t = fx.text_inputs(spark, sf)
    return t.select("event_id", "amount_text", TX.parse_amount("amount_text").cast("double").alias("amount"))


@register("billing_period")
def q_billing_period(spark, sf):
    lo = fx.ledger_o(spark, sf)
    return lo.select("id", P.billing_period("txn_time", 1).alias("p1"),
                     P.billing_period("txn_time", 15).alias("p15"),
                     P.billing_period("txn_time", 28).alias("p28"))


@register("attribution_month")
def q_attribution_month(spark, sf):
    lo = fx.ledger_o(spark, sf)
    return lo.select("id", P.attribution_month("txn_time", 15).alias("m"),
                     P.attribution_year("txn_time", 15).alias("y"))


@register("period_range")
def q_period_range(spark, sf):
    periods = reports.period_list(fx.ledger_o(spark, sf), start_day=15)
    return periods.select("m", P.period_start("m", 15).alias("start_date"),
                          P.period_end("m", 15).alias("end_date"))


@register("json_extract")
def q_json_extract(spark, sf):
    a = fx.alerts_e(spark, sf)
    j = F.from_json(TX.json_object_text("reply"), "type string, amount double, card_last4 string")
    return a.select("source_msg_id", j["type"].alias("type"), j["amount"].alias("amount"),
                    j["card_last4"].alias("card_last4"))


@register("alert_normalise")
def q_alert_normalise(spark, sf):
    return extract.alert_normalise(fx.alerts_e(spark, sf))


@register("amount_hint")
def q_amount_hint(spark, sf):
    from ..operators.advice import amount_hints
    return amount_hints(fx.ledger_e(spark, sf))


@register("received_local")
def q_received_local(spark, sf):
    m = fx.mails_e(spark, sf)
    # every tenth mail has no time of receipt: the time of the batch stands in
    received = F.when(F.col("uid") % 10 != 7, F.col("received"))
    return m.select("uid", TX.received_local(received, F.lit(fx.AS_OF).cast("timestamp_ntz")).alias("received_local"))


# ---- mail sources ----------------------------------------------------------------

SENDERS = [K.CREDIT_DAILY_SENDER, K.DEBIT_SENDER]


@register("mail_scan")
def q_mail_scan(spark, sf):
    return mail.mail_scan(fx.mails_e(spark, sf))


@register("incremental_scan")
def q_incremental_scan(spark, sf):
    return mail.incremental_scan(fx.mails_e(spark, sf), 500).select("uid", "msg_id")


@register("scan_newest_n")
def q_scan_newest_n(spark, sf):
    return mail.scan_newest_n(fx.mails_e(spark, sf), 500, 100).select("uid", "msg_id")


@register("mail_search")
def q_mail_search(spark, sf):
    return mail.mail_search(fx.mails_e(spark, sf), SENDERS, since="2024/01/10")


@register("sender_union")
def q_sender_union(spark, sf):
    return mail.sender_union(fx.mails_e(spark, sf), SENDERS, since="2024/01/10")


@register("recent_mail_count")
def q_recent_mail_count(spark, sf):
    return mail.recent_mail_count(fx.mails_e(spark, sf), fx.AS_OF, 7)


def _log_and_batch(spark, sf):
    m = fx.mails_e(spark, sf)
    log = m.filter(F.col("received") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    new = m.filter(F.col("received") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return log, new


@register("mail_dedup")
def q_mail_dedup(spark, sf):
    log, new = _log_and_batch(spark, sf)
    return mail.mail_dedup(new, log).select("msg_id", "uid")


@register("mail_log_upsert")
def q_mail_log_upsert(spark, sf):
    log, new = _log_and_batch(spark, sf)
    log = log.select("msg_id", "uid", F.lit("parsed").alias("status"))
    new = new.select("msg_id", "uid", F.lit("reparsed").alias("status"))
    return mail.mail_log_upsert(log, new)


# ---- extraction ------------------------------------------------------------------

@register("mail_route")
def q_mail_route(spark, sf):
    return extract.mail_route(fx.mails_e(spark, sf)).select(
        "uid", "msg_id", "email_type", "parser_card_type", "parser_output")


@register("digest_extract")
def q_digest_extract(spark, sf):
    rows = extract.digest_extract(fx.digests_e(spark, sf))
    return rows.select("source_msg_id", "card_last4", "txn_time", F.col("amount").cast("double").alias("amount"),
                       "action", "direction", "merchant_raw", "merchant_key", "channel",
                       F.col("avail_credit").cast("double").alias("avail_credit"), "points", "fingerprint")


def _mail_status(spark, sf):
    # raw mails without a body (a claimed digest yields 0 rows), and the rendered digest mails
    raw = fx.mails_e(spark, sf).select("uid", "msg_id", "sender", "subject", F.lit(None).cast("string").alias("html"))
    uid = F.conv(F.substring(F.md5("source_msg_id"), 1, 12), 16, 10).cast("bigint")
    digests = fx.digests_e(spark, sf).select(uid.alias("uid"), F.col("source_msg_id").alias("msg_id"), "sender", "subject", "html")
    mails = raw.unionByName(digests)
    norm = extract.alert_normalise(fx.alerts_e(spark, sf))
    ai = norm.select(F.substring("source_msg_id", 2, 20).cast("bigint").alias("uid"),
                     F.col("error").isNull().alias("kept"))
    return extract.mail_outcomes(mails, ai)


@register("mail_status")
def q_mail_status(spark, sf):
    return _mail_status(spark, sf)


@register("ingest_stats")
def q_ingest_stats(spark, sf):
    return mail.ingest_stats(_mail_status(spark, sf))


@register("alert_route")
def q_alert_route(spark, sf):
    _, ledger = extract.alert_route(extract.alert_normalise(fx.alerts_e(spark, sf)), "debit")
    return ledger.select("source_msg_id", "card_last4", "card_type", "txn_time",
                         F.col("amount").cast("double").alias("amount"), "action", "direction",
                         "merchant_raw", "merchant_key", "channel", "fingerprint")


@register("alert_deposits")
def q_alert_deposits(spark, sf):
    deposits, _ = extract.alert_route(extract.alert_normalise(fx.alerts_e(spark, sf)), "debit")
    return deposits.withColumn("amount", F.col("amount").cast("double"))


@register("alert_totals")
def q_alert_totals(spark, sf):
    return extract.alert_totals(extract.alert_normalise(fx.alerts_e(spark, sf)), None)


# ---- advice ----------------------------------------------------------------------

from ..operators import advice as ADV  # noqa: E402
from ..operators import commands as CMD  # noqa: E402
from ..operators import notify as NT  # noqa: E402
from ..sources import ingest as ING  # noqa: E402
from ..sources import sinks  # noqa: E402

EDIT_COLS = ["id", "voided", "category", "category_src", "status", "note"]


def _picked(spark, sf):
    return ADV.advice_pick(fx.advice_merchants(spark, sf), fx.advice_e(spark, sf))


def _pick_cols(df):
    return df.select("merchant_key", "adv_key", "category", "operation",
                     F.array_join(F.transform("related_ids", lambda x: x.cast("string")), ",").alias("related_ids"))


@register("pending_merchants")
def q_pending_merchants(spark, sf):
    return reports.pending_merchants(fx.ledger_e(spark, sf), fx.suggestions_e(spark, sf))


@register("pending_header")
def q_pending_header(spark, sf):
    return reports.pending_header(reports.pending_merchants(fx.ledger_e(spark, sf), fx.suggestions_e(spark, sf)))


@register("advice_prefix_join")
def q_advice_prefix_join(spark, sf):
    return _pick_cols(_picked(spark, sf))


@register("advice_prefix_wide")
def q_advice_prefix_wide(spark, sf):
    return ADV.advice_pick(fx.wide_merchants(spark, sf), fx.wide_advice(spark, sf)).select("merchant_key", "adv_key", "category")


@register("advice_valid")
def q_advice_valid(spark, sf):
    return _pick_cols(ADV.advice_valid(_picked(spark, sf), fx.categories_v(spark)))


@register("advice_uncertain")
def q_advice_uncertain(spark, sf):
    return _pick_cols(ADV.advice_uncertain(_picked(spark, sf), fx.categories_v(spark)))


@register("merchant_recent20")
def q_merchant_recent20(spark, sf):
    le = fx.ledger_e(spark, sf)
    return ADV.merchant_recent(le, ADV.open_merchants(le), 20)


@register("merchant_suggest")
def q_merchant_suggest(spark, sf):
    dec = ADV.advice_valid(_picked(spark, sf), fx.categories_v(spark)).select("merchant_key", "category")
    return ADV.merchant_suggest(fx.ledger_e(spark, sf), dec).select(*EDIT_COLS)


@register("merchant_clear")
def q_merchant_clear(spark, sf):
    unsure = ADV.advice_uncertain(_picked(spark, sf), fx.categories_v(spark)).select("merchant_key")
    return ADV.merchant_clear(fx.ledger_e(spark, sf), unsure).select(*EDIT_COLS)


@register("merchant_confirm")
def q_merchant_confirm(spark, sf):
    dec = ADV.advice_valid(_picked(spark, sf), fx.categories_v(spark)).select("merchant_key", "category")
    return ADV.merchant_confirm(fx.ledger_e(spark, sf), dec).select(*EDIT_COLS)


@register("classify_apply")
def q_classify_apply(spark, sf):
    out, _ = ADV.classify_apply(fx.ledger_e(spark, sf), fx.advice_merchants(spark, sf), fx.advice_e(spark, sf),
                                fx.categories_v(spark))
    return out.select(*EDIT_COLS)


def _suggestions(spark, sf):
    le = fx.ledger_e(spark, sf)
    reqs = ADV.suggestion_requests(_picked(spark, sf), le)
    return ADV.suggestion_upsert(fx.suggestions_e(spark, sf), reqs, le)


@register("suggestion_upsert")
def q_suggestion_upsert(spark, sf):
    return _suggestions(spark, sf)[0]


@register("classify_counters")
def q_classify_counters(spark, sf):
    _, counters = ADV.classify_apply(fx.ledger_e(spark, sf), fx.advice_merchants(spark, sf), fx.advice_e(spark, sf),
                                     fx.categories_v(spark))
    return counters


@register("suggestion_invalid")
def q_suggestion_invalid(spark, sf):
    return _suggestions(spark, sf)[1]


@register("classification_batches")
def q_classification_batches(spark, sf):
    from ..operators.classify import classification_batches
    m = fx.wide_merchants(spark, sf).select(F.lit("pending").alias("status"), F.lit(False).alias("voided"), "merchant_key")
    sizes = classification_batches(m).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("merchant_key").alias("d"))
    return sizes.agg(F.sum("n").alias("merchants"), (F.sum("d") == F.sum("n")).alias("each_once"), (F.max("n") <= 40).alias("bounded"))


@register("sql_functions")
def q_sql_functions(spark, sf):
    from ..functions.sql import register_sql_functions
    register_sql_functions(spark)
    lo = fx.ledger_o(spark, sf).select("id", "txn_time", "direction", "effective_month")
    return spark.sql("SELECT id, billing_period(txn_time, 15) AS p15, attribution_month(effective_month, txn_time, 15) AS m, "
                     "clamp_start_day(CAST(id % 40 AS STRING)) AS d, is_spend(direction) AS spend FROM {lo}", lo=lo)


# ---- notify ----------------------------------------------------------------------

@register("notify_queue")
def q_notify_queue(spark, sf):
    q = NT.notify_queue(fx.ledger_e(spark, sf), fx.suggestions_e(spark, sf))
    return q.withColumn("amount", F.col("amount").cast("double"))


@register("notify_digest")
def q_notify_digest(spark, sf):
    return NT.notify_digest(NT.notify_queue(fx.ledger_e(spark, sf), fx.suggestions_e(spark, sf)))


@register("digest_message")
def q_digest_message(spark, sf):
    m = NT.digest_message(NT.notify_queue(fx.ledger_e(spark, sf), fx.suggestions_e(spark, sf)))
    return m.select("section", "card_type", "card_last4", "id", "sub", "line")


@register("digest_text")
def q_digest_text(spark, sf):
    return NT.digest_text(NT.notify_queue(fx.ledger_e(spark, sf), fx.suggestions_e(spark, sf)))


@register("ledger_after_notify")
def q_ledger_after_notify(spark, sf):
    le = fx.ledger_e(spark, sf)
    sent = NT.notify_queue(le, fx.suggestions_e(spark, sf)).select("id")
    return CMD.mark_notified(le, sent, fx.AS_OF, "mail").select("id", "notify_status", "notified_at", "notify_channel")


@register("freshness")
def q_freshness(spark, sf):
    mails = mail.mail_scan(fx.mails_e(spark, sf)).withColumnRenamed("received", "fetched_at")
    return reports.freshness(fx.ledger_e(spark, sf), fx.deposits_e(spark, sf), mails,
                             fx.categories_v(spark), fx.knowledge_v(spark))


# ---- ingest upserts ----------------------------------------------------------------

def _cut(df, lo=None, hi=None):
    if lo:
        df = df.filter(F.col("txn_time") >= F.lit(lo).cast("timestamp_ntz"))
    if hi:
        df = df.filter(F.col("txn_time") < F.lit(hi).cast("timestamp_ntz"))
    return df


def _redelivered(df):
    first = _cut(df, lo="2024-01-15 00:00:00").withColumn("arrival", F.col("id"))
    again = _cut(df, lo="2024-01-25 00:00:00").withColumn("arrival", F.col("id") + 10 ** 9)
    return first.unionByName(again)


@register("txn_insert_ignore")
def q_txn_insert_ignore(spark, sf):
    le = fx.ledger_e(spark, sf)
    ins = ING.txn_insert_ignore(_cut(le, hi="2024-01-20 00:00:00"), _redelivered(le))
    return ins.select("id", "fingerprint", "status", "category")


@register("txn_batch_stats")
def q_txn_batch_stats(spark, sf):
    le = fx.ledger_e(spark, sf)
    batch = _redelivered(le)
    return ING.batch_stats(batch, ING.txn_insert_ignore(_cut(le, hi="2024-01-20 00:00:00"), batch))


@register("deposit_insert_ignore")
def q_deposit_insert_ignore(spark, sf):
    d = fx.deposits_e(spark, sf)
    ins = ING.deposit_insert_ignore(_cut(d, hi="2024-01-20 00:00:00"), _redelivered(d))
    return ins.select("id", "source_msg_id", F.col("amount").cast("double").alias("amount"))


def _orders_categories(spark, sf):
    pr = read_table(spark, sf, "orders").select("o_orderpriority").distinct()
    num = F.substring("o_orderpriority", 1, 1).cast("int")
    existing = (pr.filter(F.col("o_orderpriority") != "4-NOT SPECIFIED")
                .select(F.concat(F.lit("p"), num.cast("string")).alias("key"), F.col("o_orderpriority").alias("name"),
                        F.lit("old").alias("descr"), (num % 2).alias("active"), (10 - num).alias("sort")))
    seed = pr.select(F.concat(F.lit("p"), num.cast("string")).alias("key"),
                     F.lower("o_orderpriority").alias("name"),
                     F.concat(F.lit("seed "), F.col("o_orderpriority")).alias("descr"), (num - 1).alias("position"))
    return existing, seed


@register("category_seed_upsert")
def q_category_seed_upsert(spark, sf):
    existing, seed = _orders_categories(spark, sf)
    return ING.category_seed_upsert(existing, seed)


@register("orphan_check")
def q_orphan_check(spark, sf):
    return ING.orphan_check(fx.ledger_e(spark, sf), fx.mails_e(spark, sf))


@register("ledger_json_export")
def q_ledger_json_export(spark, sf):
    return sinks.as_json_rows(listing.listing_columns(fx.ledger_e(spark, sf)))


# ---- commands ----------------------------------------------------------------------

@register("ledger_after_void")
def q_ledger_after_void(spark, sf):
    c = fx.commands_o(spark, sf).filter(F.col("op").isin("void", "restore"))
    return CMD.apply_edits(fx.ledger_o(spark, sf), c).select(*EDIT_COLS)


@register("ledger_after_edit")
def q_ledger_after_edit(spark, sf):
    return CMD.apply_edits(fx.ledger_o(spark, sf), fx.commands_o(spark, sf)).select(*EDIT_COLS)


@register("command_validate")
def q_command_validate(spark, sf):
    return CMD.command_validate(fx.op_requests_e(spark, sf), fx.categories_v(spark))


def _split(spark, sf):
    return CMD.split_apply(fx.ledger_e(spark, sf), fx.splits_e(spark, sf))


@register("split_children")
def q_split_children(spark, sf):
    _, kids, _ = _split(spark, sf)
    return kids.select("id", "fingerprint", "txn_time", F.col("amount").cast("double").alias("amount"),
                       "merchant_key", "status", "note")


@register("split_then_pair")
def q_split_then_pair(spark, sf):
    _, _, led = _split(spark, sf)
    return matching.refund_pairs(led)


def _merge(spark, sf):
    return CMD.merge_apply(fx.ledger_e(spark, sf), fx.merge_ids_e(spark, sf), fx.merges_e(spark, sf), start_day=15)


@register("merge_net")
def q_merge_net(spark, sf):
    res, rows, _ = _merge(spark, sf)
    return rows.select("id", "txn_time", F.col("amount").cast("double").alias("amount"), "direction",
                       "effective_month", "status", "category", "merchant_key", "card_last4")


@register("merge_offset")
def q_merge_offset(spark, sf):
    res, _, led = _merge(spark, sf)
    return res.filter("offset").select("request_id", "count")


@register("offset_rejected")
def q_offset_rejected(spark, sf):
    res, _, _ = _merge(spark, sf)
    return res.filter(~F.col("ok")).select("request_id", "error", "count")


@register("command_table")
def q_command_table(spark, sf):
    out, _, _ = CMD.apply_command_table(fx.ledger_e(spark, sf), fx.command_table_e(spark, sf))
    return out.select("id", F.col("amount").cast("double").alias("amount"), "voided", "category", "status", "note", "merged_into", "offset_of")


@register("merge_overlap")
def q_merge_overlap(spark, sf):
    res, _, _ = CMD.merge_apply(fx.ledger_e(spark, sf), *fx.merge_overlaps_e(spark, sf))
    return res.select("request_id", "ok", "error", "offset", "net", "count")


@register("category_rename")
def q_category_rename(spark, sf):
    ren = spark.createDataFrame([("cat1", "餐饮"), ("cat3", "cat3")], "old_name string, new_name string")
    led, _ = CMD.category_rename(fx.ledger_e(spark, sf), fx.knowledge_v(spark), ren)
    return led.select("id", "category")


def _category_update(spark, sf):
    changes = spark.createDataFrame([("k1", "餐饮", None), ("k2", None, "new words"), ("kX", "none", None)],
                                    "key string, name string, descr string")
    return CMD.category_update(fx.ledger_e(spark, sf), fx.knowledge_v(spark), fx.categories_v(spark), changes)


@register("category_update")
def q_category_update(spark, sf):
    return _category_update(spark, sf)[1].groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("edit_results")
def q_edit_results(spark, sf):
    return CMD.edit_results(fx.ledger_o(spark, sf), fx.commands_o(spark, sf))


@register("category_delete")
def q_category_delete(spark, sf):
    keys = spark.createDataFrame([("k1",), ("k4",), ("k9",), ("kX",)], "key string")
    res, _, _, _ = CMD.category_delete(fx.ledger_e(spark, sf), fx.knowledge_v(spark), fx.categories_v(spark), keys)
    return res


from . import streams  # noqa: E402,F401 - registers the stream queries
