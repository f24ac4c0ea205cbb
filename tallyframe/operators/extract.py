"""Extraction jobs (C1, C3-C6, B14): mails -> transactions / deposits.

The daily digest parser is a greedy line scan in the reference. Here it is two
column expressions over the array of visible lines, evaluated per mail (no Python):

1. for every time line i, its candidate: the first amount line among the next
   three lines and the first detail line after that amount, still inside the
   three-line look-ahead (``filter`` over an index ``sequence``);
2. a fold over the candidates in line order that accepts one iff i >= next_free, and then
   next_free = detail + 1. This is exactly the greedy scan, including time
   lines that the look-ahead steps over. Where no candidate overlaps the one before it, as in every
   well-formed digest, all are accepted and nothing is folded.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.fence import fence
from ..functions.text import (direction_of, fingerprint, html_to_lines, json_object_text, mail_type,
                              merchant_split, parse_amount, parse_int, strip_ws)


def _first_index_or_null(seq: Column, pred) -> Column:
    hits = F.filter(seq, pred)
    return F.when(F.size(hits) > 0, F.element_at(hits, 1))


#: One bit for each digest pattern.
TIME, AMOUNT, DETAIL, DATE, AVAIL, POINTS = (1 << i for i in range(6))


def line_kinds(lines: Column) -> Column:
    """Classify every line once (array of bit sets). A pattern is tried only on lines that begin as it must."""
    def bits(ln: Column) -> Column:
        def bit(guard: Column, pattern: str, value: int) -> Column:
            return F.when(guard & F.rlike(ln, F.lit(pattern)), F.lit(value)).otherwise(F.lit(0))

        clock = (F.length(ln) == 8) & (F.substring(ln, 3, 1) == ":")
        return (bit(clock, K.RE_TIME, TIME) + bit(F.startswith(ln, F.lit("CNY")), K.RE_AMOUNT, AMOUNT)
                + bit(F.startswith(ln, F.lit("尾号")), K.RE_DETAIL, DETAIL) + bit(F.contains(ln, F.lit("您的消费明细")), K.RE_DATE, DATE)
                + bit(F.startswith(ln, F.lit("￥")), K.RE_AVAIL, AVAIL) + bit(~clock, K.RE_POINTS, POINTS))

    return F.transform(lines, bits)


def _kind(kinds: Column, i, kind: int) -> Column:
    return F.coalesce(F.get(kinds, i).bitwiseAND(F.lit(kind)) != 0, F.lit(False))


def _indices(arr: Column) -> Column:
    """0 .. size-1 (empty for an empty array; ``sequence(0, -1)`` would count down)."""
    n = F.size(arr)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def digest_triples(kinds: Column) -> Column:
    """Accepted (time, amount, detail) line-index triples of a digest body."""
    return accepted(candidates(kinds))


def candidates(kinds: Column) -> Column:
    """For every time line that has an amount and then a detail within the look-ahead: the three lines' indexes.

    Works on the per-line bits, so each look-up inside the look-ahead window is
    an array access, not a regex evaluation.
    """
    idx = _indices(kinds)
    if K.DIGEST_LOOKAHEAD != 3:
        raise ValueError("the unrolled look-ahead below is written for three lines")

    def candidate(i):
        # the look-ahead window is lines i+1 .. i+3: unrolled into plain lookups
        a = [_kind(kinds, i + d, AMOUNT) for d in (1, 2, 3)]
        dt = [_kind(kinds, i + d, DETAIL) for d in (1, 2, 3)]
        ja = F.when(a[0], i + 1).when(a[1], i + 2).when(a[2], i + 3)
        jd = F.when(a[0], F.when(dt[1], i + 2).when(dt[2], i + 3)).when(a[1], F.when(dt[2], i + 3))
        return F.struct(i.alias("i"), ja.cast("int").alias("ja"), jd.cast("int").alias("jd"))

    times = F.filter(idx, lambda i: _kind(kinds, i, TIME))
    return F.filter(F.transform(times, candidate), lambda c: c["ja"].isNotNull() & c["jd"].isNotNull())


def accepted(cands: Column) -> Column:
    """The candidates that the greedy scan takes. Those whose time line lies behind the one before's detail line
    begin anew, whatever was taken before; only within a run of overlapping ones does a choice depend on the last."""
    clear = F.forall(F.sequence(F.lit(1), F.greatest(F.size(cands) - 1, F.lit(1))),
                     lambda k: F.coalesce(F.get(cands, k)["i"] > F.get(cands, k - 1)["jd"], F.lit(True)))
    folded = F.aggregate(
        cands, F.struct(F.lit(0).alias("free"), F.slice(cands, 1, 0).alias("out")),
        lambda acc, c: F.when(c["i"] >= acc["free"], F.struct((c["jd"] + 1).alias("free"), F.array_append(acc["out"], c).alias("out")))
        .otherwise(acc))["out"]
    return F.when(clear, cands).otherwise(folded)


def digest_extract(mails: DataFrame, html_col: str = "html", id_col: str = "source_msg_id", keep: Sequence[str] = ()) -> DataFrame:
    """Digest mails -> transaction rows (C4). Mails without a date line give no rows.

    A transaction whose date or time is no calendar date or time of day is left
    out here and found by :func:`digest_rejects`; it never stops the job. ``keep``: columns of the mail that its
    transactions carry.
    """
    rows = digest_rows(mails, html_col, id_col, keep).filter(F.col("txn_time").isNotNull()).drop("time_text")
    return rows.withColumn("fingerprint", fingerprint("card_last4", "txn_time", "amount", "merchant_raw", "action"))


def digest_rejects(mails: DataFrame, html_col: str = "html", id_col: str = "source_msg_id") -> DataFrame:
    """Quarantine of C4: transactions whose date and time text cannot be a time."""
    return (digest_rows(mails, html_col, id_col).filter(F.col("txn_time").isNull())
            .select("source_msg_id", "time_text", "card_last4", "amount", "merchant_raw", "action"))


def digest_rows(mails: DataFrame, html_col: str = "html", id_col: str = "source_msg_id", keep: Sequence[str] = ()) -> DataFrame:
    """All transactions of digest mails, with the time as text and, where it is one, as a time.

    Steps are separate projections so that every per-mail value (lines, line
    flags, header indexes) is computed once and then referenced. The texts of an
    accepted transaction travel with it; the mail's lines do not.
    """
    m = fence(mails.select(F.col(id_col).alias("source_msg_id"), html_to_lines(F.col(html_col)).alias("lines"), *keep))
    m = fence(m.withColumn("kinds", line_kinds(F.col("lines"))))
    idx = _indices(F.col("kinds"))
    kinds = F.col("kinds")
    m = fence(m.withColumn("date_i", _first_index_or_null(idx, lambda i: _kind(kinds, i, DATE))))
    m = m.filter(F.col("date_i").isNotNull())
    m = m.withColumn("avail_i", _first_index_or_null(
        idx, lambda i: (i < F.col("date_i")) & _kind(kinds, i, AVAIL)))
    m = fence(m.withColumn("points_i", _first_index_or_null(
        idx, lambda i: (i > F.col("avail_i")) & (i < F.col("date_i")) & _kind(kinds, i, POINTS))))
    at = lambda c: F.element_at(F.col("lines"), F.col(c) + 1)
    date_line = at("date_i")
    m = m.withColumn("h", F.struct(
        parse_amount(F.regexp_extract(at("avail_i"), K.RE_AVAIL, 1)).alias("avail_credit"),
        parse_int(F.regexp_extract(at("points_i"), K.RE_POINTS, 1)).alias("points"),
        F.concat_ws("-", F.regexp_extract(date_line, K.RE_DATE, 1), F.regexp_extract(date_line, K.RE_DATE, 2),
                    F.regexp_extract(date_line, K.RE_DATE, 3)).alias("date_iso")))
    m = fence(m)
    m = fence(m.select("source_msg_id", "h", "lines", candidates(F.col("kinds")).alias("cands"), *keep))
    lines = F.col("lines")
    texts = F.transform(accepted(F.col("cands")), lambda x: F.struct(
        F.element_at(lines, x["i"] + 1).alias("time"), F.element_at(lines, x["ja"] + 1).alias("amount"),
        F.element_at(lines, x["jd"] + 1).alias("detail")))
    m = fence(m.select("source_msg_id", "h", texts.alias("texts"), *keep))
    t = m.select("source_msg_id", "h", F.explode("texts").alias("t"), *keep)
    detail = F.col("t.detail")
    raw = strip_ws(F.regexp_extract(detail, K.RE_DETAIL, 3))
    action = F.regexp_extract(detail, K.RE_DETAIL, 2)
    channel, mkey = merchant_split(raw)
    time_text = F.concat_ws(" ", F.col("h.date_iso"), F.regexp_extract("t.time", K.RE_TIME, 1))
    return t.select(
        "source_msg_id",
        F.regexp_extract(detail, K.RE_DETAIL, 1).alias("card_last4"),
        F.lit("credit").alias("card_type"),
        time_text.alias("time_text"),
        time_text.try_cast("timestamp_ntz").alias("txn_time"),
        parse_amount(F.regexp_extract("t.amount", K.RE_AMOUNT, 1)).alias("amount"),
        F.lit("CNY").alias("currency"),
        action.alias("action"),
        direction_of(action).alias("direction"),
        raw.alias("merchant_raw"),
        mkey.alias("merchant_key"),
        channel.alias("channel"),
        F.col("h.avail_credit").alias("avail_credit"),
        F.col("h.points").alias("points"),
        *keep,
    )


# ---- AI alert replies ------------------------------------------------------------

ALERT_JSON = ("struct<type:string,card_last4:string,amount:string,time:string,counterparty:string,"
              "channel:string,kind:string,note:string>")


def alert_normalise(replies: DataFrame, received_col: str = "received", reply_col: str = "reply", keep: Sequence[str] = ()) -> DataFrame:
    """Normalise AI alert replies (B13 + B14).

    The JSON object is the text from the first '{' to the last '}'; a type
    outside the taxonomy or a missing amount becomes an ``error`` row (the
    reference raises); ``ignore`` and amounts <= 0 are dropped; a time that is
    missing, or that no time can be read from, falls back to the received
    minute; strings are trimmed with null -> ''. Amounts round half up on their
    decimal text (2.675 -> 2.68). ``keep``: columns carried along.
    """
    j = F.from_json(json_object_text(F.col(reply_col)), ALERT_JSON)
    r = fence(replies.withColumn("j", j))
    typ = F.col("j.type")
    amount = F.round(F.col("j.amount").try_cast("double"), 2)
    err = (F.when(~F.coalesce(typ.isin(*K.ALERT_TYPES), F.lit(False)), F.lit("invalid type"))
           .when((typ != K.ALERT_IGNORE) & amount.isNull(), F.lit("missing amount")))
    wanted = err.isNotNull() | ((typ != K.ALERT_IGNORE) & (amount > 0))

    def s(c):
        return strip_ws(F.coalesce(F.col(c), F.lit("")))
    received_min = F.date_format(F.col(received_col), "yyyy-MM-dd HH:mm")
    given = strip_ws(F.coalesce(F.nullif(F.col("j.time"), F.lit("")), received_min))
    time_txt = F.when(given.try_cast("timestamp_ntz").isNotNull(), given).otherwise(received_min)
    return r.filter(wanted).select(
        "source_msg_id",
        F.when(err.isNull(), typ).alias("type"),
        F.when(err.isNull(), s("j.card_last4")).alias("card_last4"),
        F.when(err.isNull(), time_txt).alias("txn_time"),
        F.when(err.isNull(), amount).alias("amount"),
        F.when(err.isNull(), s("j.counterparty")).alias("counterparty"),
        F.when(err.isNull(), s("j.channel")).alias("channel"),
        F.when(err.isNull(), s("j.kind")).alias("kind"),
        F.when(err.isNull(), s("j.note")).alias("note"),
        err.alias("error"),
        *[F.col(c) for c in ("raw_text",) if c in replies.columns],
        *keep,
    )


def alert_route(normalised: DataFrame, card_type: str | None = "debit", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Route normalised alerts (C6): income -> deposits; expense / transfer_out -> ledger.

    transfer_out keeps action 'transfer' text but is booked with
    direction='expense' (Q7); an expense's merchant is 'channel-counterparty'
    when a channel is given. Without a card type nothing goes to the ledger. ``keep``: columns that both carry along.
    """
    ok = normalised.filter(F.col("error").isNull())
    deposits = ok.filter(F.col("type") == K.ALERT_INCOME).select(
        "source_msg_id", "card_last4", F.col("txn_time").try_cast("timestamp_ntz").alias("txn_time"),
        F.col("amount").cast("decimal(18,2)").alias("amount"), "kind",
        F.col("counterparty").alias("payer"), "note", *[F.col(c) for c in ("raw_text",) if c in normalised.columns], *keep)
    spend = ok.filter(F.col("type").isin(K.ALERT_EXPENSE, K.ALERT_TRANSFER_OUT))
    is_tr = F.col("type") == K.ALERT_TRANSFER_OUT
    if card_type is None:  # nothing is routed: an empty ledger leg, and alert_totals counts the rows
        spend = spend.filter(F.lit(False))
    raw = F.when(is_tr, F.col("counterparty")).when(
        F.col("channel") != "", F.concat_ws("-", F.col("channel"), F.col("counterparty"))).otherwise(F.col("counterparty"))
    action = F.when(is_tr, F.lit(K.TRANSFER_ACTION)).otherwise(F.lit(K.EXPENSE_ACTION))
    channel, mkey = merchant_split(raw)
    ledger = spend.select(
        "source_msg_id", "card_last4", F.lit(card_type).cast("string").alias("card_type"),
        F.col("txn_time").try_cast("timestamp_ntz").alias("txn_time"),
        F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit("CNY").alias("currency"),
        action.alias("action"), F.lit("expense").alias("direction"),
        raw.alias("merchant_raw"), mkey.alias("merchant_key"), channel.alias("channel"),
        F.col("txn_time").alias("time_text"), *keep)
    ledger = ledger.withColumn(
        "fingerprint", fingerprint("card_last4", "txn_time", "amount", "merchant_raw", "action"))
    return deposits, ledger.drop("time_text")


def alert_totals(normalised: DataFrame, card_type: str | None = "debit") -> DataFrame:
    """(kind, n): income, expense and transfer_out records, or unrouted ones without a card type."""
    ok = normalised.filter(F.col("error").isNull())
    kind = F.when((F.col("type") != K.ALERT_INCOME) & F.lit(card_type is None), F.lit("unrouted")).otherwise(F.col("type"))
    return ok.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- routing ---------------------------------------------------------------------

# Configured email parsers in priority order (C1): which card type each feeds,
# what it outputs, and its match gate (C3). This is configuration, not data.
# A route may also carry ``match`` (a function returning a Column over the mail
# columns) and ``parse`` (a function DataFrame -> DataFrame of transactions):
# that is how a new bank's parser is plugged in.
DEFAULT_ROUTES = (
    {"card_type": "credit", "output": "transactions", "rule": "credit_daily", "name": "credit_daily"},
    {"card_type": "debit", "output": "ai_record", "rule": "debit_alert", "name": "debit_alert"},
)


def _route_match(rule: str) -> Column:
    s = F.lower(F.coalesce(F.col("sender"), F.lit("")))
    if rule == "credit_daily":
        return mail_type("sender", "subject") == K.CREDIT_DAILY
    if rule == "debit_alert":
        return (F.contains(s, F.lit(K.DEBIT_SENDER))
                & (F.trim(F.coalesce(F.col("subject"), F.lit(""))) == K.DEBIT_ALERT_SUBJECT))
    raise ValueError(f"unknown route rule {rule!r}")


def mail_route(mails: DataFrame, routes=DEFAULT_ROUTES, keep: list[str] | None = None) -> DataFrame:
    """First matching configured parser per mail (C1, C3, W7), with the columns in ``keep``.

    The configured routes compile into one ordered CASE expression, so the
    first match wins without a join or a window: a map-only projection.
    """
    card = out = name = None
    for r in routes:
        m = r["match"]() if callable(r.get("match")) else _route_match(r["rule"])
        nm = r.get("name", r.get("rule"))
        card = F.when(m, F.lit(r["card_type"])) if card is None else card.when(m, F.lit(r["card_type"]))
        out = F.when(m, F.lit(r["output"])) if out is None else out.when(m, F.lit(r["output"]))
        name = F.when(m, F.lit(nm)) if name is None else name.when(m, F.lit(nm))
    return mails.select("uid", "msg_id", mail_type("sender", "subject").alias("email_type"),
                        card.alias("parser_card_type"), out.alias("parser_output"), name.alias("parser_name"), *(keep or []))


def mail_outcomes(mails: DataFrame, ai_results: DataFrame, html_col: str = "html") -> DataFrame:
    """Routing, extraction and outcome of every mail in one pass (C1, C4, C5): uid, msg_id, email_type, status, error.

    For the built-in routes: the number of transactions is a property of the mail's own lines, so digests are neither
    set apart nor joined back, and nothing is exploded. ``ai_results`` as in :func:`mail_status`.
    """
    routed = mail_route(mails.select("uid", "msg_id", "sender", "subject", html_col), DEFAULT_ROUTES, keep=[html_col])
    digest = F.col("parser_output") == "transactions"
    m = fence(routed.withColumn("lines", F.when(digest, html_to_lines(F.col(html_col)))).drop(html_col))
    m = fence(m.withColumn("kinds", line_kinds(F.col("lines"))))
    idx, kinds, lines = _indices(F.col("kinds")), F.col("kinds"), F.col("lines")
    date_line = F.element_at(lines, _first_index_or_null(idx, lambda i: _kind(kinds, i, DATE)) + 1)
    date = F.concat_ws("-", *[F.regexp_extract(date_line, K.RE_DATE, g) for g in (1, 2, 3)])
    m = fence(m.withColumns({"date": F.when(date_line.isNotNull(), date), "cands": candidates(kinds)}).drop("kinds"))
    valid = lambda x: F.concat_ws(" ", "date", F.regexp_extract(F.element_at(lines, x["i"] + 1), K.RE_TIME, 1)).try_cast("timestamp_ntz").isNotNull()
    n = F.when(F.col("date").isNotNull(), F.size(F.filter(accepted(F.col("cands")), valid)))
    counted = m.withColumn("n", n.cast("bigint")).drop("lines", "date", "cands")
    return _outcome(counted.join(ai_results, "uid", "left"))


def mail_status(routed: DataFrame, txn_counts: DataFrame, ai_results: DataFrame) -> DataFrame:
    """Outcome per mail (C5, Q12): parsed / error / skipped.

    ``txn_counts`` (uid, n) are digest rows per mail; ``ai_results`` (uid, kept)
    says whether the alert produced a record. A digest with zero rows is an
    error; a mail no parser claims is skipped.
    """
    return _outcome(routed.join(txn_counts, "uid", "left").join(ai_results, "uid", "left"))


def _outcome(j: DataFrame) -> DataFrame:
    out = F.col("parser_output")
    status = (F.when(out.isNull(), F.lit("skipped"))
              .when(out == "transactions", F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, "parsed").otherwise("error"))
              .otherwise(F.when(F.coalesce(F.col("kept"), F.lit(False)), "parsed").otherwise("skipped")))
    err = F.when((out == "transactions") & (F.coalesce(F.col("n"), F.lit(0)) == 0),
                 F.lit("digest yielded 0 transactions"))
    return j.select("uid", "msg_id", "email_type", status.alias("status"), err.alias("error"))
