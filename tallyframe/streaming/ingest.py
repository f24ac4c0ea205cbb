"""Streaming ingest (R1-R9): raw mails -> ledger rows and deposits, per micro-batch.

The polled mailbox becomes a stream of raw mails: files dropped into a folder, or the UID source of
:mod:`tallyframe.streaming.mailbox`. Progress (the reference's UID watermark) is the stream's source offsets in the
checkpoint, so a restart resumes after the last committed batch. Repeated deliveries may be taken out ahead of the
batches (:mod:`tallyframe.streaming.dedup`). Each micro-batch runs the batch operators inside ``foreachBatch``:

1. mail-level dedup against the processing log (A6), with the mails that an
   earlier batch could not interpret taken in again,
2. routing (C1); digest extraction (C4), and alert interpretation by the caller's
   model, normalisation and routing (C6) to the ledger or to deposits,
3. insert-or-ignore on fingerprint (A8) and on message id (A9),
4. refund pairing (J1/R5, sticky): the batch's rows meet the open rows of their card, merchant and amount,
5. totals of the run (A13), observed in the writes above,
6. if asked for: category suggestions by the caller's classifier (G11), and the
   notifier. A failure of these two is logged and never stops the ingest (R7). Each can also run as a query of its
   own over the ingest's state, with its own checkpoint (:func:`start_suggest`, :func:`start_notify`).

Outputs go to per-batch folders ``.../batch=<id>/part=<hash prefix>`` (:mod:`tallyframe.streaming.state`): a batch
reads only the parts that its keys touch. A replayed batch (executor or driver loss between write and commit) reads
only earlier batches and overwrites exactly its own folder, so the sink is idempotent without coordination (R3, R8).

State layout under ``state_dir``: ``mail_log/``, ``retry/`` (mails still to be
interpreted), ``rows/`` (ledger rows as inserted), ``deposits/``, ``open/`` (rows that may still pair), ``links/``
(pair edges), ``decisions/`` (suggested categories), ``notified/``, ``totals/``.
:func:`current_ledger` folds them into the ledger a report reads;
:func:`compact_state` folds the folders of many batches into one. Nothing here
reads a machine-local path: the folders are whatever shared storage the caller
passes. Only a folder that does not exist counts as empty state; any other
failure to read stops the batch.
"""
from __future__ import annotations

import logging
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..fixtures import LEDGER_COLUMNS
from ..operators import advice, extract, matching
from ..operators.classify import classification_batches, interpret_alerts, run_classifier
from ..functions.text import html_flat_text
from ..sources.ingest import deposit_insert_ignore
from ..sources.mail import MAIL_SCHEMA, first_per_key
from .dedup import first_deliveries
from .state import ROWS_PER_PART, read_state as _read_or_empty, rewrite, touched_parts, write_state

LEDGER_DDL = (
    "id bigint, fingerprint string, source_msg_id string, card_last4 string, card_type string, "
    "txn_time timestamp_ntz, amount decimal(18,2), currency string, direction string, action string, "
    "merchant_raw string, merchant_key string, channel string, balance decimal(18,2), "
    "avail_credit decimal(18,2), points bigint, category string, category_src string, status string, "
    "notify_status string, notified_at timestamp_ntz, voided boolean, offset_of bigint, "
    "effective_month string, merged_into bigint, note string")
LOG_DDL = "msg_id string, uid bigint, email_type string, status string"
LINK_DDL = "id bigint, pair_id bigint"
SENT_DDL = "id bigint, notified_at timestamp_ntz"
DEPOSIT_DDL = ("id bigint, source_msg_id string, card_last4 string, txn_time timestamp_ntz, amount decimal(18,2), "
               "kind string, payer string, note string, raw_text string")
MAIL_DDL = "uid bigint, msg_id string, received timestamp_ntz, sender string, subject string, html string, text string"
DECISION_DDL = "id bigint, category string, category_src string, status string"
OPEN_DDL = "id bigint, card_last4 string, merchant_key string, amount decimal(18,2), txn_time timestamp_ntz, direction string"
TOTAL_DDL = "total string, n bigint"
PAIR_KEY = ("card_last4", "merchant_key", "cents")
#: Tables with the key that decides a row's part.
STATE = {"mail_log": (LOG_DDL, ["msg_id"]), "rows": (LEDGER_DDL, ["fingerprint"]), "deposits": (DEPOSIT_DDL, ["source_msg_id"]),
         "decisions": (DECISION_DDL, ["id"]), "notified": (SENT_DDL, ["id"])}
STATUSES = ("parsed", "skipped", "error")
_log = logging.getLogger(__name__)


def _cents() -> Column:
    return (F.abs(F.col("amount")) * 100).cast("bigint")


def current_ledger(spark: SparkSession, state_dir: str, rows_upto: int | None = None,
                   links_upto: int | None = None, marks_upto: int | None = None,
                   decisions_upto: int | None = None) -> DataFrame:
    """Ledger = inserted rows with pair links, the latest suggested categories and notification marks."""
    rows = _read_or_empty(spark, f"{state_dir}/rows", LEDGER_DDL, rows_upto)
    links = _read_or_empty(spark, f"{state_dir}/links", LINK_DDL, links_upto)
    links = links.groupBy("id").agg(F.max("pair_id").alias("_pair"))
    sent = _read_or_empty(spark, f"{state_dir}/notified", SENT_DDL, marks_upto).groupBy("id").agg(
        F.min("notified_at").alias("_sent_at"))
    told = _read_or_empty(spark, f"{state_dir}/decisions", DECISION_DDL, decisions_upto, with_batch=True)
    told = told.groupBy("id").agg(F.max_by(F.struct("category", "category_src", "status"), "batch").alias("_told"))
    j = rows.join(links, "id", "left").join(sent, "id", "left").join(told, "id", "left")
    was = F.col("_told").isNotNull()
    return (j.withColumn("voided", F.col("voided") | F.col("_pair").isNotNull())
            .withColumn("offset_of", F.coalesce(F.col("_pair"), F.col("offset_of")))
            .withColumns({c: F.when(was, F.col(f"_told.{c}")).otherwise(F.col(c)) for c in ("category", "category_src", "status")})
            .withColumn("notify_status", F.when(F.col("_sent_at").isNotNull(), F.lit("sent"))
                        .otherwise(F.col("notify_status")))
            .withColumn("notified_at", F.coalesce(F.col("_sent_at"), F.col("notified_at")))
            .select(*LEDGER_COLUMNS))


def current_deposits(spark: SparkSession, state_dir: str) -> DataFrame:
    return _read_or_empty(spark, f"{state_dir}/deposits", DEPOSIT_DDL)


def compact_state(spark: SparkSession, state_dir: str, new_dir: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Fold the folders of all batches into one per table, in a new state folder.

    The one folder carries the last batch's id, so the state that later batches
    see is the same; its parts are as many as keep to ``rows_per_part`` rows. Rows that have found a partner leave
    the open ones, and the batches' totals become one. Run it between batches and go on with ``new_dir``; the old
    folder stays as it is, so a failure here loses nothing.
    """
    last = _read_or_empty(spark, f"{state_dir}/mail_log", LOG_DDL, with_batch=True).agg(F.max("batch")).first()[0]
    if last is None:
        return
    for table, (ddl, keys) in STATE.items():
        df = _read_or_empty(spark, f"{state_dir}/{table}", ddl, with_batch=True)
        if table == "decisions":
            df = df.groupBy("id").agg(F.max_by(F.struct("category", "category_src", "status"), "batch").alias("x")).select("id", "x.*")
        elif table == "notified":
            df = df.groupBy("id").agg(F.min("notified_at").alias("notified_at"))
        rewrite(df, f"{new_dir}/{table}", ddl, last, keys, rows_per_part)
    waiting = _read_or_empty(spark, f"{state_dir}/retry", MAIL_DDL, since=last)
    rewrite(waiting, f"{new_dir}/retry", MAIL_DDL, last, ["msg_id"], rows_per_part)
    links = _read_or_empty(spark, f"{state_dir}/links", LINK_DDL)
    opened = _read_or_empty(spark, f"{state_dir}/open", OPEN_DDL).join(links.select("id"), "id", "left_anti")
    rewrite(opened.withColumn("cents", _cents()), f"{new_dir}/open", OPEN_DDL, last, PAIR_KEY, rows_per_part)
    # links of rows that are not open any more are read by the ledger only: by id
    rewrite(links, f"{new_dir}/links", LINK_DDL, last, ["id"], rows_per_part)
    totals = _read_or_empty(spark, f"{state_dir}/totals", TOTAL_DDL).groupBy("total").agg(F.sum("n").alias("n"))
    rewrite(totals, f"{new_dir}/totals", TOTAL_DDL, last, ["total"], rows_per_part)


def _ledger_rows(txns: DataFrame) -> DataFrame:
    """Extracted transactions -> ledger rows (new rows: pending, no category)."""
    base = {c: F.lit(None) for c in LEDGER_COLUMNS}
    base.update({
        "id": F.xxhash64("fingerprint"), "status": F.lit("pending"), "voided": F.lit(False),
        "balance": F.lit(None).cast("decimal(18,2)"),
    })
    types = dict(x.split(" ", 1) for x in LEDGER_DDL.split(", "))
    return txns.select(*[(F.col(c) if c in txns.columns and c not in ("id", "status", "voided")
                          else base[c]).cast(types[c]).alias(c) for c in LEDGER_COLUMNS])


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, state_dir: str,
                  routes=extract.DEFAULT_ROUTES, interpret=None) -> None:
    """One micro-batch of the ingest (callable from ``foreachBatch`` or directly).

    Mails routed to a transaction parser go through that route's ``parse``
    function (the built-in digest parser by default). Alert mails go through
    ``interpret`` (see :func:`classify.interpret_alerts`); without it, or when a
    reply cannot be used, they stay out of the log and wait for the next batch.
    """
    columns = [c.name for c in MAIL_SCHEMA]
    # the last batch's waiting mails are all that still wait
    waiting = _read_or_empty(spark, f"{state_dir}/retry", MAIL_DDL, batch_id, since=batch_id - 1).select(*columns)
    delivered = batch.select(*columns).unionByName(waiting).persist()
    log = _read_or_empty(spark, f"{state_dir}/mail_log", LOG_DDL, batch_id, touched=touched_parts(delivered, ["msg_id"]))
    known = log.select("msg_id").distinct()
    already_seen = delivered.join(known, "msg_id", "left_semi").count()
    mails = first_per_key(delivered.join(known, "msg_id", "left_anti"), "msg_id", [F.col("uid")])
    # what is known of a mail goes along with it through the parsers; nothing is joined back
    mails = extract.mail_route(mails, routes, keep=[c for c in columns if c not in ("uid", "msg_id")]).persist()
    body = mails.filter("uid IS NOT NULL AND msg_id IS NOT NULL").withColumnsRenamed({"msg_id": "source_msg_id"})
    parsed = []
    for r in routes:
        if r["output"] != "transactions":
            continue
        mine = body.filter(F.col("parser_name") == r.get("name", r.get("rule"))).withColumn("arrival", F.col("uid"))
        if r.get("parse"):
            rows = r["parse"](mine.select("source_msg_id", "html", "text", "uid"))
            parsed.append(rows.join(mine.select("source_msg_id", "arrival"), "source_msg_id"))
        else:
            parsed.append(extract.digest_extract(mine, keep=["arrival"]))
    beside = ["raw_text", "parser_card_type", "arrival"]
    alerts = body.filter("parser_output = 'ai_record'").select(
        "source_msg_id", "received", "parser_card_type", F.col("uid").alias("arrival"), html_flat_text("text", "html").alias("raw_text"))
    if interpret is None:
        replies = alerts.select("source_msg_id", "received", F.lit(None).cast("string").alias("reply"), *beside)
    else:
        replies = interpret_alerts(alerts.withColumn("text", F.col("raw_text")), interpret, keep=beside)
    normalised = extract.alert_normalise(replies, keep=beside[1:])
    # only a deposit keeps its text
    normalised = normalised.withColumn("raw_text", F.when(F.col("type") == K.ALERT_INCOME, F.col("raw_text"))).persist()
    kept = normalised.filter(F.col("error").isNull())
    deposits = None
    for card_type in sorted({r["card_type"] for r in routes if r["output"] == "ai_record"}, key=str):
        dep, led = extract.alert_route(kept.filter(F.col("parser_card_type").eqNullSafe(F.lit(card_type))), card_type, keep=["arrival"])
        parsed.append(led)
        deposits = dep if deposits is None else deposits.unionByName(dep)
    txns = parsed[0]
    for p in parsed[1:]:
        txns = txns.unionByName(p, allowMissingColumns=True)
    txns = txns.persist()
    # insert-or-ignore on fingerprint: first arrival in the batch, then drop fingerprints already stored
    rows = _read_or_empty(spark, f"{state_dir}/rows", LEDGER_DDL, batch_id, touched=touched_parts(txns, ["fingerprint"]))
    new = first_per_key(txns, "fingerprint", [F.col("arrival")]).join(
        rows.select("fingerprint"), "fingerprint", "left_anti")
    seen_rows, seen_deposits, seen_mails, seen_waiting = (Observation() for _ in range(4))
    write_state(_ledger_rows(new.drop("arrival")), f"{state_dir}/rows", LEDGER_DDL, batch_id, ["fingerprint"], observed=(
        seen_rows, [F.count(F.lit(1)).alias("inserted"), F.count_if(F.col("status") == "pending").alias("pending")]))
    if deposits is not None:
        stored = _read_or_empty(spark, f"{state_dir}/deposits", DEPOSIT_DDL, batch_id,
                                touched=touched_parts(deposits, ["source_msg_id"]))
        fresh = deposit_insert_ignore(stored, deposits).withColumn("id", F.xxhash64("source_msg_id"))
        write_state(fresh, f"{state_dir}/deposits", DEPOSIT_DDL, batch_id, ["source_msg_id"],
                    observed=(seen_deposits, [F.count(F.lit(1)).alias("income")]))

    counts = txns.groupBy(F.col("source_msg_id").alias("msg_id")).agg(F.count(F.lit(1)).alias("n"))
    used = normalised.select(F.col("source_msg_id").alias("msg_id"), F.col("error").isNull().alias("kept"), F.col("type").alias("alert_type"))
    target, failed = F.col("parser_output"), F.col("kept").isNotNull() & ~F.col("kept")
    status = (mails.join(used, "msg_id", "left").filter(~failed).join(counts, "msg_id", "left")
              .select("msg_id", "uid", "email_type", "n", "alert_type", "parser_card_type",
                      F.when(target.isNull(), "skipped")
                      .when(target == "ai_record", F.when(F.col("kept"), "parsed").otherwise("skipped"))
                      .when(F.coalesce(F.col("n"), F.lit(0)) > 0, "parsed").otherwise("error").alias("status")))
    unrouted = F.col("parser_card_type").isNull() & (F.col("alert_type") != K.ALERT_INCOME)
    write_state(status, f"{state_dir}/mail_log", LOG_DDL, batch_id, ["msg_id"], observed=(seen_mails, [
        F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"), F.count_if(unrouted).alias("unrouted"),
        *[F.count_if((F.col("email_type") == t) & (F.col("status") == s)).alias(f"{t}:{s}") for t in K.MAIL_TYPES for s in STATUSES]]))
    write_state(mails.join(used.filter(failed), "msg_id", "left_semi"), f"{state_dir}/retry", MAIL_DDL, batch_id, ["msg_id"],
                observed=(seen_waiting, [F.count(F.lit(1)).alias("waiting")]))
    _pair_batch(spark, state_dir, batch_id)

    totals = {**seen_rows.get, **(seen_deposits.get if deposits is not None else {}), **seen_mails.get, **seen_waiting.get,
              "already_seen": already_seen}
    totals["dup"] = totals.pop("transactions") - totals["inserted"]
    write_state(spark.createDataFrame([(k, int(n)) for k, n in sorted(totals.items())], TOTAL_DDL), f"{state_dir}/totals",
                TOTAL_DDL, batch_id, ["total"])
    for df in (txns, normalised, mails, delivered):
        df.unpersist()


def _pair_batch(spark: SparkSession, state_dir: str, batch_id: int) -> None:
    """Pair the batch's rows, as written, with the open rows of their card, merchant and amount (sticky)."""
    written = _read_or_empty(spark, f"{state_dir}/rows", LEDGER_DDL, batch_id + 1, since=batch_id)
    mine = written.filter(matching._pair_candidate()).withColumn("cents", _cents())
    write_state(mine, f"{state_dir}/open", OPEN_DDL, batch_id, PAIR_KEY)
    touched = touched_parts(mine, PAIR_KEY)
    opened = _read_or_empty(spark, f"{state_dir}/open", OPEN_DDL, batch_id + 1, touched=touched).withColumn("cents", _cents())
    closed = _read_or_empty(spark, f"{state_dir}/links", LINK_DDL, batch_id, touched=touched)
    opened = opened.join(mine.select(*PAIR_KEY).distinct(), list(PAIR_KEY), "left_semi").join(closed.select("id"), "id", "left_anti")
    pairs = matching.refund_pairs(opened.withColumn("voided", F.lit(False)))
    sides = F.explode(F.array(F.struct(F.col("refund_id").alias("id"), F.col("expense_id").alias("pair_id")),
                              F.struct(F.col("expense_id").alias("id"), F.col("refund_id").alias("pair_id"))))
    links = pairs.select("card_last4", "merchant_key", F.round(F.col("amount") * 100).cast("bigint").alias("cents"), sides.alias("x"))
    write_state(links.select(*PAIR_KEY, "x.*"), f"{state_dir}/links", LINK_DDL, batch_id, PAIR_KEY)


def run_totals(spark: SparkSession, state_dir: str, batch_id: int | None = None) -> DataFrame:
    """Totals (A13) of one batch, or of all: (total, n) with inserted, dup, pending, income, unrouted, already_seen,
    waiting and each 'type:status'; totals of nothing are left out. They were observed in the batches' own writes."""
    t = _read_or_empty(spark, f"{state_dir}/totals", TOTAL_DDL, None if batch_id is None else batch_id + 1, batch_id, with_batch=True)
    last = t.agg(F.max("batch")).first()[0] if batch_id is None else batch_id
    # mails that wait, wait on: only the last batch's count stands
    t = t.filter((F.col("total") != "waiting") | (F.col("batch") == F.lit(last)))
    return t.groupBy("total").agg(F.sum("n").alias("n")).filter("n > 0")


def suggest_step(spark: SparkSession, state_dir: str, batch_id: int, classifier, categories: DataFrame,
                 include_suggested: bool = False, whole: bool = False) -> None:
    """Suggest stage (G11, R9): the caller's classifier over open merchants; changed rows go to ``decisions``.

    ``batch_id`` is the ingest's, up to which its rows count, or with ``whole`` this stage's own, and all rows count.
    """
    if whole:
        led = current_ledger(spark, state_dir, decisions_upto=batch_id)
    else:
        led = current_ledger(spark, state_dir, rows_upto=batch_id + 1, links_upto=batch_id, decisions_upto=batch_id)
    batches = classification_batches(led, include_suggested=include_suggested).persist()
    told = run_classifier(led, batches, classifier)
    after, _ = advice.classify_apply(led, batches, told, categories)
    was = led.select("id", F.col("category").alias("_c"), F.col("status").alias("_s"))
    changed = after.join(was, "id").filter(~F.col("category").eqNullSafe(F.col("_c")) | (F.col("status") != F.col("_s")))
    write_state(changed, f"{state_dir}/decisions", DECISION_DDL, batch_id, ["id"])
    batches.unpersist()


def notify_step(spark: SparkSession, state_dir: str, batch_id: int, send, now: str,
                suggestions: DataFrame | None = None) -> bool:
    """Notifier stage (A15, D14, G16, R7, R8): build the digest of un-notified live
    rows, hand it to ``send`` (the caller's delivery function, DataFrame of lines
    -> bool), and only after a successful send record the sent ids under
    ``notified/batch=<id>``. A failed send records nothing (at-least-once).

    The queue is derived from the marks of earlier batches only, so a retry of
    one ``batch_id`` sends and marks the same rows. An empty queue is not sent.
    """
    from ..operators.notify import notify_digest, notify_queue
    led = current_ledger(spark, state_dir, marks_upto=batch_id)
    sug = suggestions if suggestions is not None else spark.createDataFrame(
        [], "transaction_id bigint, operation string, related_transaction_ids string, reason string")
    queue = notify_queue(led, sug).persist()
    try:
        if queue.isEmpty():
            return True
        try:
            ok = bool(send(notify_digest(queue)))
        except Exception:  # noqa: BLE001 - delivery is the caller's; it is tried again next cycle
            _log.exception("sending the digest failed")
            ok = False
        if ok:
            sent = queue.select("id", F.lit(now).cast("timestamp_ntz").alias("notified_at"))
            write_state(sent, f"{state_dir}/notified", SENT_DDL, batch_id, ["id"])
        return ok
    finally:
        queue.unpersist()


def start_ingest(spark: SparkSession, mails: str | DataFrame, state_dir: str, checkpoint_dir: str,
                 trigger: dict | None = None, max_files_per_trigger: int | None = None,
                 routes=extract.DEFAULT_ROUTES, interpret=None, classifier=None, categories: DataFrame | None = None,
                 send=None, now=None, dedup_within: str | None = None):
    """Start the streaming ingest; ``trigger`` defaults to a 90-second processing-time poll.

    ``mails``: a folder into which files of raw mails are dropped, or any stream of raw mails. ``dedup_within`` takes
    repeated deliveries within that time out of the stream before it reaches the batches.

    ``interpret``, ``classifier`` (with ``categories``) and ``send`` are the caller's
    alert interpreter, classifier and delivery; ``now`` gives the time of a
    notification as text. Suggesting and notifying are guarded each: their failure
    is logged and the ingest goes on.
    """
    def guarded(name, step, *args):
        try:
            step(*args)
        except Exception:  # noqa: BLE001 - R7: the stages after the ingest must not stop it
            _log.exception("%s failed", name)

    def cycle(df: DataFrame, batch_id: int) -> None:
        process_batch(spark, df, batch_id, state_dir, routes, interpret)
        if classifier is not None:
            guarded("suggest", suggest_step, spark, state_dir, batch_id, classifier, categories)
        if send is not None:
            guarded("notify", notify_step, spark, state_dir, batch_id, send, _time_of(spark, now))

    stream = mails
    if isinstance(mails, str):
        reader = spark.readStream.schema(MAIL_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        stream = reader.parquet(mails)
    if dedup_within:
        stream = first_deliveries(stream, dedup_within)
    return _each_batch(stream, cycle, checkpoint_dir, trigger)


def _time_of(spark: SparkSession, now) -> str:
    return now() if now else spark.sql("SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')").first()[0]


def _each_batch(stream: DataFrame, step, checkpoint_dir: str, trigger: dict | None):
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir)
    return w.trigger(**(trigger or {"processingTime": "90 seconds"})).start()


def _new_rows(spark: SparkSession, state_dir: str) -> DataFrame:
    """The rows that the ingest writes, as a stream; its folder is made if there is none yet."""
    empty = spark.createDataFrame([], LEDGER_DDL)
    empty.write.mode("ignore").parquet(f"{state_dir}/rows/batch=-1/part=0")
    return spark.readStream.schema(f"{LEDGER_DDL}, batch bigint, part string").parquet(f"{state_dir}/rows")


def start_suggest(spark: SparkSession, state_dir: str, checkpoint_dir: str, classifier, categories: DataFrame,
                  trigger: dict | None = None, include_suggested: bool = False):
    """Suggesting as a query of its own (R7): whenever the ingest has written rows, the caller's classifier sees the
    open merchants, and what it decides goes to ``decisions/``. It has its own progress: a failure ends this query
    alone, and its restart takes up the rows that it has not finished."""
    def step(rows: DataFrame, batch_id: int) -> None:
        if not rows.isEmpty():
            suggest_step(spark, state_dir, batch_id, classifier, categories, include_suggested, whole=True)

    return _each_batch(_new_rows(spark, state_dir), step, checkpoint_dir, trigger)


def start_notify(spark: SparkSession, state_dir: str, checkpoint_dir: str, send, now=None, trigger: dict | None = None,
                 suggestions: DataFrame | None = None):
    """Notifying as a query of its own (R7, R8): whenever the ingest has written rows, what was not sent yet is sent
    and then marked. A delivery that fails ends this query alone; its restart sends the same rows again."""
    def step(rows: DataFrame, batch_id: int) -> None:
        if not rows.isEmpty() and not notify_step(spark, state_dir, batch_id, send, _time_of(spark, now), suggestions):
            raise RuntimeError("the digest was not delivered")

    return _each_batch(_new_rows(spark, state_dir), step, checkpoint_dir, trigger)


def streaming_spend_matrix(ledger_stream: DataFrame, start_day: int = 1) -> DataFrame:
    """Month x category spend over a stream of ledger rows (update mode).

    The billing period is a shifted calendar bucket, not an event-time window,
    so this is a plain streaming aggregation; its state is one row per cell.
    """
    from ..operators.reports import monthly_matrix
    return monthly_matrix(ledger_stream, start_day, ordered=False)

