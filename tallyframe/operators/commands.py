"""Bulk ledger commands.

The reference edits one row per click. Here a command table is applied to a
ledger snapshot in one job, giving a new snapshot plus per-request results.
Every command kind reduces to: aggregate the commands per target row (partial
aggregation, last writer by ``seq`` wins via ``max_by``), then one equi-join of
the ledger with that per-row table on ``id``. Both sides are keyed by the
unique row id, so the join has no hot keys.

Requests that touch the same row must see each other's effects in ``seq``
order. :func:`apply_command_table` applies a mixed table: field edits collapse
to one update per row, and only splits, merges and what stands between them are
taken one after the other, component by component of the requests that share
rows; the ledger is read and joined once.

Rows made by a command get an id that is a hash of the request and the position
(:func:`child_id`, :func:`merged_row_id`), so any number of parts and any ids of
the originals are fine, and a later command can name a row before it exists.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.periods import billing_period
from ..session import ensure_checkpoint_dir
from .command_fold import STEP, folded


def _hash_id(kind: str, *parts: Column) -> Column:
    """A 60-bit id from a hash of the parts."""
    text = F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def child_id(request_id: Column, pos: Column) -> Column:
    """Id of the part at ``pos`` (from 0) that a split request makes."""
    return _hash_id("split", request_id, pos)


def merged_row_id(request_id: Column) -> Column:
    """Id of the row that a merge request makes."""
    return _hash_id("merge", request_id)


# ---- G5 / G6: field edits ----------------------------------------------------------

def apply_edits(ledger: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply void/restore/set_category/set_note/confirm commands.

    ``commands``: (txn_id, seq, op, payload). Per row and field the last command
    by ``seq`` wins. set_category also sets category_src='manual' and
    status='confirmed'; confirm only sets the status. Restore leaves links
    untouched (Q6).
    """
    c = commands
    op = F.col("op")

    def last(cond: Column, value: Column):
        return F.max_by(F.when(cond, value), F.when(cond, F.col("seq")))

    per_row = c.groupBy(F.col("txn_id").alias("id")).agg(
        last(op.isin("void", "restore"), op == "void").alias("_voided"),
        last(op == "set_category", F.col("payload")).alias("_category"),
        last(op == "set_note", F.col("payload")).alias("_note"),
        F.max(op.isin("set_category", "confirm")).alias("_confirm"),
        F.max(op == "set_category").alias("_manual"),
    )
    j = ledger.join(per_row, "id", "left")
    out = (j.withColumn("voided", F.coalesce(F.col("_voided"), F.col("voided")))
           .withColumn("category", F.when(F.col("_category").isNotNull(), F.col("_category"))
                       .otherwise(F.col("category")))
           .withColumn("category_src", F.when(F.coalesce(F.col("_manual"), F.lit(False)),
                                              F.lit(K.CATEGORY_SRC_MANUAL)).otherwise(F.col("category_src")))
           .withColumn("status", F.when(F.coalesce(F.col("_confirm"), F.lit(False)), F.lit("confirmed"))
                       .otherwise(F.col("status")))
           .withColumn("note", F.when(F.col("_note").isNotNull(), F.col("_note")).otherwise(F.col("note"))))
    return out.select(*ledger.columns)


# ---- G14: pre-checks ---------------------------------------------------------------

def command_validate(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """Static checks on operation requests.

    ``requests``: (request_id, operation, ids array<bigint>, amounts array<decimal>,
    category). merge/offset need >= 2 ids, void and split exactly one, split
    >= 2 amounts; a given category must be an active one.
    """
    active = categories.filter(F.col("active") == 1).select(F.col("name").alias("category"),
                                                           F.lit(True).alias("_known"))
    r = requests.join(active, "category", "left")
    op = F.col("operation")
    n_ids = F.coalesce(F.size("ids"), F.lit(0))
    n_amt = F.coalesce(F.size("amounts"), F.lit(0))
    err = (F.when(op.isin("merge", "offset") & (n_ids < 2), F.lit("need at least two transactions"))
           .when((op == "void") & (n_ids != 1), F.lit("void takes exactly one transaction"))
           .when((op == "split") & (n_ids != 1), F.lit("split takes exactly one transaction"))
           .when((op == "split") & (n_amt < 2), F.lit("split needs at least two amounts"))
           .when(~op.isin("merge", "offset", "void", "split"), F.lit("unsupported operation"))
           .when(F.col("category").isNotNull() & F.col("_known").isNull(), F.lit("unknown category")))
    return r.select("request_id", "operation", err.isNull().alias("ok"), err.alias("error"))


# ---- G2: split ---------------------------------------------------------------------

def split_apply(ledger: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split parents into children.

    ``splits``: (request_id, txn_id, amounts array<decimal(18,2)>). A request is
    valid when the parent exists and is live, has >= 2 parts, and the parts sum
    to the parent amount within 0.01 (zero or negative parts pass, as in the
    reference). Returns (results, children, new ledger): children inherit card,
    time, currency, direction, action, merchant, channel and source, get
    fingerprint '<parent>#s<i>', status pending and a note; the parent is voided
    with a note suffix. Child ids are hashes of the request and the position.
    Of several valid requests for one parent the first by ``seq`` (if the table
    has it, then by request id) wins; the others find the parent voided.
    """
    parts = splits.withColumn("amounts", F.transform("amounts", lambda a: F.round(a, 2).cast("decimal(18,2)")))
    p = ledger.select(F.col("id").alias("txn_id"), "voided", F.col("amount").alias("parent_amount"))
    r = parts.join(p, "txn_id", "left")
    total = F.aggregate("amounts", F.lit(0).cast("decimal(20,2)"), lambda acc, x: (acc + x).cast("decimal(20,2)"))
    err = (F.when(F.col("parent_amount").isNull(), F.lit("not found"))
           .when(F.col("voided"), F.lit("voided"))
           .when(F.size("amounts") < 2, F.lit("need at least two parts"))
           .when(F.abs(total - F.round(F.col("parent_amount"), 2)) > F.lit(0.01), F.lit("parts do not sum")))
    turn = F.struct(*[F.col(c) for c in ("seq", "request_id") if c in splits.columns])
    r = r.withColumn("_err", err).withColumn("_turn", turn)
    first = Window.partitionBy("txn_id", F.col("_err").isNull())
    late = F.col("_err").isNull() & (F.min("_turn").over(first) < F.col("_turn"))
    r = r.withColumn("_err", F.when(late, F.lit("voided")).otherwise(F.col("_err")))
    results = r.select("request_id", "txn_id", F.col("_err").isNull().alias("ok"), F.col("_err").alias("error"),
                       F.size("amounts").alias("parts"))
    good = results.filter("ok").join(parts.select("request_id", "amounts"), "request_id")
    kids = (good.select("request_id", "txn_id", F.posexplode("amounts").alias("pos", "part"))
            .join(ledger.withColumnRenamed("id", "txn_id"), "txn_id"))
    children = kids.select(
        child_id(F.col("request_id"), F.col("pos")).alias("id"),
        F.concat(F.col("fingerprint"), F.lit("#s"), F.col("pos").cast("string")).alias("fingerprint"),
        "source_msg_id", "card_last4", "card_type", "txn_time", F.col("part").alias("amount"), "currency",
        "direction", "action", "merchant_raw", "merchant_key", "channel",
        F.lit(None).cast("decimal(18,2)").alias("balance"), F.lit(None).cast("decimal(18,2)").alias("avail_credit"),
        F.lit(None).cast("bigint").alias("points"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("category_src"), F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("notify_status"), F.lit(None).cast("timestamp_ntz").alias("notified_at"),
        F.lit(False).alias("voided"), F.lit(None).cast("bigint").alias("offset_of"),
        F.lit(None).cast("string").alias("effective_month"), F.lit(None).cast("bigint").alias("merged_into"),
        F.concat(F.lit(K.NOTE_SPLIT_FROM), F.col("txn_id").cast("string")).alias("note"))
    parents = good.select(F.col("txn_id").alias("id"), F.lit(True).alias("_split"))
    upd = ledger.join(parents, "id", "left")
    upd = (upd.withColumn("voided", F.col("voided") | F.coalesce(F.col("_split"), F.lit(False)))
           .withColumn("note", F.when(F.col("_split"), F.concat(F.coalesce(F.col("note"), F.lit("")),
                                                               F.lit(K.NOTE_SPLIT))).otherwise(F.col("note")))
           .select(*ledger.columns))
    return results, children.select(*ledger.columns), upd.unionByName(children.select(*ledger.columns))


# ---- G3 / G4: merge ----------------------------------------------------------------

def merge_apply(ledger: DataFrame, merge_ids: DataFrame, merges: DataFrame, start_day: int = 1):
    """Merge requests.

    ``merge_ids``: (request_id, pos, id), one row per listed id, in long form so
    no request is ever gathered into one value; ``merges``: (request_id,
    category, note, month, expected_operation). Only live ids count (duplicates kept); fewer than two
    is an error. net = round(sum, 2). An expected offset with |net| >= 0.01 is
    rejected; |net| < 0.01 voids all rows; otherwise one new row takes the
    earliest original's fields (ties by position), the net amount, direction
    by sign, the given month or the earliest billing period, and status
    confirmed iff a category is given; the originals are voided and point at it.

    Requests are taken in order of ``seq`` (if ``merges`` has it, then of request id): a row that an earlier one has
    voided is no longer live for a later one, so no money is counted twice. Requests that share no rows, the usual
    case, are independent and need no order; only where some do, those of their components are taken one by one.

    Returns (results, new_rows, new_ledger).
    """
    ex = merge_ids.select("request_id", "pos", "id")
    shared = ex.groupBy("id").agg(F.count_distinct("request_id").alias("n")).filter("n > 1")
    if not shared.isEmpty():
        return _merge_in_order(ledger, ex, merges, start_day)
    live = ledger.filter(~F.col("voided"))
    rows = ex.join(live, "id")
    agg = rows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("amount"), 2).alias("net"),
        F.min_by(F.struct("id", "source_msg_id", "card_last4", "card_type", "txn_time", "currency",
                          "merchant_raw", "merchant_key", "channel"),
                 F.struct("txn_time", "pos")).alias("first"),
        F.min(billing_period("txn_time", start_day)).alias("first_period"))
    r = merges.join(agg, "request_id", "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    err = (F.when(F.col("n") < 2, F.lit("need at least two live transactions"))
           .when((F.col("expected_operation") == "offset") & (F.abs(F.col("net")) >= F.lit(0.01)),
                 F.lit("net is not zero: cannot offset")))
    is_offset = err.isNull() & (F.abs(F.col("net")) < F.lit(0.01))
    merged_id = merged_row_id(F.col("request_id"))
    results = r.select(
        "request_id", err.isNull().alias("ok"), err.alias("error"), is_offset.alias("offset"),
        F.when(err.isNull() & ~is_offset, merged_id).alias("merged_id"),
        F.when(err.isNull(), F.col("net")).cast("double").alias("net"),
        F.when(err.isNull() & ~is_offset, F.coalesce(F.col("month"), F.col("first_period"))).alias("month"),
        F.col("n").cast("bigint").alias("count"))
    ok = r.filter(err.isNull())
    new_rows = ok.filter(~is_offset).select(
        merged_id.alias("id"),
        F.concat(F.lit("merge:"), F.col("request_id").cast("string")).alias("fingerprint"),
        F.col("first.source_msg_id").alias("source_msg_id"), F.col("first.card_last4").alias("card_last4"),
        F.col("first.card_type").alias("card_type"), F.col("first.txn_time").alias("txn_time"),
        F.col("net").cast("decimal(18,2)").alias("amount"), F.col("first.currency").alias("currency"),
        F.when(F.col("net") < 0, F.lit("refund")).otherwise(F.lit("expense")).alias("direction"),
        F.lit(K.MERGE_ACTION).alias("action"), F.col("first.merchant_raw").alias("merchant_raw"),
        F.col("first.merchant_key").alias("merchant_key"), F.col("first.channel").alias("channel"),
        F.lit(None).cast("decimal(18,2)").alias("balance"), F.lit(None).cast("decimal(18,2)").alias("avail_credit"),
        F.lit(None).cast("bigint").alias("points"), F.col("category"),
        F.when(F.col("category").isNotNull(), F.lit(K.CATEGORY_SRC_MANUAL)).alias("category_src"),
        F.when(F.col("category").isNotNull(), F.lit("confirmed")).otherwise(F.lit("pending")).alias("status"),
        F.lit(None).cast("string").alias("notify_status"), F.lit(None).cast("timestamp_ntz").alias("notified_at"),
        F.lit(False).alias("voided"), F.lit(None).cast("bigint").alias("offset_of"),
        F.coalesce(F.col("month"), F.col("first_period")).alias("effective_month"),
        F.lit(None).cast("bigint").alias("merged_into"), F.col("note"))
    touched = (ok.select("request_id", is_offset.alias("_off"),
                         F.when(~is_offset, merged_id).alias("_into"))
               .join(ex, "request_id").select("id", "_off", "_into").dropDuplicates(["id"]))
    upd = ledger.join(touched, "id", "left")
    hit = F.col("_off").isNotNull() & ~F.col("voided")
    suffix = F.when(F.col("_off"), F.lit(K.NOTE_OFFSET)).otherwise(F.lit(K.NOTE_MERGED))
    upd = (upd.withColumn("merged_into", F.when(hit & ~F.col("_off"), F.col("_into")).otherwise(F.col("merged_into")))
           .withColumn("note", F.when(hit, F.concat(F.coalesce(F.col("note"), F.lit("")), suffix))
                       .otherwise(F.col("note")))
           .withColumn("voided", F.col("voided") | hit)
           .select(*ledger.columns))
    return results, new_rows.select(*ledger.columns), upd.unionByName(new_rows.select(*ledger.columns))


def _merge_in_order(ledger: DataFrame, ex: DataFrame, merges: DataFrame, start_day: int):
    ensure_checkpoint_dir(ledger.sparkSession)
    seq = F.col("seq") if "seq" in merges.columns else F.lit(0)
    heads = merges.select("request_id", seq.alias("seq"), "category", "note", "month", "expected_operation")
    asked = ex.join(heads, "request_id").withColumnsRenamed({"id": "row_id"}).withColumns(
        {"op": F.lit("merge"), "payload": F.lit(None), "amounts": F.lit(None)})
    made = merges.select(F.col("request_id").cast("string").alias("request_id"), merged_row_id(F.col("request_id")).alias("id"))
    pairs = ex.select(F.col("request_id").cast("string").alias("request_id"), "id").unionByName(made)
    rows, _, told = folded(ledger, _long_form(asked), pairs, start_day)
    # a request that names no rows has taken no part in the order
    nobody = merges.select(F.col("request_id").cast("string").alias("request_id")).join(told, "request_id", "left_anti")
    typed = merges.schema["request_id"].dataType
    results = told.unionByName(nobody.select("request_id", F.lit(False).alias("ok"), F.lit("need at least two live transactions").alias("error"),
                                             F.lit(False).alias("offset"), F.lit(0).cast("bigint").alias("count")), allowMissingColumns=True)
    results = results.withColumn("request_id", F.col("request_id").cast(typed))
    new_rows = rows.join(told.select(F.col("merged_id").alias("id")).filter("id IS NOT NULL"), "id", "left_semi").select(*ledger.columns)
    led = ledger.join(rows.select("id"), "id", "left_anti").select(*ledger.columns).unionByName(rows.select(*ledger.columns))
    return results, new_rows, led


# ---- G7 / G9: category maintenance ---------------------------------------------------

def category_rename(ledger: DataFrame, knowledge: DataFrame, renames: DataFrame):
    """Rename categories in rows that carry them (G7). ``renames``: (old_name, new_name).

    Whether the map is broadcast is left to Spark, which sees its size.
    """
    m = renames.filter(F.col("new_name").isNotNull() & (F.col("new_name") != F.col("old_name")))

    def apply(df):
        j = df.join(m, df["category"] == m["old_name"], "left")
        return j.withColumn("category", F.coalesce(F.col("new_name"), F.col("category"))).select(*df.columns)
    return apply(ledger), apply(knowledge)


def category_update(ledger: DataFrame, knowledge: DataFrame, categories: DataFrame, changes: DataFrame):
    """Edit categories by key (G7): (results, ledger', knowledge', categories').

    ``changes``: (key, name, descr), one row per key; null keeps a field. A new
    name goes to the category itself and to all rows that carry the old one. An
    unknown key is reported and changes nothing.
    """
    c = changes.select("key", F.nullif("name", F.lit("")).alias("_name"), F.col("descr").alias("_descr"))
    j = categories.join(c, "key", "left")
    cats = j.withColumn("name", F.coalesce("_name", "name")).withColumn("descr", F.coalesce("_descr", "descr")).select(*categories.columns)
    known = changes.select("key").join(categories.select("key", F.lit(True).alias("_known")), "key", "left")
    results = known.select("key", F.col("_known").isNotNull().alias("ok"),
                           F.when(F.col("_known").isNull(), F.lit("category not found")).alias("error"))
    led, kn = category_rename(ledger, knowledge, j.select(F.col("name").alias("old_name"), F.col("_name").alias("new_name")))
    return results, led, kn, cats


def edit_results(ledger: DataFrame, commands: DataFrame) -> DataFrame:
    """What became of each edit (G6): (txn_id, seq, op, ok, error); an unknown row is 'not found'."""
    have = ledger.select(F.col("id").alias("txn_id"), F.lit(True).alias("_known"))
    r = commands.select("txn_id", "seq", "op").join(have, "txn_id", "left")
    return r.select("txn_id", "seq", "op", F.col("_known").isNotNull().alias("ok"),
                    F.when(F.col("_known").isNull(), F.lit("not found")).alias("error"))


def category_delete(ledger: DataFrame, knowledge: DataFrame, categories: DataFrame, keys: DataFrame):
    """Delete categories by key when no live row uses them.

    Returns (results, ledger', knowledge', categories'). A blocked delete
    reports the live count; an allowed one clears the tag from voided rows and
    knowledge notes. Live usage is one grouped count over the ledger.
    """
    req = keys.join(categories.select("key", "name"), "key", "left")
    usage = (ledger.filter(~F.col("voided") & F.col("category").isNotNull())
             .groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("live_n")))
    r = req.join(usage, "name", "left").withColumn("live_n", F.coalesce(F.col("live_n"), F.lit(0)))
    err = (F.when(F.col("name").isNull(), F.lit("category not found"))
           .when(F.col("live_n") > 0, F.lit("category still in use")))
    results = r.select("key", "name", err.isNull().alias("ok"), err.alias("error"),
                       F.col("live_n").cast("bigint").alias("live_n"))
    gone = results.filter("ok").select(F.col("name").alias("_gone"))
    led = (ledger.join(gone, ledger["category"] == gone["_gone"], "left")
           .withColumn("category", F.when(F.col("_gone").isNotNull() & F.col("voided"), F.lit(None))
                       .otherwise(F.col("category"))).select(*ledger.columns))
    kn = (knowledge.join(gone, knowledge["category"] == gone["_gone"], "left")
          .withColumn("category", F.when(F.col("_gone").isNotNull(), F.lit(None)).otherwise(F.col("category")))
          .select(*knowledge.columns))
    cats = categories.join(results.filter("ok").select("key"), "key", "left_anti")
    return results, led, kn, cats


# ---- G16: mark notified ----------------------------------------------------------------

def mark_notified(ledger: DataFrame, sent_ids: DataFrame, now: str, channel: str | None = None) -> DataFrame:
    """After a successful send, mark exactly the sent rows (G16), and by what ``channel`` they were sent, if it is
    given: in the column ``notify_channel``, which is added to a ledger that has none."""
    s = sent_ids.select("id", F.lit(True).alias("_sent"))
    columns = list(ledger.columns)
    if channel is not None and "notify_channel" not in columns:
        ledger = ledger.withColumn("notify_channel", F.lit(None).cast("string"))
        columns.append("notify_channel")
    j = ledger.join(s, "id", "left")
    hit = F.coalesce(F.col("_sent"), F.lit(False))
    marks = {"notify_status": F.lit("sent"), "notified_at": F.lit(now).cast("timestamp_ntz")}
    if channel is not None:
        marks["notify_channel"] = F.lit(channel)
    return j.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in marks.items()}).select(*columns)


# ---- one command table -------------------------------------------------------------------

EDIT_OPS = ("void", "restore", "set_category", "set_note", "confirm")
#: Edits whose order against a split or merge of the same row matters.
PLACED_OPS = ("void", "restore", "set_note")
STRUCTURAL_OPS = ("split", "merge")


def command_rows(commands: DataFrame) -> DataFrame:
    """(request_id, seq, id): rows that split and merge requests touch or make."""
    c = commands.filter(F.col("op").isin(*STRUCTURAL_OPS))
    touched = c.select("request_id", "seq", F.col("row_id").alias("id"))
    parts = (c.filter("op = 'split'").select("request_id", "seq", F.posexplode("amounts").alias("pos", "part"))
             .select("request_id", "seq", child_id(F.col("request_id"), F.col("pos")).alias("id")))
    merged = c.filter("op = 'merge'").select("request_id", "seq", merged_row_id(F.col("request_id")).alias("id"))
    return touched.unionByName(parts).unionByName(merged).distinct()


def apply_command_table(ledger: DataFrame, commands: DataFrame, start_day: int = 1, repair: bool = True):
    """Apply a mixed command table in ``seq`` order.

    ``commands`` (long form, one row per touched id): request_id string, seq, op,
    row_id, pos, payload, amounts array<decimal(18,2)>, category, note, month,
    expected_operation. ``op`` is an edit (void, restore, set_category, set_note,
    confirm), ``split`` or ``merge``.

    Only splits and merges, and the voids, restores and notes of rows that they touch or make, depend on what came
    before. They are taken in order within the components of the requests that share rows
    (:mod:`tallyframe.operators.command_fold`); all other edits collapse to the last one per row and field. The
    ledger is read once for the rows that the commands name and joined once at the end. After a split refunds are
    paired again (``repair``). Lineage is cut in the shared folder.

    Returns (ledger, split results, merge results); an edit of a row that does
    not exist (yet) has no effect.
    """
    ensure_checkpoint_dir(ledger.sparkSession)
    commands = _long_form(commands).checkpoint()  # read for the graph, the steps and the edits
    rows = command_rows(commands)
    edits = commands.filter(F.col("op").isin(*EDIT_OPS))
    steps = commands.filter(F.col("op").isin(*STRUCTURAL_OPS, *PLACED_OPS))
    done, split_results, merge_results = folded(ledger, steps, rows.select("request_id", "id"), start_day)
    # the rows taken in hand replace their originals; the other edits follow, once
    ids = rows.select("id").distinct()
    out = ledger.join(done.select("id"), "id", "left_anti").select(*ledger.columns).unionByName(done.select(*ledger.columns))
    made = rows.join(done.filter("made").select("id"), "id", "left_semi").groupBy("id").agg(F.min("seq").alias("from_seq"))
    rest = edits.join(ids.select(F.col("id").alias("row_id"), F.lit(True).alias("_structural")), "row_id", "left")
    rest = rest.filter(F.col("_structural").isNull() | ~F.col("op").isin(*PLACED_OPS))
    rest = rest.join(made.withColumnRenamed("id", "row_id"), "row_id", "left").filter(
        F.col("from_seq").isNull() | (F.col("seq") > F.col("from_seq")))
    out = apply_edits(out, rest.select(F.col("row_id").alias("txn_id"), "seq", "op", "payload"))
    if repair and not split_results.filter("ok").isEmpty():
        from .matching import apply_pairing
        out = apply_pairing(out.checkpoint())
    return out, split_results, merge_results


def _long_form(commands: DataFrame) -> DataFrame:
    """The columns of a command table in their types."""
    types = {"seq": "bigint", "row_id": "bigint", "pos": "bigint", "amounts": "array<decimal(18,2)>"}
    return commands.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in STEP])
