"""Matching operators: refund pairing (J1/G1), merge candidates (J2),
reimbursement match (J9).

Refund pairing
--------------
Refunds, in time order, each take the latest earlier *unpaired* live expense of
the same card, merchant and amount (cents). Inside one (card, merchant, cents)
key this is bracket matching on a stack, which two windows express exactly:

1. order the key's rows by (txn_time, direction, id); 'expense' < 'refund', so
   an expense at the same instant comes first (the reference compares '<=');
2. ``bal`` = running sum of +1 (expense) / -1 (refund);
3. ``lvl`` = bal for an expense, bal + 1 for a refund;
4. within (key, lvl) in the same order, a refund whose predecessor is an expense
   is paired with that expense (and the expense's successor is its refund).

The key includes the amount, so a hot (card, merchant) pair is spread over its
distinct amounts; both windows stream over a sorted partition (running frame
and lag/lead need no buffering). Only candidate rows are shuffled: the rest of
the ledger passes by a union, never a join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import billing_period, epoch_micros
from ..session import ensure_checkpoint_dir, ship_package

PAIR_KEY = ["card_last4", "merchant_key", "amt_key"]


def _is_refund() -> Column:
    return F.col("direction") == "refund"


def _pair_candidate() -> Column:
    base = (~F.col("voided") & F.col("card_last4").isNotNull() & F.col("merchant_key").isNotNull())
    return base & (_is_refund() | ((F.col("direction") == "expense") & (F.col("amount") >= 0)))


def pairing_annotated(ledger: DataFrame) -> DataFrame:
    """Candidate rows with ``pair_id`` (the partner's id, or null)."""
    cand = (ledger.filter(_pair_candidate())
            .withColumn("amt_key", F.when(_is_refund(), F.abs(F.col("amount"))).otherwise(F.col("amount"))))
    order = [F.col("txn_time"), F.col("direction"), F.col("id")]
    w_run = (Window.partitionBy(*PAIR_KEY).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    step = F.when(_is_refund(), F.lit(-1)).otherwise(F.lit(1))
    cand = cand.withColumn("_bal", F.sum(step).over(w_run))
    cand = cand.withColumn("_lvl", F.when(_is_refund(), F.col("_bal") + 1).otherwise(F.col("_bal")))
    w_lvl = Window.partitionBy(*PAIR_KEY, "_lvl").orderBy(*order)
    prev_id, prev_dir = F.lag("id").over(w_lvl), F.lag("direction").over(w_lvl)
    next_id, next_dir = F.lead("id").over(w_lvl), F.lead("direction").over(w_lvl)
    pair = (F.when(_is_refund() & (prev_dir == "expense"), prev_id)
            .when(~_is_refund() & (next_dir == "refund"), next_id))
    return cand.withColumn("pair_id", pair).drop("_bal", "_lvl", "amt_key")


def pair_links(ledger: DataFrame, chunk_hours: int = 24) -> DataFrame:
    """(id, pair_id) of every paired row, with hot keys split into time chunks.

    A chunk is a fixed time bucket of ``chunk_hours`` (deterministic, so every
    branch of the plan and every retried task sees the same chunk of a row).
    Narrow candidate rows (key, id, time, direction) cross the network once, by
    (key, chunk); both windows and both summaries are computed on that one
    exchange. The chunks are stitched with the summaries:

    * balance: local running sum + the sum of all earlier chunks of the key
      (a window over one row per (key, chunk));
    * neighbour at a level: the last row of a (key, level, chunk) run meets the
      first row of the same level in the next chunk that has the level, and
      two runs pair there if an expense meets a refund (a window over one row
      per (key, level, chunk)).

    No window partition holds more than one chunk of raw rows.
    """
    order = ["txn_time", "direction", "id"]
    bucket = F.lit(int(chunk_hours) * 3600 * 1_000_000)
    kc = [*PAIR_KEY, "_c"]
    kl = [*PAIR_KEY, "_lvl"]
    u = (ledger.filter(_pair_candidate())
         .select("card_last4", "merchant_key",
                 F.when(_is_refund(), F.abs(F.col("amount"))).otherwise(F.col("amount")).alias("amt_key"),
                 F.floor(epoch_micros("txn_time") / bucket).alias("_c"), "id", "txn_time", "direction")
         # said once for all branches: a join would add it to one side only, and the exchanges would differ
         .filter(F.col("amt_key").isNotNull() & F.col("_c").isNotNull())
         .repartition(*kc))
    step = F.when(_is_refund(), F.lit(-1)).otherwise(F.lit(1))
    w_prev = Window.partitionBy(*PAIR_KEY).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    w_local = Window.partitionBy(*kc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("_lb", F.sum(step).over(w_local))
    # a chunk's sum is its last running sum: the same columns, hence the same exchange, as all else here
    offs = (u.groupBy(*kc).agg(F.max_by("_lb", F.struct(*order)).alias("_cs"))
            .select(*kc, F.coalesce(F.sum("_cs").over(w_prev), F.lit(0)).alias("_off")))
    u = u.join(offs, kc)
    bal = F.col("_lb") + F.col("_off")
    u = u.withColumn("_lvl", F.when(_is_refund(), bal + 1).otherwise(bal)).drop("_lb", "_off")
    # inside a chunk: neighbours of the same level, in order of (level, time)
    w_lvl = Window.partitionBy(*kc).orderBy("_lvl", *order)
    inside = (u.withColumn("_p", F.lag(F.struct("_lvl", "direction", "id")).over(w_lvl))
              .filter(_is_refund() & (F.col("_p._lvl") == F.col("_lvl")) & (F.col("_p.direction") == "expense"))
              .select(F.col("id").alias("_refund"), F.col("_p.id").alias("_expense")))
    # across chunks: the last row of a level's run and the first of its next one
    end = F.struct(F.col("id").alias("i"), F.col("direction").alias("d"))
    ends = u.groupBy(*kl, "_c").agg(F.max_by(end, F.struct(*order)).alias("_last"),
                                    F.min_by(end, F.struct(*order)).alias("_first"))
    before = F.lag("_last").over(Window.partitionBy(*kl).orderBy("_c"))
    across = (ends.withColumn("_before", before)
              .filter((F.col("_first.d") == "refund") & (F.col("_before.d") == "expense"))
              .select(F.col("_first.i").alias("_refund"), F.col("_before.i").alias("_expense")))
    pairs = inside.unionByName(across)
    return pairs.select(F.explode(F.array(
        F.struct(F.col("_refund").alias("id"), F.col("_expense").alias("pair_id")),
        F.struct(F.col("_expense").alias("id"), F.col("_refund").alias("pair_id")))).alias("x")).select("x.*")


def _paired(ledger: DataFrame, chunk_hours: int | None) -> DataFrame:
    """The ledger with ``pair_id`` (null where a row has no partner)."""
    if not chunk_hours:
        links = pairing_annotated(ledger).filter(F.col("pair_id").isNotNull()).select("id", "pair_id")
    else:
        links = pair_links(ledger, chunk_hours)
    return ledger.join(links, "id", "left")


def refund_pairs(ledger: DataFrame, chunk_hours: int | None = 24) -> DataFrame:
    """Exact offsetting (refund, expense) pairs.

    ``chunk_hours`` bounds every window partition to one key-bucket (default a
    day); ``None`` uses the single-pass two-window plan.
    """
    if not chunk_hours:
        a = pairing_annotated(ledger)
    else:
        a = ledger.filter(_pair_candidate() & _is_refund()).join(pair_links(ledger, chunk_hours), "id")
    a = a.filter(_is_refund() & F.col("pair_id").isNotNull())
    return a.select(F.col("id").alias("refund_id"), F.col("pair_id").alias("expense_id"),
                    "card_last4", "merchant_key", F.abs(F.col("amount")).cast("double").alias("amount"),
                    F.col("txn_time").alias("refund_time"))


def apply_pairing(ledger: DataFrame, chunk_hours: int | None = 24) -> DataFrame:
    """Ledger after pairing (G1): both sides voided and pointing at each other.

    Sticky semantics (Q4): only rows live at the time take part, and earlier
    links are kept. The links of paired rows are joined back on the row id.
    """
    return (_paired(ledger, chunk_hours)
            .withColumn("voided", F.col("voided") | F.col("pair_id").isNotNull())
            .withColumn("offset_of", F.coalesce(F.col("pair_id"), F.col("offset_of")))
            .select(*ledger.columns))


SWEEP_SCHEMA = ("kind string, card_last4 string, merchant_key string, refund_id bigint, refund_x long, refund_t long, "
                "expense_id bigint, expense_x long, expense_t long")


def _stack_sweep(group_columns, last):
    """Per group: latest earlier expense whose amount covers the refund.

    Rows arrive sorted by group and then by (time, expenses first, id): 'S' rows
    are expenses, 'U' rows open refunds, 'R' rows are answered already and pass.
    A monotonic stack keeps the expenses that can still be someone's answer
    (amounts strictly decreasing from bottom to top, times increasing): an older
    expense whose amount is not larger than a newer one can never be "the latest
    with amount >= X". A refund's answer is the topmost entry with amount >= X,
    found by bisection. Emits answered refunds ('R') and, unless this is the
    ``last`` level, open refunds and each group's remaining stack for the next.
    Linear in the rows; the stack is the only state.
    """
    import bisect

    import pyarrow as pa

    types = {"string": pa.string(), "bigint": pa.int64(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SWEEP_SCHEMA.split(", ")])

    def table(rows):
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        cur, neg, kept, out = None, [], [], []
        for batch in batches:
            groups = zip(*[batch.column(c).to_pylist() for c in group_columns])
            for group, row in zip(groups, zip(*[batch.column(c).to_pylist() for c in schema.names])):
                if group != cur:
                    if not last:
                        out += kept
                    cur, neg, kept = group, [], []
                if row[0] == "S":
                    while neg and -neg[-1] <= row[7]:
                        neg.pop()
                        kept.pop()
                    neg.append(-row[7])
                    kept.append(row)
                elif row[0] == "R":
                    out.append(row)
                else:
                    k = bisect.bisect_right(neg, -abs(row[4])) - 1
                    if k >= 0:
                        out.append(("R", *row[1:6], *kept[k][6:]))
                    elif not last:
                        out.append(row)
            yield table(out)
            out = []
        if not last and kept:
            yield table(kept)

    return run


FAN = 256        # chunks of a node of the time tree, and nodes of its top
SALTS = 16       # places in which a node's summary meets the refunds that ask it
ASKS = 1 << 16   # refunds that one task answers from one chunk


def _latest(nodes: Column, covers: Column, before: Column | None = None) -> Column:
    """The last node, of those sorted in ``nodes``, with an expense that covers the amount (null if there is none)."""
    hits = F.filter(nodes, lambda n: (n["top"] >= covers) & (F.lit(True) if before is None else n["node"] < before))
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["node"])


def _summaries(tops: DataFrame, node: str) -> DataFrame:
    """One row for each node above: its children with their largest expenses, in order of time, and its own largest."""
    return tops.groupBy("card_last4", "merchant_key", F.floor(F.col(node) / FAN).alias("above")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(node).alias("node"), "top"))).alias("nodes"), F.max("top").alias("top"))


def _ask(asks: DataFrame, summaries: DataFrame, above: Column) -> DataFrame:
    """Refunds with the children of the node each of them asks; a node may be asked by a third of all refunds."""
    copies = summaries.select("card_last4", "merchant_key", "above", "nodes",
                              F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asks = asks.withColumns({"above": above, "salt": F.pmod("refund_id", F.lit(SALTS)).cast("int")})
    return asks.join(copies, ["card_last4", "merchant_key", "above", "salt"])


def merge_candidates(ledger: DataFrame, start_day: int = 1, min_refund: float = 10.0,
                     chunk_days: int = 30) -> DataFrame:
    """Cross-period (expense, later refund) merge suggestions.

    Each live refund with |amount| >= ``min_refund`` takes the latest live
    expense of the same card and merchant at or before it whose amount covers
    the refund (ties: larger id). The pick comes first; the result is kept only
    when the two raw billing periods differ. An expense may serve many refunds.

    Plan (exact, one scan of the ledger, no pair emission): expenses
    and qualifying refunds are swept per (card, merchant, time chunk) with a
    monotonic stack (``_stack_sweep``). What a chunk leaves over is its open refunds, and the
    expenses that can still answer a later one. Time is a tree: ``FAN`` chunks make a node, ``FAN`` nodes the
    whole of it, and a node's summary is the largest expense of each child. An open refund asks its node for the
    latest earlier chunk that can answer it, failing that the top for the latest earlier node, and that one for its
    latest chunk; there the chunk's stack answers it in a second sweep. So no task ever holds a
    (card, merchant): first a chunk's rows, then a summary of ``FAN`` entries, last a chunk's stack with up to
    ``ASKS`` refunds. Chunks are fixed time buckets, so retried tasks see the same ones; what the first sweep leaves
    is cut from its lineage in the shared folder.
    """
    ship_package(ledger.sparkSession)
    ensure_checkpoint_dir(ledger.sparkSession)
    live = ledger.filter(~F.col("voided") & F.col("card_last4").isNotNull() & F.col("merchant_key").isNotNull())
    cents = (F.col("amount") * 100).cast("bigint")
    expense = F.col("direction") == "expense"
    refund = (F.col("direction") == "refund") & (F.abs(F.col("amount")) >= F.lit(min_refund))
    micros = epoch_micros("txn_time")
    u = live.filter(expense | refund).select(
        F.when(expense, "S").otherwise("U").alias("kind"), "card_last4", "merchant_key",
        *[F.when(~expense, c).alias(n) for c, n in ((F.col("id"), "refund_id"), (cents, "refund_x"), (micros, "refund_t"))],
        *[F.when(expense, c).alias(n) for c, n in ((F.col("id"), "expense_id"), (cents, "expense_x"), (micros, "expense_t"))])
    t = F.coalesce("refund_t", "expense_t")
    order = [t, F.coalesce(F.col("kind") == "U", F.lit(False)), F.coalesce("refund_id", "expense_id")]
    # counted from the middle of the tree, so that all chunks of the calendar lie in it
    chunk = F.floor(t / F.lit(int(chunk_days) * 86_400_000_000)) + F.lit(FAN * FAN // 2)
    by = ["card_last4", "merchant_key", "chunk"]
    first = (u.withColumn("chunk", chunk).repartition(*by).sortWithinPartitions(*by, *order)
             .mapInArrow(_stack_sweep(by, False), SWEEP_SCHEMA).checkpoint())
    left = first.filter("kind = 'S'").withColumn("chunk", chunk)
    asks = first.filter("kind = 'U'").select("card_last4", "merchant_key", "refund_id", "refund_x", "refund_t", chunk.alias("own"))
    nodes = _summaries(left.groupBy("card_last4", "merchant_key", "chunk").agg(F.max("expense_x").alias("top")), "chunk")
    top = _summaries(nodes.withColumnRenamed("above", "at"), "at")
    covers, own_node = F.abs(F.col("refund_x")), F.floor(F.col("own") / FAN)
    columns = asks.columns
    near = _ask(asks, nodes, own_node).select(*columns, _latest(F.col("nodes"), covers, F.col("own")).alias("chunk"))
    near = near.filter(F.col("chunk").isNotNull())
    far = asks.join(near.select("refund_id"), "refund_id", "left_anti")
    far = _ask(far, top, F.floor(own_node / FAN)).select(*columns, _latest(F.col("nodes"), covers, own_node).alias("node"))
    far = _ask(far.filter(F.col("node").isNotNull()), nodes, F.col("node")).select(*columns, _latest(F.col("nodes"), covers).alias("chunk"))
    placed = near.unionByName(far)
    tasks = placed.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("tasks"))
    stacks = left.join(tasks, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    placed = placed.join(tasks, by).withColumn("part", F.pmod("refund_id", "tasks").cast("int")).drop("tasks", "own")
    second = stacks.unionByName(placed.withColumn("kind", F.lit("U")), allowMissingColumns=True)
    by = [*by, "part"]
    answered = second.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(_stack_sweep(by, True), SWEEP_SCHEMA)
    picks = first.filter("kind = 'R'").unionByName(answered)
    when = lambda c: F.timestamp_add("MICROSECOND", F.col(c), F.lit("1970-01-01").cast("timestamp_ntz"))
    amount = lambda c: (F.col(c) / 100).cast("decimal(18,2)")
    out = picks.select("merchant_key", "expense_id", amount("expense_x").alias("expense_amount"),
                       when("expense_t").alias("expense_time"), "refund_id", amount("refund_x").alias("refund_amount"),
                       when("refund_t").alias("refund_time"))
    out = out.filter(billing_period("expense_time", start_day) != billing_period("refund_time", start_day))
    return out.select(
        "merchant_key", "expense_id", F.col("expense_amount").cast("double").alias("expense_amount"),
        "expense_time", "refund_id", F.col("refund_amount").cast("double").alias("refund_amount"),
        "refund_time", F.round(F.col("expense_amount") + F.col("refund_amount"), 2).cast("double").alias("net"))


def reimbursement_match(ledger: DataFrame, deposits: DataFrame, window_days: int = 30,
                        chunk_hours: int = 24) -> DataFrame:
    """Expense -> first deposit of the same amount within ``window_days`` after it.

    An as-of join without materialised pairs. Rows cross the network once, by
    (amount, time chunk), so a common amount is spread over its busy chunks:

    * inside a chunk the first later deposit is the last one seen going back in
      time (a frame that only grows: linear in the rows);
    * otherwise the first deposit of the next chunk of that amount that has one,
      from one row per (amount, chunk).
    """
    chunk = F.floor(epoch_micros("t") / F.lit(int(chunk_hours) * 3600 * 1_000_000))
    e = (ledger.filter(~F.col("voided") & (F.col("direction") == "expense") & (F.col("amount") > 0))
         .select(F.col("id").alias("expense_id"), F.col("txn_time").alias("t"),
                 F.col("amount").alias("amount"), F.lit(0).alias("side"),
                 F.lit(None).cast("bigint").alias("deposit_id")))
    d = deposits.select(F.lit(None).cast("bigint").alias("expense_id"), F.col("txn_time").alias("t"),
                        F.col("amount").cast("decimal(18,2)").alias("amount"), F.lit(1).alias("side"),
                        F.col("id").alias("deposit_id"))
    u = e.unionByName(d).withColumn("c", chunk).repartition("amount", "c")
    dep = F.when(F.col("side") == 1, F.struct(F.col("t").alias("dt"), F.col("deposit_id").alias("did")))
    # backwards in time the frame only grows, so each row is added once; an
    # expense comes after the deposits of its own instant
    back = (Window.partitionBy("amount", "c").orderBy(F.desc("t"), F.desc("side"), F.desc("deposit_id"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = u.withColumn("nx", F.last(dep, ignorenulls=True).over(back)).filter(F.col("side") == 0)
    later = Window.partitionBy("amount").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = u.groupBy("amount", "c").agg(F.min(dep).alias("fd"))
    nxt = firsts.select("amount", "c", F.last("fd", ignorenulls=True).over(later).alias("nb"))
    m = local.join(nxt, ["amount", "c"], "left").withColumn("nx", F.coalesce(F.col("nx"), F.col("nb")))
    limit = F.col("t") + F.make_dt_interval(F.lit(window_days))
    return m.select(
        "expense_id", F.col("t").alias("expense_time"), F.col("amount").cast("double").alias("amount"),
        F.when(F.col("nx.dt") <= limit, F.col("nx.did")).alias("deposit_id"),
        F.when(F.col("nx.dt") <= limit, F.col("nx.dt")).alias("deposit_time"))
