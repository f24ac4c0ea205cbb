"""Time tree of the merge candidates, prefix index, card texts, rollup, totals of status in one pass."""
import random

from pyspark.sql import functions as F
from tests_support import ledger

from tallyframe import constants as K
from tallyframe.operators import advice, extract, matching, notify, reports


def brute_candidates(rows, least=10):
    out = {}
    for r in rows:
        if r["direction"] == "refund" and abs(r["amount"]) >= least:
            fits = [(e["txn_time"], e["id"]) for e in rows if e["direction"] == "expense" and e["amount"] >= abs(r["amount"])
                    and e["txn_time"] <= r["txn_time"]]
            if fits and max(fits)[0].strftime("%Y-%m") != r["txn_time"].strftime("%Y-%m"):
                out[r["id"]] = max(fits)[1]
    return out


def test_one_key_with_falling_amounts_spreads_over_tasks(spark, monkeypatch):
    """Every expense can still answer a later refund, so no chunk can drop any: yet no task sees the whole key."""
    n = 1200
    base = [{"id": i, "txn_time": f"{1990 + i // 40}-{1 + (i // 4) % 10:02d}-{1 + i % 28:02d} 10:00:00", "amount": float(5000 - 4 * i)} for i in range(n)]
    rng = random.Random(1)
    asks = [{"id": n + i, "txn_time": f"{2021 + i // 40}-{1 + (i // 4) % 10:02d}-{1 + i % 28:02d} 11:00:00", "amount": -float(rng.randint(10, 5200)),
             "direction": "refund"} for i in range(400)]
    led = ledger(spark, base + asks)
    want = brute_candidates([r.asDict() for r in led.collect()])
    got = {r.refund_id: r.expense_id for r in matching.merge_candidates(led, chunk_days=30).collect()}
    assert got == want and len(want) > 100
    seen = []
    sweep = matching._stack_sweep
    # a sweep's groups are (card, merchant, chunk[, part]): none may hold the key by itself
    monkeypatch.setattr(matching, "_stack_sweep", lambda by, last: seen.append(list(by)) or sweep(by, last))
    matching.merge_candidates(led, chunk_days=30)
    assert seen == [["card_last4", "merchant_key", "chunk"], ["card_last4", "merchant_key", "chunk", "part"]]


def test_candidates_over_all_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(matching, "FAN", 16)
    monkeypatch.setattr(matching, "ASKS", 3)
    rng = random.Random(2)
    rows = [{"txn_time": f"20{rng.randint(24, 26)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:00:00",
             "amount": (-1 if (x := rng.random() < 0.4) else 1) * float(rng.randint(5, 60)), "direction": "refund" if x else "expense"} for _ in range(400)]
    led = ledger(spark, rows)
    want = brute_candidates([r.asDict() for r in led.collect()])
    # chunks counted from the middle of a tree of 256 chunks, so days long enough that all years fit
    got = {r.refund_id: r.expense_id for r in matching.merge_candidates(led, chunk_days=200).collect()}
    assert got == want and len(want) > 30


def test_prefix_index_equals_comparing_everything(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(60)]
    merchants = sorted({(m, rng.randint(0, 1)) for m in names}, key=lambda x: x[0])
    merchants = list({m: (m, b) for m, b in merchants}.values())
    keys = [(rng.randint(0, 1), "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), p) for p in range(50)] + [(0, None, 99)]
    a = spark.createDataFrame([(b, k, p, f"c{p}", "none", [p], "") for b, k, p in keys],
                              "batch_id bigint, adv_key string, pos bigint, category string, operation string, related_ids array<bigint>, reason string")
    m = spark.createDataFrame(merchants, "merchant_key string, batch_id bigint")
    want = {}
    for name, b in merchants:
        fits = [(k != name, p) for kb, k, p in keys if kb == b and k is not None and (k.startswith(name) or name.startswith(k))]
        want[name] = f"c{min(fits)[1]}" if fits else None
    assert {r.merchant_key: r.category for r in advice.advice_pick(m, a).collect()} == want
    plan = advice.advice_pick(m, a)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_card_texts_are_cut_at_their_length(spark):
    led = ledger(spark, [{"txn_time": f"2026-06-{1 + i % 28:02d} 10:{i % 60:02d}:00", "amount": float(i), "card_last4": "1111" if i % 3 else None,
                          "merchant_raw": f"shop number {i}"} for i in range(120)])
    none = spark.createDataFrame([], "transaction_id bigint, operation string, related_transaction_ids string, reason string")
    queue = notify.notify_queue(led, none)
    lines = [r.line for r in notify.digest_message(queue).filter("section = 1 AND id IS NOT NULL AND card_last4 = '1111'").collect()]
    texts = notify.digest_text(queue, 500).filter("card_last4 = '1111'").collect()
    assert [r.part for r in texts] == list(range(len(texts))) and len(texts) > 3
    bodies = [r.text.split("\n") for r in texts]
    assert all(b[0] == K.CARD_LABELS["credit"] + "1111" for b in bodies) and [x for b in bodies for x in b[1:]] == lines
    assert all(len("\n".join(b[1:-1])) < 500 for b in bodies)
    whole = notify.digest_text(queue).collect()
    assert len(whole) == 2 and sum(r.n_lines for r in whole) == 120


def test_rollup_equals_the_matrices(spark):
    led = ledger(spark, [{"txn_time": f"20{20 + i % 3}-{1 + i % 12:02d}-{1 + i % 28:02d} 10:00:00", "amount": float(i), "category": [None, "a", "b"][i % 3],
                          "direction": ["expense", "income", "refund"][i % 5 % 3], "voided": i % 7 == 0} for i in range(200)])
    rows = reports.spend_rollup(led, 15).collect()
    cells = {(r.m, r.c): (r.spend, r.n) for r in rows if r.level == 0}
    assert cells == {(r.m, r.c): (r.spend, r.n) for r in reports.monthly_matrix(led, 15).collect()}
    by_year = {}
    for r in reports.annual_matrix(led, 15, "2000").collect():
        by_year[r.y] = round(by_year.get(r.y, 0) + r.spend, 2)
    assert {r.y: r.spend for r in rows if r.level == 3} == by_year
    total = [r for r in rows if r.level == 7]
    assert len(total) == 1 and total[0].spend == round(sum(by_year.values()), 2)
    plan = reports.spend_rollup(led, 15)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_outcomes_in_one_pass_equal_those_by_joins(spark):
    good = ("<p>2026/06/19&nbsp;您的消费明细如下：</p><div>09:00:00</div><div>CNY 10.00</div><div>尾号5678 消费 店</div>"
            "<div>25:99:99</div><div>CNY 1.00</div><div>尾号5678 消费 店</div>")
    digest = ("ccsvc@message.cmbchina.com", "每日信用管家")
    rows = [(1, "a", *digest, good), (2, "b", *digest, "<p>nothing</p>"), (3, "c", *digest, None),
            (4, "d", *digest, good.replace("09:00:00", "99:00:00")), (5, "e", "95555@message.cmbchina.com", "一卡通账户变动通知", None),
            (6, "f", "95555@message.cmbchina.com", "一卡通账户变动通知", None), (7, "g", "x@y", "优惠", good)]
    mails = spark.createDataFrame(rows, "uid bigint, msg_id string, sender string, subject string, html string")
    ai = spark.createDataFrame([(5, True), (6, False)], "uid bigint, kept boolean")
    routed = extract.mail_route(mails)
    bodies = mails.join(routed.filter("parser_output = 'transactions'").select("uid"), "uid", "left_semi")
    counts = extract.digest_extract(bodies.select(F.col("uid").cast("string").alias("source_msg_id"), "html"))
    counts = counts.groupBy(F.col("source_msg_id").cast("bigint").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(extract.mail_outcomes(mails, ai)) == key(extract.mail_status(routed, counts, ai))
    assert {r.uid: r.status for r in extract.mail_outcomes(mails, ai).collect()} == {
        1: "parsed", 2: "error", 3: "error", 4: "error", 5: "parsed", 6: "skipped", 7: "skipped"}
