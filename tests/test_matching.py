"""Refund pairing against a plain greedy loop, merge candidates, reimbursement."""
import random

from pyspark.sql import functions as F

from tests_support import ledger
from tallyframe.operators import matching


def greedy_pairs(rows):
    """Sequential reading of the pairing rule: refunds in (time, id) order each take
    the latest earlier unpaired expense (time <= refund time, ties by larger id)."""
    live = [r for r in rows if not r["voided"] and r["card_last4"] and r["merchant_key"]]
    refunds = sorted((r for r in live if r["direction"] == "refund"), key=lambda r: (r["txn_time"], r["id"]))
    used, out = set(), set()
    for r in refunds:
        best = None
        for e in live:
            if (e["direction"] == "expense" and e["id"] not in used and e["card_last4"] == r["card_last4"]
                    and e["merchant_key"] == r["merchant_key"] and abs(e["amount"] - abs(r["amount"])) < 0.005
                    and e["txn_time"] <= r["txn_time"]):
                if best is None or (e["txn_time"], e["id"]) > (best["txn_time"], best["id"]):
                    best = e
        if best is not None:
            used.add(best["id"])
            out.add((r["id"], best["id"]))
    return out


def test_pairing_equals_greedy_on_random_ledgers(spark):
    rnd = random.Random(7)
    rows = []
    for case in range(60):
        for j in range(rnd.randint(1, 12)):
            rows.append({
                "card_last4": rnd.choice(["0001", "0002", None]) if rnd.random() < 0.1 else "0001",
                "merchant_key": f"c{case}-" + rnd.choice(["a", "b"]),
                "direction": rnd.choice(["expense", "expense", "refund", "fee"]),
                "amount": rnd.choice([10.0, 20.0, 10.0]),
                # few distinct times so that ties are common
                "txn_time": f"2026-01-0{rnd.randint(1, 3)} 10:00:00",
                "voided": rnd.random() < 0.1,
            })
    for r in rows:
        if r["direction"] == "refund":
            r["amount"] = -r["amount"]
    df = ledger(spark, rows)
    got = {(r["refund_id"], r["expense_id"]) for r in matching.refund_pairs(df).collect()}
    native = [dict(x.asDict(), amount=float(x["amount"])) for x in df.collect()]
    assert got == greedy_pairs(native)


def test_apply_pairing_links_both_sides(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01 10:00:00", "amount": 50.0},
                        {"txn_time": "2026-01-02 10:00:00", "amount": -50.0, "direction": "refund"}])
    out = {r["id"]: (r["voided"], r["offset_of"]) for r in matching.apply_pairing(df).collect()}
    assert out == {1: (True, 2), 2: (True, 1)}


def test_pairing_is_sticky_for_voided_rows(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01 10:00:00", "amount": 50.0, "voided": True},
                        {"txn_time": "2026-01-02 10:00:00", "amount": -50.0, "direction": "refund"}])
    assert matching.refund_pairs(df).count() == 0


def test_merge_candidates_pick_then_period(spark):
    # latest covering expense is in the refund's own period, so nothing is flagged (Q3)
    df = ledger(spark, [{"txn_time": "2026-01-05 10:00:00", "amount": 500.0},
                        {"txn_time": "2026-02-03 10:00:00", "amount": 300.0},
                        {"txn_time": "2026-02-20 10:00:00", "amount": -200.0, "direction": "refund"}])
    assert matching.merge_candidates(df, 1).count() == 0
    df2 = ledger(spark, [{"txn_time": "2026-01-05 10:00:00", "amount": 500.0},
                         {"txn_time": "2026-02-03 10:00:00", "amount": 100.0},
                         {"txn_time": "2026-02-20 10:00:00", "amount": -200.0, "direction": "refund"}])
    r = matching.merge_candidates(df2, 1).collect()
    assert len(r) == 1 and r[0]["expense_id"] == 1 and r[0]["net"] == 300.0


def test_merge_candidates_skip_small_refunds(spark):
    df = ledger(spark, [{"txn_time": "2026-01-05 10:00:00", "amount": 50.0},
                        {"txn_time": "2026-02-20 10:00:00", "amount": -5.0, "direction": "refund"}])
    assert matching.merge_candidates(df, 1).count() == 0


def test_reimbursement_window(spark):
    df = ledger(spark, [{"txn_time": "2026-01-05 10:00:00", "amount": 88.0},
                        {"txn_time": "2026-01-06 10:00:00", "amount": 66.0}])
    dep = spark.createDataFrame(
        [(1, "2026-01-07 09:00:00", 88.0), (2, "2026-02-20 09:00:00", 66.0)],
        "id bigint, t string, amount double").select(
        "id", F.col("t").cast("timestamp_ntz").alias("txn_time"), F.col("amount").cast("decimal(18,2)").alias("amount"))
    got = {r["expense_id"]: r["deposit_id"] for r in matching.reimbursement_match(df, dep, 30).collect()}
    assert got == {1: 1, 2: None}


def brute_candidates(rows, min_refund=10.0, start_day=1):
    def period(t):
        import datetime as dt
        d = t - dt.timedelta(days=start_day - 1)
        return d.strftime("%Y-%m")
    live = [r for r in rows if not r["voided"] and r["card_last4"] and r["merchant_key"]]
    out = set()
    for r in live:
        if r["direction"] != "refund" or abs(r["amount"]) < min_refund:
            continue
        best = None
        for e in live:
            if (e["direction"] == "expense" and e["card_last4"] == r["card_last4"]
                    and e["merchant_key"] == r["merchant_key"] and e["txn_time"] <= r["txn_time"]
                    and e["id"] != r["id"] and e["amount"] >= abs(r["amount"])):
                if best is None or (e["txn_time"], e["id"]) > (best["txn_time"], best["id"]):
                    best = e
        if best is not None and period(best["txn_time"]) != period(r["txn_time"]):
            out.add((r["id"], best["id"]))
    return out


def test_merge_candidates_hot_key_split_across_partitions(spark):
    rnd = random.Random(11)
    rows = []
    for j in range(1500):
        is_refund = rnd.random() < 0.3
        amt = rnd.choice([5.0, 12.0, 30.0, 50.0, 80.0, 120.0, 300.0])
        rows.append({"card_last4": "0001" if rnd.random() < 0.8 else "0002",
                     "merchant_key": "hot" if rnd.random() < 0.8 else "cold",
                     "direction": "refund" if is_refund else "expense",
                     "amount": -amt if is_refund else amt,
                     "txn_time": f"2026-{rnd.randint(1, 6):02d}-{rnd.randint(1, 28):02d} {rnd.randint(0, 2):02d}:00:00",
                     "voided": rnd.random() < 0.05})
    df = ledger(spark, rows)
    native = [dict(x.asDict(), amount=float(x["amount"])) for x in df.collect()]
    want = brute_candidates(native)
    for days in (1, 7, 30, 4000):
        got = {(r["refund_id"], r["expense_id"]) for r in matching.merge_candidates(df, 1, chunk_days=days).collect()}
        assert got == want, days
    assert len(want) >= 10


def test_chunked_pairing_equals_plain_on_hot_keys(spark):
    rnd = random.Random(5)
    rows = []
    for j in range(2000):
        is_refund = rnd.random() < 0.45
        amt = rnd.choice([10.0, 10.0, 20.0])
        rows.append({"card_last4": "0001", "merchant_key": "hot" if rnd.random() < 0.9 else "cold",
                     "direction": "refund" if is_refund else "expense", "amount": -amt if is_refund else amt,
                     "txn_time": f"2026-01-{rnd.randint(1, 28):02d} {rnd.randint(0, 3):02d}:00:00",
                     "voided": rnd.random() < 0.05})
    df = ledger(spark, rows)
    plain = {(r["id"], r["pair_id"]) for r in matching.pairing_annotated(df).collect()}
    native = [dict(x.asDict(), amount=float(x["amount"])) for x in df.collect()]
    want = greedy_pairs(native)
    assert {(i, p) for i, p in plain if p is not None and i in {a for a, _ in want}} == want
    linked = {(i, p) for i, p in plain if p is not None}
    for hours in (1, 5, 24, 24 * 40):
        got = {(r["id"], r["pair_id"]) for r in matching.pair_links(df, hours).collect()}
        assert got == linked, hours


def test_reimbursement_matches_brute_force_across_buckets(spark):
    rnd = random.Random(9)
    rows = [{"txn_time": f"2026-0{rnd.randint(1, 3)}-{rnd.randint(1, 28):02d} 10:00:00",
             "amount": rnd.choice([20.0, 30.0]), "voided": rnd.random() < 0.05} for _ in range(120)]
    df = ledger(spark, rows)
    deps = [(i, f"2026-0{rnd.randint(1, 3)}-{rnd.randint(1, 28):02d} {rnd.randint(9, 11):02d}:00:00",
             rnd.choice([20.0, 30.0])) for i in range(60)]
    dep = spark.createDataFrame(deps, "id bigint, t string, amount double").select(
        "id", F.col("t").cast("timestamp_ntz").alias("txn_time"), F.col("amount").cast("decimal(18,2)").alias("amount"))
    import datetime as dt
    native = [x.asDict() for x in df.collect()]
    want = {}
    for e in native:
        if e["voided"]:
            continue
        c = sorted((d[1], d[0]) for d in deps if d[2] == float(e["amount"])
                   and dt.datetime.strptime(d[1], "%Y-%m-%d %H:%M:%S") >= e["txn_time"])
        first = c[0] if c else None
        ok = first and dt.datetime.strptime(first[0], "%Y-%m-%d %H:%M:%S") <= e["txn_time"] + dt.timedelta(days=7)
        want[e["id"]] = first[1] if ok else None
    got = {r["expense_id"]: r["deposit_id"] for r in matching.reimbursement_match(df, dep, 7).collect()}
    assert got == want


def test_merge_candidates_keep_large_ids(spark):
    big = 2 ** 62 + 1
    rows = [{"id": big, "amount": 120.0, "txn_time": "2026-01-05 10:00:00"},
            {"id": big + 2, "amount": -20.0, "direction": "refund", "txn_time": "2026-03-05 10:00:00"}]
    r = matching.merge_candidates(ledger(spark, rows), 1).collect()
    assert [(x["expense_id"], x["refund_id"], x["net"]) for x in r] == [(big, big + 2, 100.0)]


def test_reimbursement_of_one_amount_is_linear(spark):
    import time

    def run(n):
        e = spark.range(n).select(F.col("id"), F.lit(False).alias("voided"), F.lit("expense").alias("direction"),
                                  F.lit(30).cast("decimal(18,2)").alias("amount"),
                                  F.timestamp_add("SECOND", F.col("id"), F.lit("2026-01-05").cast("timestamp_ntz")).alias("txn_time"))
        d = e.where("id % 2 = 0").select((F.col("id") + n).alias("id"), "txn_time", "amount")
        t = time.time()
        matching.reimbursement_match(e, d, 30).write.format("noop").mode("overwrite").save()
        return time.time() - t

    run(1000)
    small, large = run(40_000), run(80_000)
    assert large < 3 * small + 1  # a frame that is added up anew for every row would take four times as long
