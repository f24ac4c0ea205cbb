"""Requests that share rows: order, money, components; jobs of a command table."""
import random
from decimal import Decimal as D

from pyspark.sql import functions as F
from tests_support import ledger

from tallyframe.operators import command_fold
from tallyframe.operators import commands as CMD

SCHEMA = ("request_id string, seq int, op string, row_id bigint, pos bigint, payload string, "
          "amounts array<decimal(18,2)>, category string, note string, month string, expected_operation string")


def step(request, seq, op, row, pos=0, payload=None, amounts=None, expected=None, category=None):
    return (request, seq, op, row, pos, payload, [D(str(a)) for a in amounts] if amounts else None, category, None, None, expected)


def live_total(df):
    return df.filter(~F.col("voided")).agg(F.sum("amount")).first()[0]


def merge_tables(spark, requests):
    """requests: id -> (seq, expected, [row ids])"""
    ids = spark.createDataFrame([(r, p, i) for r, (_, _, rows) in requests.items() for p, i in enumerate(rows)],
                                "request_id string, pos bigint, id bigint")
    heads = spark.createDataFrame([(r, s, None, None, None, e) for r, (s, e, _) in requests.items()],
                                  "request_id string, seq bigint, category string, note string, month string, expected_operation string")
    return ids, heads


def test_overlapping_merges_keep_money(spark):
    df = ledger(spark, [{"txn_time": f"2026-06-1{i} 10:00:00", "amount": float(10 * (i + 1))} for i in range(3)])
    res, new, out = CMD.merge_apply(df, *merge_tables(spark, {"a": (1, None, [1, 2]), "b": (2, None, [2, 3])}))
    got = {r.request_id: (r.ok, r.error, r.net, r["count"]) for r in res.collect()}
    assert got == {"a": (True, None, 30.0, 2), "b": (False, "need at least two live transactions", None, 1)}
    assert live_total(out) == live_total(df) == D("60.00") and new.count() == 1 and out.count() == 4
    # the other way round by seq
    res, _, out = CMD.merge_apply(df, *merge_tables(spark, {"a": (2, None, [1, 2]), "b": (1, None, [2, 3])}))
    assert {r.request_id: r.ok for r in res.collect()} == {"a": False, "b": True} and live_total(out) == D("60.00")


def test_a_refused_request_claims_nothing(spark):
    df = ledger(spark, [{"txn_time": f"2026-06-1{i} 10:00:00", "amount": float(10 * (i + 1))} for i in range(4)])
    asked = {"a": (1, None, [1, 2]), "b": (2, None, [2, 3]), "c": (3, None, [3, 4]), "none": (0, None, [77, 78])}
    res, _, out = CMD.merge_apply(df, *merge_tables(spark, asked))
    assert {r.request_id: (r.ok, r["count"]) for r in res.collect()} == {"a": (True, 2), "b": (False, 1), "c": (True, 2), "none": (False, 0)}
    assert live_total(out) == D("100.00")
    offsets = {"x": (1, "offset", [1, 2]), "y": (2, None, [1, 2])}  # refused as an offset: the rows stay free
    res, _, out = CMD.merge_apply(df, *merge_tables(spark, offsets))
    assert {r.request_id: r.error for r in res.collect()} == {"x": "net is not zero: cannot offset", "y": None}
    assert live_total(out) == D("100.00")


def test_merges_with_and_without_overlap_agree(spark):
    """A request that overlaps nothing gets the same result, whichever way the others make the table go."""
    df = ledger(spark, [{"txn_time": f"2026-06-{i:02d} 10:00:00", "amount": float(i) * (-1 if i % 3 == 0 else 1), "merchant_raw": f"m{i}",
                         "direction": "refund" if i % 3 == 0 else "expense", "voided": i == 4, "note": "n" if i % 2 else None} for i in range(1, 13)])
    apart = {"a": (1, None, [2, 1, 1]), "b": (2, "offset", [3, 4]), "c": (3, None, [5, 6]), "d": (4, None, [])}
    both = {**apart, "x": (5, None, [10, 11]), "y": (6, None, [11, 12])}
    key = lambda df: sorted(map(str, df.collect()))
    res1, new1, out1 = CMD.merge_apply(df, *merge_tables(spark, apart), start_day=15)
    res2, new2, out2 = CMD.merge_apply(df, *merge_tables(spark, both), start_day=15)
    assert res1.columns == res2.columns or set(res1.columns) == set(res2.columns)
    cols = sorted(res1.columns)
    assert key(res1.select(cols)) == key(res2.filter(~F.col("request_id").isin("x", "y")).select(cols))
    fingerprints = [f"merge:{r}" for r in apart]
    assert key(new1) == key(new2.filter(F.col("fingerprint").isin(*fingerprints)))
    mine = F.col("id").between(1, 9)
    assert key(out1.filter(mine)) == key(out2.filter(mine))


def random_steps(rng, n_rows, n):
    rows, out = list(range(1, n_rows + 1)), []
    for k in range(n):
        request, at = f"r{k}", rng.choice(rows)
        kind = rng.choice(["split", "split", "merge", "void", "restore", "set_note"])
        if kind == "split":
            out.append(step(request, k, "split", at, amounts=[rng.randint(-3, 9), rng.randint(1, 9)] if rng.random() < 0.3 else [4, 6]))
            rows += [command_fold.hash_id("split", request, p) for p in (0, 1)]
        elif kind == "merge":
            members = rng.choices(rows, k=rng.randint(1, 4))
            out += [step(request, k, "merge", i, p, expected=rng.choice([None, None, "offset"])) for p, i in enumerate(members)]
            out = [s if s[0] != request else (*s[:10], out[-1][10]) for s in out]
            rows.append(command_fold.hash_id("merge", request))
        else:
            out.append(step(request, k, kind, at, payload=f"n{k}" if kind == "set_note" else None))
    return out


def test_components_equal_one_sequence(spark):
    """Rows as left by taking every step of the table one after the other in plain Python."""
    for seed in range(4):
        rng = random.Random(seed)
        df = ledger(spark, [{"txn_time": f"2026-06-{1 + i % 28:02d} 10:00:00", "amount": 10.0} for i in range(30)])
        steps = random_steps(rng, 30, 40)
        fold = command_fold.Fold(df.columns, 1)
        fold.rows = {r.id: r.asDict() for r in df.collect()}
        told = {}
        for request in dict.fromkeys(s[0] for s in steps):
            mine = [s for s in steps if s[0] == request]
            _, _, op, row, _, payload, amounts, *_ = mine[0]
            if op == "split":
                told[request] = fold.split(request, row, amounts)["error"]
            elif op == "merge":
                head = {"expected_operation": mine[0][10], "category": None, "month": None, "note": None}
                told[request] = fold.merge(request, [(s[4], s[3]) for s in mine], head).get("error")
            else:
                fold.edit(op, row, payload)
        out, splits, merges = CMD.apply_command_table(df, spark.createDataFrame(rng.sample(steps, len(steps)), SCHEMA), repair=False)
        assert {r.request_id: r.error for r in splits.select("request_id", "error").unionByName(merges.select("request_id", "error")).collect()} == told
        columns = ["id", "amount", "voided", "note", "merged_into", "direction", "effective_month", "txn_time", "fingerprint"]
        got = {r.id: tuple(r[c] for c in columns) for r in out.collect()}
        assert got == {i: tuple(r[c] for c in columns) for i, r in fold.rows.items()}


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(f"r{i}", i + d) for i in range(40) for d in (0, 1)] + [("z", 100), ("z", 102)], "request_id string, id bigint")
    got = {r.id: r.component for r in command_fold.components(pairs).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 102: 100}


def test_a_command_table_takes_few_jobs(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 10.0, "merchant_key": f"m{i}"} for i in range(20)])
    kid = command_fold.hash_id("split", "s1", 1)
    steps = [step(f"e{i}", i, "set_note", 1, payload=f"n{i}") for i in range(80)]
    steps += [step("v", 100, "void", 2), step("s0", 101, "split", 2, amounts=[4, 6]), step("s1", 102, "split", 3, amounts=[4, 6]),
              step("s2", 103, "split", kid, amounts=[1, 5]), step("m", 104, "merge", 4), step("m", 104, "merge", kid, 1), step("m", 104, "merge", 5, 2)]
    table = spark.createDataFrame(steps, SCHEMA)
    group = "count-jobs-of-a-command-table"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out, splits, merges = CMD.apply_command_table(df, table, repair=False)
        assert {r.request_id: r.error for r in splits.collect()} == {"s0": "voided", "s1": None, "s2": None}
        assert [(r.ok, r["count"]) for r in merges.collect()] == [(True, 2)]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.filter("id = 1").first()["note"] == "n79"  # a row that no split or merge touches: the last edit stands
    assert jobs <= 20, jobs
