"""Void/restore, merge, split and edits (golden rows + quirks)."""
from pyspark.sql import functions as F

from tests_support import ledger
from tallyframe.operators import commands as CMD
from tallyframe.operators import matching, reports


def _spend(df):
    return reports.summary(df).first()["spend"]


def test_void_then_restore(spark):
    df = ledger(spark, [{"txn_time": "2026-07-01 10:00:00", "amount": 100.0},
                        {"txn_time": "2026-07-02 10:00:00", "amount": 200.0}])
    assert _spend(df) == 300.0
    c = spark.createDataFrame([(2, 1, "void", None)], "txn_id bigint, seq bigint, op string, payload string")
    v = CMD.apply_edits(df, c)
    assert _spend(v) == 100.0
    c2 = spark.createDataFrame([(2, 1, "void", None), (2, 2, "restore", None)],
                               "txn_id bigint, seq bigint, op string, payload string")
    assert _spend(CMD.apply_edits(df, c2)) == 300.0


def test_edits_last_writer_wins(spark):
    df = ledger(spark, [{"txn_time": "2026-07-01 10:00:00", "amount": 1.0}])
    c = spark.createDataFrame([(1, 2, "set_category", "b"), (1, 1, "set_category", "a"), (1, 3, "set_note", "x")],
                              "txn_id bigint, seq bigint, op string, payload string")
    r = CMD.apply_edits(df, c).first()
    assert (r["category"], r["category_src"], r["status"], r["note"]) == ("b", "manual", "confirmed", "x")


def _merge(spark, df, ids, **kw):
    mi = spark.createDataFrame([(1, p, i) for p, i in enumerate(ids)], "request_id bigint, pos bigint, id bigint")
    mr = spark.createDataFrame([(1, kw.get("category"), None, kw.get("month"), kw.get("expected"))],
                               "request_id bigint, category string, note string, month string, "
                               "expected_operation string")
    return CMD.merge_apply(df, mi, mr, start_day=kw.get("start_day", 1))


def test_merge_net_and_month_day15(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 300.0},
                        {"txn_time": "2026-07-20 10:00:00", "amount": -120.0, "direction": "refund"}])
    res, rows, new = _merge(spark, df, [1, 2], start_day=15)
    r = res.first()
    assert (r["ok"], r["net"], r["month"], r["count"]) == (True, 180.0, "2026-05", 2)
    n = rows.first()
    assert n["direction"] == "expense" and n["status"] == "pending" and float(n["amount"]) == 180.0
    assert new.filter(~F.col("voided")).count() == 1
    assert new.filter(F.col("merged_into").isNotNull()).count() == 2


def test_offset_refused_when_net_not_zero(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 100.0},
                        {"txn_time": "2026-06-11 10:00:00", "amount": -40.0, "direction": "refund"}])
    res, _, new = _merge(spark, df, [1, 2], expected="offset")
    assert res.first()["ok"] is False
    # rejected requests change nothing
    assert new.filter(~F.col("voided")).count() == 2


def test_merge_exact_offset_voids_all(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 100.0},
                        {"txn_time": "2026-06-11 10:00:00", "amount": -100.0, "direction": "refund"}])
    res, rows, new = _merge(spark, df, [1, 2])
    assert res.first()["offset"] is True and rows.count() == 0
    assert new.filter(~F.col("voided")).count() == 0


def test_merge_keeps_duplicate_ids_and_drops_voided(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 10.0},
                        {"txn_time": "2026-06-11 10:00:00", "amount": 5.0},
                        {"txn_time": "2026-06-12 10:00:00", "amount": 7.0, "voided": True}])
    res, _, _ = _merge(spark, df, [1, 1, 2, 3])
    r = res.first()
    assert (r["count"], r["net"]) == (3, 25.0)


def test_split_children_and_pairing(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 100.0, "merchant_key": "s"},
                        {"txn_time": "2026-06-12 10:00:00", "amount": -30.0, "direction": "refund",
                         "merchant_key": "s"}])
    sp = spark.createDataFrame([(1, 1, [30.0, 70.0])], "request_id bigint, txn_id bigint, amounts array<double>")
    res, kids, new = CMD.split_apply(df, sp)
    assert res.first()["ok"] is True
    k = sorted((r["fingerprint"], float(r["amount"])) for r in kids.collect())
    assert k == [("fp1#s0", 30.0), ("fp1#s1", 70.0)]
    pairs = matching.refund_pairs(new).collect()
    assert len(pairs) == 1 and pairs[0]["refund_id"] == 2


def test_split_rejects_bad_sum_and_voided(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 100.0},
                        {"txn_time": "2026-06-10 11:00:00", "amount": 50.0, "voided": True}])
    sp = spark.createDataFrame([(1, 1, [30.0, 60.0]), (2, 2, [25.0, 25.0]), (3, 1, [100.0])],
                               "request_id bigint, txn_id bigint, amounts array<double>")
    res, _, _ = CMD.split_apply(df, sp)
    got = {r["request_id"]: r["error"] for r in res.collect()}
    assert got == {1: "parts do not sum", 2: "voided", 3: "need at least two parts"}


def test_category_delete_blocked_by_live_rows(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10", "amount": 1.0, "category": "a"},
                        {"txn_time": "2026-06-10", "amount": 1.0, "category": "b", "voided": True}])
    cats = spark.createDataFrame([("a", "ka", "", 1, 0), ("b", "kb", "", 1, 1)],
                                 "name string, key string, descr string, active int, sort int")
    kn = spark.createDataFrame([(1, "global", None, "t", "b")],
                               "id bigint, scope string, merchant_key string, text string, category string")
    keys = spark.createDataFrame([("ka",), ("kb",)], "key string")
    res, led, kn2, cats2 = CMD.category_delete(df, kn, cats, keys)
    ok = {r["key"]: (r["ok"], r["live_n"]) for r in res.collect()}
    assert ok == {"ka": (False, 1), "kb": (True, 0)}
    assert led.filter(F.col("category") == "b").count() == 0
    assert kn2.first()["category"] is None
    assert [r["key"] for r in cats2.collect()] == ["ka"]


CMD_SCHEMA = ("request_id string, seq int, op string, row_id bigint, pos bigint, payload string, "
              "amounts array<decimal(18,2)>, category string, note string, month string, expected_operation string")


def ids_of(spark, request, n=1):
    df = spark.createDataFrame([(request, i) for i in range(n)], "r string, p int")
    return ([r[0] for r in df.orderBy("p").select(CMD.child_id(F.col("r"), F.col("p"))).collect()],
            df.select(CMD.merged_row_id(F.col("r"))).first()[0])


def command(request, seq, op, row, pos=0, payload=None, amounts=None, category=None, note=None, month=None, expected=None):
    from decimal import Decimal as D
    return (request, seq, op, row, pos, payload, [D(str(a)) for a in amounts] if amounts else None, category, note, month, expected)


def test_command_table_orders_derived_rows_after_their_creation(spark):
    df = ledger(spark, [{"txn_time": "2026-07-01 10:00:00", "amount": 100.0},
                        {"txn_time": "2026-07-02 10:00:00", "amount": 50.0},
                        {"txn_time": "2026-07-03 10:00:00", "amount": 30.0}])
    child = ids_of(spark, "a", 2)[0][1]
    merged = ids_of(spark, "b")[1]
    rows = [command("c", 3, "set_category", child, payload="kid"), command("a", 1, "split", 1, amounts=[40, 60]),
            command("b", 2, "merge", 2, 0, category="x"), command("b", 2, "merge", 3, 1, category="x"),
            command("d", 4, "void", merged), command("e", 5, "set_note", 1, payload="parent note"),
            command("early", 0, "set_category", child, payload="too early"), command("none", 9, "void", 12345)]
    out, sres, mres = CMD.apply_command_table(df, spark.createDataFrame(rows, CMD_SCHEMA))
    got = {r["id"]: r for r in out.collect()}
    assert got[child]["category"] == "kid" and float(got[child]["amount"]) == 60.0
    assert got[merged]["voided"] is True and float(got[merged]["amount"]) == 80.0
    assert got[1]["voided"] is True and got[1]["note"] == "parent note" and len(got) == 6
    assert [r["ok"] for r in sres.collect()] == [True] and [r["ok"] for r in mres.collect()] == [True]


def test_command_table_without_caps(spark):
    big, low = 10 ** 17 + 3, -5
    df = ledger(spark, [{"txn_time": "2026-07-01 10:00:00", "amount": 121.0},
                        {"txn_time": "2026-07-02 10:00:00", "amount": 120.0, "merchant_key": "n"},
                        {"id": big, "txn_time": "2026-07-03 10:00:00", "amount": 8.0},
                        {"id": low, "txn_time": "2026-07-04 10:00:00", "amount": 4.0}])
    kids, _ = ids_of(spark, "s1", 120)
    grand, _ = ids_of(spark, "s3", 2)
    rows = [command(f"e{i}", 10 + i, "set_category", 1, payload=f"c{i}") for i in range(90)]
    rows += [command(f"v{i}", 10 + i, "void" if i % 2 else "restore", low) for i in range(70)]
    rows += [command("s1", 1, "split", 2, amounts=[1] * 120), command("s2", 2, "split", 2, amounts=[60, 60]),
             command("s3", 3, "split", kids[7], amounts=[0.4, 0.6]), command("m", 4, "merge", grand[0], 0),
             command("m", 4, "merge", big, 1)]
    out, sres, mres = CMD.apply_command_table(df, spark.createDataFrame(rows, CMD_SCHEMA))
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == out.count() == 4 + 120 + 2 + 1
    assert got[1]["category"] == "c89" and got[low]["voided"] is True
    assert {r["request_id"]: r["error"] for r in sres.collect()} == {"s1": None, "s2": "voided", "s3": None}
    assert got[kids[7]]["voided"] and got[grand[0]]["voided"] and not got[grand[1]]["voided"]
    assert got[big]["merged_into"] == ids_of(spark, "m")[1] == got[grand[0]]["merged_into"]
    assert float(got[ids_of(spark, "m")[1]]["amount"]) == 8.4
    live = sum(float(r["amount"]) for r in got.values() if not r["voided"])
    assert round(live, 2) == 121.0 + 119.0 + 0.6 + 8.4 and mres.first()["ok"]


def test_notes_and_restores_keep_their_place(spark):
    df = ledger(spark, [{"txn_time": "2026-07-01 10:00:00", "amount": 10.0, "note": "old"},
                        {"txn_time": "2026-07-02 10:00:00", "amount": 20.0}])
    rows = [command("n", 1, "set_note", 1, payload="mine"), command("v", 2, "void", 1),
            command("bad", 3, "split", 1, amounts=[5, 5]), command("r", 4, "restore", 1),
            command("good", 5, "split", 1, amounts=[4, 6]), command("w", 6, "void", 2), command("x", 7, "restore", 2)]
    out, sres, _ = CMD.apply_command_table(df, spark.createDataFrame(rows, CMD_SCHEMA))
    assert {r["request_id"]: r["error"] for r in sres.collect()} == {"bad": "voided", "good": None}
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["note"] == "mine [已拆分]" and got[1]["voided"] and not got[2]["voided"]


def test_table_pairs_again_after_a_split(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 100.0, "merchant_key": "s"},
                        {"txn_time": "2026-06-12 10:00:00", "amount": -30.0, "direction": "refund", "merchant_key": "s"}])
    out, _, _ = CMD.apply_command_table(df, spark.createDataFrame([command("a", 1, "split", 1, amounts=[30, 70])], CMD_SCHEMA))
    got = {r["id"]: r for r in out.collect()}
    kid = ids_of(spark, "a", 2)[0][0]
    assert got[2]["voided"] and got[2]["offset_of"] == kid and got[kid]["offset_of"] == 2


def test_first_split_of_one_parent_wins(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 100.0}])
    sp = spark.createDataFrame([(1, 9, 1, [30.0, 70.0]), (2, 3, 1, [50.0, 50.0])],
                               "request_id bigint, seq bigint, txn_id bigint, amounts array<double>")
    res, kids, new = CMD.split_apply(df, sp)
    assert {r["request_id"]: r["error"] for r in res.collect()} == {1: "voided", 2: None}
    assert new.count() == 3 and kids.count() == 2


def test_empty_command_table(spark):
    df = ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": 100.0}])
    out, sres, mres = CMD.apply_command_table(df, spark.createDataFrame([], CMD_SCHEMA))
    assert out.count() == 1 and sres.count() == mres.count() == 0
