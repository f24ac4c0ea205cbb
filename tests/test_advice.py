"""Advice lookup, validation and merchant-level updates; deposits; notify."""
from pyspark.sql import functions as F

from tests_support import ledger
from tallyframe.operators import advice as ADV
from tallyframe.operators import listing, notify
from tallyframe.sources import ingest

ADV_SCHEMA = ("batch_id bigint, adv_key string, pos bigint, category string, operation string, "
              "related_ids array<bigint>, reason string")
CATS = [("餐饮", "k1", "", 1, 0), ("旧", "k2", "", 0, 1)]


def _cats(spark):
    return spark.createDataFrame(CATS, "name string, key string, descr string, active int, sort int")


def test_prefix_lookup_prefers_exact_then_position(spark):
    m = spark.createDataFrame([("shop", 0), ("cafe", 0), ("bar", 0)], "merchant_key string, batch_id bigint")
    a = spark.createDataFrame([(0, "shop (3笔)", 0, "x", "none", [], ""), (0, "shop", 1, "y", "none", [], ""),
                               (0, "caf", 2, "z", "none", [], ""), (0, "cafe 1", 3, "w", "none", [], "")], ADV_SCHEMA)
    got = {r["merchant_key"]: r["category"] for r in ADV.advice_pick(m, a).collect()}
    assert got == {"shop": "y", "cafe": "z", "bar": None}


def test_invalid_operation_keeps_category_and_stores_nothing(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01 10:00:00", "amount": 10.0, "merchant_key": "s"}])
    m = spark.createDataFrame([("s", 0)], "merchant_key string, batch_id bigint")
    a = spark.createDataFrame([(0, "s", 0, "餐饮", "delete", [1], "r")], ADV_SCHEMA)
    out, counters = ADV.classify_apply(df, m, a, _cats(spark))
    r = out.first()
    assert (r["category"], r["status"], r["category_src"]) == ("餐饮", "suggested", "hermes")
    assert tuple(counters.first()) == (1, 1, 0)
    picked = ADV.advice_pick(m, a)
    empty = spark.createDataFrame([], "transaction_id bigint, operation string, related_transaction_ids string, "
                                      "reason string")
    new, bad = ADV.suggestion_upsert(empty, ADV.suggestion_requests(picked, df), df)
    assert new.count() == 0 and bad.count() == 0


def test_uncertain_clears_only_suggested_rows(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01", "amount": 1.0, "merchant_key": "s", "status": "suggested",
                         "category": "餐饮"},
                        {"txn_time": "2026-01-02", "amount": 1.0, "merchant_key": "s", "status": "confirmed",
                         "category": "餐饮"}])
    m = spark.createDataFrame([("s", 0)], "merchant_key string, batch_id bigint")
    a = spark.createDataFrame([(0, "s", 0, "旧", "none", [], "")], ADV_SCHEMA)
    out, _ = ADV.classify_apply(df, m, a, _cats(spark))
    got = sorted((r["status"], r["category"]) for r in out.collect())
    assert got == [("confirmed", "餐饮"), ("pending", None)]


def test_suggestion_upsert_validates_live_ids(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01", "amount": 1.0},
                        {"txn_time": "2026-01-02", "amount": 1.0},
                        {"txn_time": "2026-01-03", "amount": 1.0, "voided": True}])
    req = spark.createDataFrame([(1, "merge", [2, 2], " why "), (2, "void", [3], "x")],
                                "transaction_id bigint, operation string, related_ids array<bigint>, reason string")
    empty = spark.createDataFrame([], "transaction_id bigint, operation string, related_transaction_ids string, "
                                      "reason string")
    new, bad = ADV.suggestion_upsert(empty, req, df)
    assert [tuple(r) for r in new.collect()] == [(1, "merge", "[1, 2]", "why")]
    assert [r["transaction_id"] for r in bad.collect()] == [2]


def test_deposit_dedup_and_amount_filter(spark):
    d = spark.createDataFrame([(1, "s1", "2026-01-01 10:00", 30.0, 0), (2, "s1", "2026-01-01 10:00", 30.0, 1),
                               (3, "s2", "2026-01-02 10:00", 45.5, 2)],
                              "id bigint, source_msg_id string, t string, amount double, arrival int") \
        .select("id", "source_msg_id", F.col("t").cast("timestamp_ntz").alias("txn_time"),
                F.col("amount").cast("decimal(18,2)").alias("amount"), "arrival",
                F.lit(None).cast("string").alias("card_last4"), F.lit(None).cast("string").alias("kind"),
                F.lit(None).cast("string").alias("payer"), F.lit(None).cast("string").alias("note"))
    ins = ingest.deposit_insert_ignore(d.limit(0), d)
    assert sorted(r["id"] for r in ins.collect()) == [1, 3]
    assert listing.deposit_list(ins, amount=45.5).count() == 1


def test_notify_digest_prints_advice_once(spark):
    df = ledger(spark, [{"txn_time": "2026-01-01 10:00:00", "amount": 10.0, "category": "a", "status": "suggested"},
                        {"txn_time": "2026-01-01 11:00:00", "amount": 20.0, "status": "confirmed"}])
    sug = spark.createDataFrame([(1, "merge", "[1, 2]", "same trip"), (2, "merge", "[1, 2]", "same trip")],
                                "transaction_id bigint, operation string, related_transaction_ids string, "
                                "reason string")
    lines = notify.notify_digest(notify.notify_queue(df, sug)).orderBy("txn_time", "id", "sub").collect()
    texts = [r["line"] for r in lines]
    assert texts[0] == " #1 ¥10.00 m → a（AI建议，请确认）"
    assert sum("💡" in t for t in texts) == 1 and texts[1].startswith("   💡 建议合并 #1 #2：same trip")
    assert texts[-1] == " #2 ¥20.00 m → ❓待分类"


def test_advice_upsert_takes_the_last_valid_request(spark):
    from tests_support import advice_ledger
    led = advice_ledger(spark)
    have = spark.createDataFrame([(1, "void", "[1]", "old", 111), (2, "void", "[2]", "old", 222), (3, "void", "[3]", "old", 333)],
                                 "transaction_id bigint, operation string, related_transaction_ids string, reason string, created_at bigint")
    req = spark.createDataFrame(
        [(1, 1, "split", [1], "a"), (1, 2, "merge", [2], " b "), (2, 5, "none", [], ""), (2, 4, "merge", [1], "c"),
         (3, 1, "bogus", [3], "d"), (4, 1, "none", [], ""), (4, 2, "offset", [1, 4, 1], "e"), (1, 3, "merge", [99], "gone")],
        "transaction_id bigint, seq int, operation string, related_ids array<bigint>, reason string")
    new, bad = ADV.suggestion_upsert(have, req, led, now="999")
    got = {r["transaction_id"]: tuple(r)[1:] for r in new.collect()}
    assert got == {1: ("merge", "[1, 2]", "b", 111), 3: ("void", "[3]", "old", 333), 4: ("offset", "[1, 4]", "e", 999)}
    assert {(r["transaction_id"], r["error"]) for r in bad.collect()} == {(3, "invalid operation"), (1, "transaction not found or voided")}


def test_classification_batches_are_bounded(spark):
    from tallyframe.operators import classify
    from tests_support import advice_ledger
    led = advice_ledger(spark, 500)
    for size in (1, 7, 40):
        rows = classify.classification_batches(led, size).groupBy("batch_id").count().collect()
        assert max(r["count"] for r in rows) <= size and sum(r["count"] for r in rows) == 500


def test_amount_hints(spark):
    from tests_support import advice_ledger
    led = advice_ledger(spark, 6).union(advice_ledger(spark, 2))
    hints = {r["merchant_key"]: r["hint"] for r in ADV.amount_hints(led).collect()}
    assert hints["m1"] == "2笔，金额固定1.00" and hints["m5"] == "1笔，金额固定5.00"
