"""SQL functions and the pluggable classifier."""
import pandas as pd
from pyspark.sql import functions as F

from tests_support import ledger
from tallyframe.functions.sql import register_sql_functions
from tallyframe.operators import advice as ADV
from tallyframe.operators import classify


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT billing_period(TIMESTAMP_NTZ'2027-01-10 00:00:00', 15) AS a, "
                  "attribution_month('2020-01', TIMESTAMP_NTZ'2027-01-10 00:00:00', 15) AS b, "
                  "clamp_start_day('31') AS c, clamp_start_day('nope') AS d, is_spend('fee') AS e").first()
    assert tuple(r) == ("2026-12", "2020-01", 28, 1, True)


def test_classifier_batches_and_apply(spark):
    rows = [{"txn_time": f"2026-01-{d:02d} 10:00:00", "amount": 10.0 + d, "merchant_key": f"m{d % 7}"}
            for d in range(1, 29)]
    df = ledger(spark, rows)
    batches = classify.classification_batches(df, batch_size=3)
    assert batches.select("batch_id").distinct().count() <= 3

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        assert pdf.groupby("merchant_key").size().max() <= 20
        ms = sorted(pdf["merchant_key"].unique())
        return pd.DataFrame({"adv_key": ms, "category": ["餐饮" if m != "m3" else "??" for m in ms],
                             "operation": ["none"] * len(ms), "related_ids": [[] for _ in ms],
                             "reason": [""] * len(ms)})

    adv = classify.run_classifier(df, batches, fn)
    cats = spark.createDataFrame([("餐饮", "k1", "", 1, 0)], "name string, key string, descr string, active int, sort int")
    out, counters = ADV.classify_apply(df, batches, adv, cats)
    assert tuple(counters.first()) == (7, 6, 1)
    assert out.filter(F.col("status") == "suggested").count() == 24


def test_alert_interpreter_feeds_normaliser(spark):
    from tallyframe.operators import extract
    mails = spark.createDataFrame([("a1", "工资到账 8000.00 元"), ("a2", "验证码 1234")],
                                  "source_msg_id string, text string") \
        .withColumn("received", F.lit("2026-06-19 08:07:06").cast("timestamp_ntz"))

    def fn(pdf: pd.DataFrame) -> pd.Series:
        return pdf["text"].map(lambda t: '{"type": "income", "amount": 8000}' if "工资" in t
                               else 'noise {"type": "ignore"} noise')

    replies = classify.interpret_alerts(mails, fn)
    norm = extract.alert_normalise(replies).collect()
    assert [(r["source_msg_id"], r["type"], r["amount"]) for r in norm] == [("a1", "income", 8000.0)]
