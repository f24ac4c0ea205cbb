"""Small ledgers that several tests use."""
import datetime as dt
from decimal import Decimal

from tallyframe.fixtures import LEDGER_COLUMNS

LEDGER_SCHEMA = (
    "id bigint, fingerprint string, source_msg_id string, card_last4 string, card_type string, "
    "txn_time timestamp_ntz, amount decimal(18,2), currency string, direction string, action string, "
    "merchant_raw string, merchant_key string, channel string, balance decimal(18,2), "
    "avail_credit decimal(18,2), points bigint, category string, category_src string, status string, "
    "notify_status string, notified_at timestamp_ntz, voided boolean, offset_of bigint, "
    "effective_month string, merged_into bigint, note string")


def ts(text: str) -> dt.datetime:
    fmt = "%Y-%m-%d %H:%M:%S" if len(text) > 16 else ("%Y-%m-%d %H:%M" if len(text) > 10 else "%Y-%m-%d")
    return dt.datetime.strptime(text, fmt)


def ledger(spark, rows):
    """Build a ledger DataFrame from partial dicts (defaults for the rest)."""
    full = []
    for i, r in enumerate(rows, 1):
        d = {c: None for c in LEDGER_COLUMNS}
        d.update({"id": i, "fingerprint": f"fp{i}", "card_last4": "1234", "card_type": "credit",
                  "currency": "CNY", "direction": "expense", "action": "消费", "merchant_raw": "m",
                  "merchant_key": "m", "status": "pending", "voided": False})
        d.update(r)
        if isinstance(d["txn_time"], str):
            d["txn_time"] = ts(d["txn_time"])
        if d["amount"] is not None:
            d["amount"] = Decimal(str(d["amount"])).quantize(Decimal("0.01"))
        full.append(tuple(d[c] for c in LEDGER_COLUMNS))
    return spark.createDataFrame(full, LEDGER_SCHEMA)


def advice_ledger(spark, n=5):
    """Rows 1..n, live and pending, each with a merchant of its own."""
    return ledger(spark, [{"txn_time": "2026-06-10 10:00:00", "amount": float(i), "merchant_key": f"m{i}"} for i in range(1, n + 1)])
