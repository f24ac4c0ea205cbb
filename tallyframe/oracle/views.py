"""DuckDB SQL of the fixture views in ``tallyframe.fixtures``.

Oracle queries are self-contained ANSI SQL over the driver tables; the views
below are prepended as CTEs by :func:`with_views`. They are written
independently of the Spark code and are the check on it.
"""
from __future__ import annotations

FP = ("sha1(concat_ws('|', coalesce(card_last4, 'None'), "
      "coalesce(strftime(txn_time, '%Y-%m-%d %H:%M:%S'), 'None'), "
      "coalesce(CAST(amount AS VARCHAR), 'None'), coalesce(merchant_raw, 'None'), "
      "coalesce(action, 'None')))")

LEDGER_TAIL = (
    "'CNY' AS currency, direction, action, merchant_raw, merchant_key, channel, "
    "CAST(NULL AS DECIMAL(18,2)) AS balance, CAST(NULL AS DECIMAL(18,2)) AS avail_credit, "
    "CAST(NULL AS BIGINT) AS points, category, CAST(NULL AS VARCHAR) AS category_src, status, "
    "notify_status, CAST(NULL AS TIMESTAMP) AS notified_at, voided, CAST(NULL AS BIGINT) AS offset_of, "
    "effective_month, CAST(NULL AS BIGINT) AS merged_into, CAST(NULL AS VARCHAR) AS note"
)

VIEWS: dict[str, tuple[list[str], str]] = {}

VIEWS["ev_k"] = ([], """
SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")

VIEWS["ledger_e0"] = (["ev_k"], """
SELECT event_id AS id, 'm' || CAST(event_id AS VARCHAR) AS source_msg_id,
  lpad(CAST(user_id % 50 AS VARCHAR), 4, '0') AS card_last4,
  CASE WHEN user_id % 2 = 0 THEN 'credit' ELSE 'debit' END AS card_type,
  ts AS txn_time,
  CAST((CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)
       * ((CAST(floor(value / 10) AS INTEGER) + 1) * 10) AS DECIMAL(18,2)) AS amount,
  CASE event_type WHEN 'purchase' THEN 'expense' WHEN 'error' THEN 'refund' WHEN 'click' THEN 'fee'
       WHEN 'view' THEN 'repayment' WHEN 'signup' THEN 'income' END AS direction,
  CASE event_type WHEN 'purchase' THEN '消费' WHEN 'error' THEN '退货' WHEN 'click' THEN '手续费'
       WHEN 'view' THEN '还款' WHEN 'signup' THEN '工资' END AS action,
  CASE k % 4 WHEN 0 THEN '支付宝' WHEN 1 THEN '财付通' WHEN 2 THEN '银联' END AS channel,
  'shop' || CAST(k % 10 AS VARCHAR) AS merchant_key,
  CASE WHEN k % 4 = 3 THEN 'shop' || CAST(k % 10 AS VARCHAR)
       ELSE (CASE k % 4 WHEN 0 THEN '支付宝' WHEN 1 THEN '财付通' WHEN 2 THEN '银联' END)
            || '-shop' || CAST(k % 10 AS VARCHAR) END AS merchant_raw,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 'cat' || CAST(k % 5 AS VARCHAR) END AS category,
  CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'suggested' ELSE 'confirmed' END AS status,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'sent' END AS notify_status,
  (event_id % 17 = 0) AS voided,
  CASE WHEN event_id % 23 = 0 THEN '2023-12' END AS effective_month
FROM ev_k
""")

VIEWS["ledger_e"] = (["ledger_e0"], f"""
SELECT id, {FP} AS fingerprint, source_msg_id, card_last4, card_type, txn_time, amount, {LEDGER_TAIL}
FROM ledger_e0
""")

VIEWS["ledger_o0"] = ([], """
SELECT o_orderkey AS id, 'o' || CAST(o_orderkey AS VARCHAR) AS source_msg_id,
  lpad(CAST(o_custkey % 20 AS VARCHAR), 4, '0') AS card_last4,
  CASE WHEN o_custkey % 2 = 0 THEN 'credit' ELSE 'debit' END AS card_type,
  o_orderdate AS txn_time,
  CASE WHEN o_orderkey % 9 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2))
       ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
  CASE o_orderkey % 9 WHEN 0 THEN 'refund' WHEN 1 THEN 'fee' WHEN 2 THEN 'withdraw'
       WHEN 3 THEN 'repayment' WHEN 4 THEN 'transfer' ELSE 'expense' END AS direction,
  CASE o_orderkey % 9 WHEN 0 THEN '退货' WHEN 1 THEN '手续费' WHEN 2 THEN '取现'
       WHEN 3 THEN '还款' WHEN 4 THEN '转账' ELSE '消费' END AS action,
  CAST(NULL AS VARCHAR) AS channel,
  'shop' || CAST(o_custkey % 11 AS VARCHAR) AS merchant_key,
  'shop' || CAST(o_custkey % 11 AS VARCHAR) AS merchant_raw,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS category,
  CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'suggested' WHEN 'F' THEN 'confirmed' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'sent' END AS notify_status,
  (o_orderkey % 19 = 0) AS voided,
  CASE WHEN o_orderkey % 29 = 0 THEN '1999-06' END AS effective_month
FROM orders
""")

VIEWS["ledger_o"] = (["ledger_o0"], f"""
SELECT id, {FP} AS fingerprint, source_msg_id, card_last4, card_type, txn_time, amount, {LEDGER_TAIL}
FROM ledger_o0
""")

VIEWS["deposits_e"] = (["ev_k"], """
SELECT event_id AS id, 'd' || CAST(event_id AS VARCHAR) AS source_msg_id,
  lpad(CAST(user_id % 50 AS VARCHAR), 4, '0') AS card_last4, ts AS txn_time,
  CAST((CAST(floor(value / 10) AS INTEGER) + 1) * 10 AS DECIMAL(18,2)) AS amount,
  (['工资', '报销', '汇款', '理财赎回', '分红', '利息', '退款', '其他'])[CAST(k % 8 + 1 AS INTEGER)] AS kind,
  'payer' || CAST(user_id AS VARCHAR) AS payer, CAST(NULL AS VARCHAR) AS note,
  'alert ' || CAST(event_id AS VARCHAR) AS raw_text
FROM ev_k WHERE event_type = 'signup'
""")

VIEWS["mails_e"] = (["ev_k"], """
SELECT event_id AS uid,
  'm' || CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS VARCHAR) AS msg_id,
  ts AS received,
  CASE event_type WHEN 'purchase' THEN '招商银行信用卡 <ccsvc@message.cmbchina.com>'
       WHEN 'error' THEN 'CCSVC@message.cmbchina.com' WHEN 'click' THEN '95555@message.cmbchina.com'
       WHEN 'view' THEN 'promo@shop.example.com' WHEN 'signup' THEN 'hk@cmbchina.com' END AS sender,
  CASE WHEN event_type = 'click' AND k % 3 = 0 THEN '香港一卡通账户变动通知'
       ELSE CASE event_type WHEN 'purchase' THEN '每日信用管家' WHEN 'error' THEN '招商银行信用卡电子账单'
            WHEN 'click' THEN '一卡通账户变动通知' WHEN 'view' THEN '会员优惠礼包'
            WHEN 'signup' THEN '一卡通月結單' END END AS subject,
  user_id, k
FROM ev_k
""")

# Mail type as the router assigns it for the senders/subjects above.
ROUTER_CASE = """CASE
  WHEN contains(lower(coalesce(sender, '')), 'ccsvc@message.cmbchina.com') AND contains(coalesce(subject, ''), '每日信用管家') THEN 'credit_daily'
  WHEN contains(lower(coalesce(sender, '')), 'ccsvc@message.cmbchina.com') AND (contains(coalesce(subject, ''), '账单') OR contains(coalesce(subject, ''), '帳單')) THEN 'credit_statement'
  WHEN contains(lower(coalesce(sender, '')), 'ccsvc@message.cmbchina.com') THEN 'other'
  WHEN contains(lower(coalesce(sender, '')), '95555@message.cmbchina.com') AND contains(coalesce(subject, ''), '账户变动') AND NOT contains(coalesce(subject, ''), '香港') THEN 'debit_event'
  WHEN contains(lower(coalesce(sender, '')), '95555@message.cmbchina.com') THEN 'other'
  WHEN contains(lower(coalesce(sender, '')), 'cmbchina') AND (contains(coalesce(subject, ''), '月結單') OR contains(coalesce(subject, ''), '月结单')) THEN 'hk_statement'
  WHEN contains(lower(coalesce(sender, '')), 'cmbchina') AND (contains(coalesce(subject, ''), '账单') OR contains(coalesce(subject, ''), '帳單')) THEN 'credit_statement'
  WHEN contains(coalesce(subject, ''), '拒收') OR contains(coalesce(subject, ''), '退订') OR contains(coalesce(subject, ''), '优惠')
    OR contains(coalesce(subject, ''), '分期') OR contains(coalesce(subject, ''), '额度') OR contains(coalesce(subject, ''), '礼包') THEN 'marketing'
  ELSE 'other' END"""

VIEWS["mails_typed"] = (["mails_e"], f"SELECT *, {ROUTER_CASE} AS email_type FROM mails_e")


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first, each once)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH RECURSIVE {ctes},\n{body[4:].lstrip()}"
    return f"WITH RECURSIVE {ctes}\n{body}"

# White space as Python's str.isspace() sees it (RE2 syntax).
WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


VIEWS["text_inputs"] = (["ev_k"], """
SELECT event_id, ts, k,
  (['消费', '退货', '手续费', '还款', '工资', '消费', '取现', '预借现金', '自助转账', '结息', '分期', '未知'])[CAST(event_id % 12 + 1 AS INTEGER)] AS action,
  CASE WHEN k % 7 = 0 THEN '支付宝-  '
       ELSE (['支付宝-', '微信 - ', '银联-', 'Apple-', '', '财付通-'])[CAST(k % 6 + 1 AS INTEGER)]
            || 'Shop ' || CAST(k % 10 AS VARCHAR) || ' ' END AS merchant_raw,
  CASE WHEN k % 9 = 0 THEN 'n/a'
       ELSE CAST(user_id AS VARCHAR) || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '.'
            || lpad(CAST(k % 100 AS VARCHAR), 2, '0') END AS amount_text
FROM ev_k
""")

VIEWS["digest_src"] = (["ledger_e"], """
SELECT l.*, e.user_id, CAST(l.txn_time AS DATE) AS digest_date,
  CAST(floor((row_number() OVER (PARTITION BY e.user_id, CAST(l.txn_time AS DATE)
                                  ORDER BY l.txn_time, l.id) - 1) / 40) AS BIGINT) AS part
FROM ledger_e l JOIN events e ON e.event_id = l.id
WHERE l.direction IN ('expense', 'refund')
""")

VIEWS["alert_src"] = (["ev_k"], """
SELECT 'a' || CAST(event_id AS VARCHAR) AS source_msg_id, event_id, ts AS received,
  CASE WHEN event_id % 7 = 3 THEN 'refund_maybe'
       ELSE CASE event_type WHEN 'purchase' THEN 'expense' WHEN 'view' THEN 'transfer_out'
            WHEN 'signup' THEN 'income' WHEN 'click' THEN 'ignore' WHEN 'error' THEN 'expense' END END AS type,
  lpad(CAST(user_id % 50 AS VARCHAR), 4, '0') AS card_last4,
  CASE WHEN event_type = 'error' THEN NULL WHEN k % 11 = 0 THEN 0.0 ELSE value END AS amount,
  strftime(ts, '%Y-%m-%d %H:%M') AS time,
  'cp' || CAST(k % 13 AS VARCHAR) AS counterparty,
  CASE k % 4 WHEN 0 THEN '支付宝' WHEN 1 THEN '微信' ELSE '' END AS channel,
  k
FROM ev_k
""")

VIEWS["alert_norm"] = (["alert_src"], """
SELECT source_msg_id, event_id, received,
  CASE WHEN type NOT IN ('expense', 'transfer_out', 'income', 'ignore') THEN 'invalid type'
       WHEN type <> 'ignore' AND amount IS NULL THEN 'missing amount' END AS error,
  type, card_last4, time AS txn_time, round(amount, 2) AS amount, counterparty, channel,
  CASE WHEN type = 'income' THEN (['工资', '报销', '汇款', '理财赎回', '分红', '利息', '退款', '其他'])[CAST(k % 8 + 1 AS INTEGER)]
       ELSE '' END AS kind,
  '' AS note
FROM alert_src
""")

VIEWS["alert_kept"] = (["alert_norm"], """
SELECT * FROM alert_norm WHERE error IS NOT NULL OR (type <> 'ignore' AND amount > 0)
""")

VIEWS["categories_v"] = ([], """
SELECT * FROM (VALUES ('cat1', 'k1', 'd1', 1, 0), ('cat2', 'k2', 'd2', 1, 1), ('cat3', 'k3', 'd3', 1, 2),
  ('cat4', 'k4', 'd4', 0, 3), ('cat9', 'k9', 'd9', 1, 4)) t(name, key, descr, active, sort)
""")

VIEWS["knowledge_v"] = ([], """
SELECT * FROM (VALUES (1, 'merchant', 'shop1', 't1', 'cat1'), (2, 'global', NULL, 't2', 'cat4'),
  (3, 'merchant', 'shop2', 't3', NULL), (4, 'merchant', 'shop3', 't4', 'cat9')) t(id, scope, merchant_key, text, category)
""")

VIEWS["suggestions_e"] = (["ledger_e"], """
SELECT id AS transaction_id, (['merge', 'offset', 'void', 'split'])[CAST(id % 4 + 1 AS INTEGER)] AS operation,
  '[' || CAST(id AS VARCHAR) || ', ' || CAST(id + 1 AS VARCHAR) || ']' AS related_transaction_ids,
  'r' || CAST(id % 5 AS VARCHAR) AS reason
FROM ledger_e WHERE NOT voided AND id % 6 = 0
""")

VIEWS["advice_merchants"] = (["ledger_e"], """
SELECT DISTINCT merchant_key, CAST(floor(CAST(substr(merchant_key, 5, 10) AS INTEGER) / 40) AS BIGINT) AS batch_id
FROM ledger_e WHERE status IN ('pending', 'suggested') AND NOT voided AND merchant_key IS NOT NULL
""")

VIEWS["adv_per"] = (["advice_merchants"], """
SELECT merchant_key, arg_max(id, (txn_time, id)) FILTER (WHERE NOT voided) AS latest,
  arg_min(id, (txn_time, id)) FILTER (WHERE NOT voided) AS earliest,
  max(id) FILTER (WHERE voided) AS dead
FROM ledger_e WHERE merchant_key IN (SELECT merchant_key FROM advice_merchants) GROUP BY merchant_key
""")

VIEWS["advice_e"] = (["adv_per"], """
SELECT m.batch_id,
  CASE WHEN k % 7 = 3 THEN m.merchant_key || ' (3笔)' ELSE m.merchant_key END AS adv_key,
  CAST(k AS BIGINT) AS pos,
  CASE k % 7 WHEN 0 THEN 'cat1' WHEN 1 THEN 'catX' WHEN 3 THEN 'cat2' WHEN 4 THEN 'cat3' WHEN 5 THEN 'cat1'
       WHEN 6 THEN 'cat4' END AS category,
  CASE k % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'void' WHEN 3 THEN 'merge' WHEN 4 THEN 'none' WHEN 5 THEN 'delete'
       WHEN 6 THEN 'offset' END AS operation,
  CASE k % 7 WHEN 1 THEN [p.latest] WHEN 3 THEN [p.latest, p.earliest] WHEN 5 THEN [p.latest] WHEN 6 THEN [p.dead]
       ELSE CAST([] AS BIGINT[]) END AS related_ids,
  CASE WHEN k % 7 IN (0, 4) THEN '' ELSE ' r' || CAST(k % 7 AS VARCHAR) || ' ' END AS reason
FROM (SELECT *, CAST(substr(merchant_key, 5, 10) AS INTEGER) AS k FROM advice_merchants) m
JOIN adv_per p ON p.merchant_key = m.merchant_key
WHERE k % 7 <> 2
UNION ALL
SELECT DISTINCT batch_id, 'sho', CAST(99 AS BIGINT), 'cat9', 'none', CAST([] AS BIGINT[]), '' FROM advice_merchants
""")

VIEWS["adv_picked"] = (["advice_e"], """
WITH ex AS (
  SELECT m.merchant_key, a.adv_key, a.category, a.operation, a.related_ids, a.reason
  FROM advice_merchants m JOIN advice_e a ON a.batch_id = m.batch_id AND a.adv_key = m.merchant_key),
fz AS (
  SELECT m.merchant_key,
    arg_min({'adv_key': a.adv_key, 'category': a.category, 'operation': a.operation,
             'related_ids': a.related_ids, 'reason': a.reason}, a.pos) AS x
  FROM advice_merchants m JOIN advice_e a ON a.batch_id = m.batch_id
    AND (starts_with(a.adv_key, m.merchant_key) OR starts_with(m.merchant_key, a.adv_key))
  WHERE m.merchant_key NOT IN (SELECT merchant_key FROM ex)
  GROUP BY m.merchant_key),
p AS (
  SELECT * FROM ex
  UNION ALL SELECT merchant_key, x.adv_key, x.category, x.operation, x.related_ids, x.reason FROM fz)
SELECT m.merchant_key, m.batch_id, p.adv_key, p.category, p.operation, p.related_ids, p.reason
FROM advice_merchants m LEFT JOIN p ON p.merchant_key = m.merchant_key
""")

VIEWS["commands_o"] = ([], """
SELECT o_orderkey AS txn_id, o_orderkey * 3 AS seq,
  (['void', 'restore', 'set_category', 'set_note', 'confirm'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] AS op,
  CASE o_orderkey % 5 WHEN 2 THEN 'cat' || CAST(o_custkey % 3 + 1 AS VARCHAR)
       WHEN 3 THEN 'n' || CAST(o_orderkey AS VARCHAR) END AS payload
FROM orders
UNION ALL SELECT o_orderkey, o_orderkey * 3 + 1, 'set_category', '2-HIGH' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, o_orderkey * 3 + 2, CASE WHEN o_orderkey % 2 = 0 THEN 'void' ELSE 'restore' END, NULL
FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT -o_orderkey - 1, o_orderkey * 3, 'void', NULL FROM orders WHERE o_orderkey % 13 = 0
""")

VIEWS["splits_e"] = (["ledger_e"], """
SELECT id AS request_id, id AS txn_id,
  CASE WHEN id % 13 = 0 THEN [amount] WHEN id % 13 = 1 THEN [CAST(10 AS DECIMAL(18,2)), amount]
       ELSE [CAST(10 AS DECIMAL(18,2)), CAST(amount - 10 AS DECIMAL(18,2))] END AS amounts
FROM ledger_e WHERE direction = 'expense'
""")

VIEWS["merge_ids_e"] = (["ledger_e"], """
SELECT card_last4 || '-' || merchant_key || '-' || CAST(weekofyear(txn_time) AS VARCHAR) AS request_id, id * 2 AS pos, id
FROM ledger_e
UNION ALL
SELECT card_last4 || '-' || merchant_key || '-' || CAST(weekofyear(txn_time) AS VARCHAR), id * 2 + 1, id
FROM ledger_e WHERE id % 29 = 0
""")

VIEWS["merges_e"] = (["merge_ids_e"], """
SELECT request_id,
  CASE WHEN CAST(split_part(request_id, '-', 3) AS INTEGER) % 2 = 0 THEN 'cat1' END AS category,
  'merge ' || request_id AS note,
  CASE WHEN contains(request_id, 'shop4') THEN '2024-02' END AS month,
  CASE WHEN substr(request_id, 4, 1) = '7' THEN 'offset' END AS expected_operation
FROM (SELECT DISTINCT request_id FROM merge_ids_e)
""")

VIEWS["op_requests_e"] = (["ledger_e"], """
SELECT id AS request_id, (['merge', 'offset', 'void', 'split', 'delete'])[CAST(id % 5 + 1 AS INTEGER)] AS operation,
  CASE id % 3 WHEN 0 THEN [id] WHEN 1 THEN [id, id + 1] ELSE CAST([] AS BIGINT[]) END AS ids,
  CASE id % 4 WHEN 0 THEN [CAST(10 AS DECIMAL(18,2)), CAST(20 AS DECIMAL(18,2))] WHEN 1 THEN [CAST(10 AS DECIMAL(18,2))] END AS amounts,
  (['cat1', 'cat4', 'catX', NULL])[CAST(id % 4 + 1 AS INTEGER)] AS category
FROM ledger_e
""")
