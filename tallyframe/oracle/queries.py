"""Oracle SQL (DuckDB) for every registered query key.

Each string is self-contained: the fixture views are prepended as CTEs. The
parameters match the ones fixed in ``tallyframe.plans.registry``.
"""
from __future__ import annotations

from .views import with_views

SPEND = "('expense','refund','fee','withdraw')"


def period(d: int, col: str = "txn_time") -> str:
    if d <= 1:
        return f"strftime({col}, '%Y-%m')"
    return f"strftime(CAST({col} AS DATE) - {d - 1}, '%Y-%m')"


def month_expr(d: int) -> str:
    return f"coalesce(effective_month, {period(d)})"


def money(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


LIST_COLS = ("id, card_last4, card_type, txn_time, CAST(amount AS DOUBLE) AS amount, direction, "
             "merchant_raw, merchant_key, category, status, voided, offset_of, merged_into, "
             "effective_month, note")

ORACLE: dict[str, str] = {}


def matrix(view: str, d: int) -> str:
    return with_views([view], f"""
SELECT {month_expr(d)} AS m, coalesce(category, '__uncat__') AS c,
       {money('sum(amount)')} AS spend, count(*) AS n
FROM {view} WHERE NOT voided AND direction IN {SPEND}
GROUP BY 1, 2""")


ORACLE["monthly_matrix"] = matrix("ledger_o", 1)
ORACLE["monthly_matrix_day15"] = matrix("ledger_o", 15)

ORACLE["summary_all"] = with_views(["ledger_o"], f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE status IN ('pending','suggested')) AS pending,
       coalesce({money(f"sum(amount) FILTER (WHERE direction IN {SPEND})")}, 0.0) AS spend
FROM ledger_o WHERE NOT voided""")

ORACLE["summary_month"] = with_views(["ledger_o"], f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE status IN ('pending','suggested')) AS pending,
       coalesce({money(f"sum(amount) FILTER (WHERE direction IN {SPEND})")}, 0.0) AS spend
FROM ledger_o WHERE NOT voided AND {month_expr(1)} = '1999-06'""")

ORACLE["category_stats"] = with_views(["ledger_o"], f"""
SELECT category AS c, count(*) AS n, {money('sum(amount)')} AS spend
FROM ledger_o WHERE NOT voided AND direction IN {SPEND} AND category IS NOT NULL
GROUP BY category""")

ORACLE["annual_matrix"] = with_views(["ledger_o"], f"""
SELECT substr({month_expr(1)}, 1, 4) AS y, coalesce(category, '__uncat__') AS c,
       {money('sum(amount)')} AS spend, count(*) AS n
FROM ledger_o WHERE NOT voided AND direction IN {SPEND} AND substr({month_expr(1)}, 1, 4) >= '1998'
GROUP BY 1, 2""")

ORACLE["period_list"] = with_views(["ledger_o"], f"SELECT DISTINCT {period(15)} AS m FROM ledger_o")

ORACLE["monthly_summary"] = with_views(["ledger_o"], f"""
WITH cells AS (
  SELECT {month_expr(1)} AS m, coalesce(category, '__uncat__') AS c,
         round(sum(amount), 2) AS spend, count(*) AS n
  FROM ledger_o WHERE NOT voided AND direction IN {SPEND} GROUP BY 1, 2)
SELECT CASE WHEN c = '__uncat__' THEN '未分类' ELSE c END AS category,
       {money('sum(spend)')} AS spend, CAST(sum(n) AS BIGINT) AS n
FROM cells WHERE m = '1999-06'
GROUP BY 1 HAVING abs(sum(spend)) > 0.004""")


def share(view: str, key: str, key_expr: str, where: str = "") -> str:
    return with_views([view], f"""
WITH cells AS (
  SELECT {key_expr} AS {key}, coalesce(category, '__uncat__') AS c,
         round(sum(amount), 2) AS spend, count(*) AS n
  FROM {view} WHERE NOT voided AND direction IN {SPEND} {where} GROUP BY 1, 2),
tot AS (SELECT {key}, CAST(sum(spend) AS DOUBLE) AS t FROM cells GROUP BY 1)
SELECT cells.{key} AS {key}, c, CAST(spend AS DOUBLE) AS spend,
       CASE WHEN t = 0 THEN 1.0 ELSE t END AS total,
       CAST(spend AS DOUBLE) / CASE WHEN t = 0 THEN 1.0 ELSE t END AS pct
FROM cells JOIN tot USING ({key}) WHERE spend > 0""")


ORACLE["category_share"] = share("ledger_o", "m", month_expr(1))
ORACLE["category_share_annual"] = share("ledger_o", "y", f"substr({month_expr(1)}, 1, 4)",
                                        f"AND substr({month_expr(1)}, 1, 4) >= '1998'")

ORACLE["deposit_monthly"] = with_views(["deposits_e"], f"""
SELECT strftime(txn_time, '%Y-%m') AS m, count(*) AS n, {money('sum(amount)')} AS total
FROM deposits_e GROUP BY 1""")

ORACLE["merchant_totals"] = with_views(["ledger_e"], f"""
SELECT merchant_key, count(*) AS n, {money('sum(amount)')} AS total,
       count(*) FILTER (WHERE status IN ('pending','suggested')) AS pending_n
FROM ledger_e WHERE NOT voided AND merchant_key IS NOT NULL GROUP BY 1""")

# ---- matching ------------------------------------------------------------------

# The greedy rule as it is told: each key's rows are walked in order with a stack of open expenses.
PAIRS_SQL = """
cand AS (
  SELECT *, CASE WHEN direction = 'refund' THEN abs(amount) ELSE amount END AS amt_key
  FROM {view}
  WHERE NOT voided AND card_last4 IS NOT NULL AND merchant_key IS NOT NULL
    AND (direction = 'refund' OR (direction = 'expense' AND amount >= 0))),
walk_rows AS (
  SELECT id, direction, card_last4, merchant_key, amt_key,
    row_number() OVER (PARTITION BY card_last4, merchant_key, amt_key ORDER BY txn_time, direction, id) AS seq FROM cand),
walk AS (
  SELECT card_last4, merchant_key, amt_key, seq, id, list_filter([id], lambda x: direction <> 'refund') AS stack,
    CASE WHEN false THEN id END AS taken
  FROM walk_rows WHERE seq = 1
  UNION ALL
  SELECT e.card_last4, e.merchant_key, e.amt_key, e.seq, e.id,
    CASE WHEN e.direction <> 'refund' THEN list_append(w.stack, e.id) ELSE w.stack[:-2] END,
    CASE WHEN e.direction = 'refund' THEN w.stack[-1] END
  FROM walk w JOIN walk_rows e ON e.card_last4 = w.card_last4 AND e.merchant_key = w.merchant_key
    AND e.amt_key = w.amt_key AND e.seq = w.seq + 1),
pr AS (SELECT id AS refund, taken AS expense FROM walk WHERE taken IS NOT NULL),
ann AS (
  SELECT c.*, coalesce(r.expense, x.refund) AS pair_id
  FROM cand c LEFT JOIN pr r ON r.refund = c.id LEFT JOIN pr x ON x.expense = c.id)"""

ORACLE["refund_pairs"] = with_views(["ledger_e"], "WITH " + PAIRS_SQL.format(view="ledger_e") + """
SELECT id AS refund_id, pair_id AS expense_id, card_last4, merchant_key,
       CAST(abs(amount) AS DOUBLE) AS amount, txn_time AS refund_time
FROM ann WHERE direction = 'refund' AND pair_id IS NOT NULL""")

ORACLE["ledger_after_pairing"] = with_views(["ledger_e"], "WITH " + PAIRS_SQL.format(view="ledger_e") + f""",
after AS (
  SELECT l.id, l.card_last4, l.card_type, l.txn_time, l.amount, l.direction, l.merchant_raw,
         l.merchant_key, l.category, l.status, (l.voided OR a.pair_id IS NOT NULL) AS voided,
         coalesce(a.pair_id, l.offset_of) AS offset_of, l.merged_into, l.effective_month, l.note
  FROM ledger_e l LEFT JOIN ann a ON a.id = l.id)
SELECT {LIST_COLS} FROM after""")

ORACLE["merge_candidates"] = with_views(["ledger_o"], f"""
WITH r AS (SELECT * FROM ledger_o WHERE direction = 'refund' AND NOT voided AND abs(amount) >= 10),
e AS (SELECT * FROM ledger_o WHERE direction = 'expense' AND NOT voided),
pick AS (
  SELECT r.id AS refund_id, r.merchant_key, r.txn_time AS refund_time, r.amount AS refund_amount,
         arg_max(e.id, (e.txn_time, e.id)) AS expense_id
  FROM r JOIN e ON e.card_last4 = r.card_last4 AND e.merchant_key = r.merchant_key
     AND e.txn_time <= r.txn_time AND e.id <> r.id AND e.amount >= abs(r.amount)
  GROUP BY 1, 2, 3, 4)
SELECT p.merchant_key, p.expense_id, CAST(e.amount AS DOUBLE) AS expense_amount, e.txn_time AS expense_time,
       p.refund_id, CAST(p.refund_amount AS DOUBLE) AS refund_amount, p.refund_time,
       {money('e.amount + p.refund_amount')} AS net
FROM pick p JOIN e ON e.id = p.expense_id
WHERE {period(15, 'e.txn_time')} <> {period(15, 'p.refund_time')}""")

ORACLE["reimbursement_match"] = with_views(["ledger_e", "deposits_e"], """
WITH e AS (SELECT id, txn_time, amount FROM ledger_e WHERE NOT voided AND direction = 'expense' AND amount > 0),
nx AS (
  SELECT e.id AS expense_id, arg_min(d.id, (d.txn_time, d.id)) AS did, min(d.txn_time) AS dt
  FROM e JOIN deposits_e d ON d.amount = e.amount AND d.txn_time >= e.txn_time
  GROUP BY 1)
SELECT e.id AS expense_id, e.txn_time AS expense_time, CAST(e.amount AS DOUBLE) AS amount,
       CASE WHEN nx.dt <= e.txn_time + INTERVAL 3 DAY THEN nx.did END AS deposit_id,
       CASE WHEN nx.dt <= e.txn_time + INTERVAL 3 DAY THEN nx.dt END AS deposit_time
FROM e LEFT JOIN nx ON nx.expense_id = e.id""")

# ---- listings ------------------------------------------------------------------


def page(view: str, where: str, limit: int = 200, offset: int = 0) -> str:
    return with_views([view], f"""
SELECT {LIST_COLS} FROM {view} WHERE {where}
ORDER BY txn_time DESC, id DESC LIMIT {limit} OFFSET {offset}""")


ORACLE["ledger_list"] = page("ledger_e", "NOT voided")
ORACLE["ledger_list_void"] = page("ledger_e", "voided")
ORACLE["ledger_list_uncat"] = page("ledger_o", "NOT voided AND card_type = 'credit' AND category IS NULL")
ORACLE["ledger_list_year"] = page(
    "ledger_o", f"NOT voided AND status = 'confirmed' AND substr({month_expr(15)}, 1, 4) = '1998'")
ORACLE["ledger_page"] = page("ledger_o", f"NOT voided AND substr({month_expr(1)}, 1, 4) = '1997'", 300, 200)
ORACLE["ledger_search"] = page(
    "ledger_e", "NOT voided AND translate(merchant_raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz') LIKE '%宝-shop_%'")

DEP_COLS = "id, source_msg_id, card_last4, txn_time, CAST(amount AS DOUBLE) AS amount, kind, payer, note, raw_text"
ORACLE["deposit_list"] = with_views(["deposits_e"], f"""
SELECT {DEP_COLS} FROM deposits_e
WHERE txn_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY
ORDER BY txn_time DESC, id DESC LIMIT 500""")
ORACLE["deposit_match_amount"] = with_views(["deposits_e"], f"""
SELECT {DEP_COLS} FROM deposits_e WHERE abs(amount - 30.0) < 0.01
ORDER BY txn_time DESC, id DESC LIMIT 500""")

ORACLE["pending_count"] = with_views(["ledger_e"], """
SELECT count(*) AS n FROM ledger_e WHERE status = 'pending' AND NOT voided AND merchant_key IS NOT NULL""")
ORACLE["pending_list"] = page("ledger_o", f"NOT voided AND status = 'pending' AND {month_expr(1)} = '1996-02'", 20)

ORACLE["category_drilldown"] = with_views(["ledger_o"], f"""
WITH rows AS (
  SELECT id, txn_time, amount, merchant_raw, {month_expr(1)} AS m FROM ledger_o
  WHERE NOT voided AND {month_expr(1)} = '1998-07' AND category = '1-URGENT')
SELECT id, txn_time, CAST(amount AS DOUBLE) AS amount, merchant_raw, m,
       {money('sum(amount) OVER ()')} AS cell_total
FROM rows""")

ORACLE["netted_monthly_matrix"] = with_views(["ledger_e"], "WITH " + PAIRS_SQL.format(view="ledger_e") + f""",
after AS (
  SELECT l.*, (l.voided OR a.pair_id IS NOT NULL) AS v2
  FROM ledger_e l LEFT JOIN ann a ON a.id = l.id)
SELECT coalesce(effective_month, {period(15)}) AS m, coalesce(category, '__uncat__') AS c,
       {money('sum(amount)')} AS spend, count(*) AS n
FROM after WHERE NOT v2 AND direction IN {SPEND} GROUP BY 1, 2""")

# ---- scalar functions ------------------------------------------------------------

from .. import constants as K  # noqa: E402
from .views import ROUTER_CASE, WS, strip_sql  # noqa: E402


def _entities(x: str) -> str:
    for name, rep, bare in K.HTML_ENTITIES:
        pat = "&" + name + (";?" if bare else ";")
        rep_sql = rep.replace("'", "''")
        x = f"regexp_replace({x}, '{pat}', '{rep_sql}', 'g')"
    return x


_t = "html"
_t = f"regexp_replace({_t}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')"
_t = f"regexp_replace({_t}, '(?is)<br[\\t\\n\\x0b\\x0c\\r ]*/?>', chr(10), 'g')"
_t = f"regexp_replace({_t}, '(?is)</(td|tr|div|p|table|li|h[1-6])>', chr(10), 'g')"
_t = f"regexp_replace({_t}, '(?s)<[^>]+>', ' ', 'g')"
_t = _entities(_t)
_INLINE = "regexp_replace(x, '[ \t\u00a0]+', ' ', 'g')"
LINES_SQL = (f"list_transform(list_filter(string_split({_t}, chr(10)), lambda x: {strip_sql('x')} <> ''), "
             f"lambda x: {strip_sql(_INLINE)})")

ORACLE["html_to_lines"] = f"""
WITH p AS (SELECT page_id, {LINES_SQL} AS lines FROM pages)
SELECT page_id, CAST(len(lines) AS BIGINT) AS n_lines, array_to_string(lines, chr(10)) AS text FROM p"""

ORACLE["html_entities"] = with_views(["text_inputs"], """
SELECT event_id, 'a' || chr(CAST(k + 200 AS INTEGER)) || 'b' || chr(CAST(k + 8000 AS INTEGER)) || ' ' || CASE WHEN k % 2 = 0 THEN '‘' ELSE '’' END
  || chr(65533) || 'é…© &x &nosuch; & &lt;' || merchant_raw AS text FROM text_inputs""")

_flat = ("nullif(CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 3 = 0 THEN ' plain ' || chr(10) || chr(9) || url END, ''), "
         "regexp_replace(html, '(?is)<[^>]+>', ' ', 'g')")
ORACLE["html_flat_text"] = f"""
SELECT page_id, {strip_sql(f"regexp_replace(coalesce({_flat}, ''), '{WS}+', ' ', 'g')")} AS flat
FROM pages"""

ORACLE["mail_type"] = with_views(["mails_e"], f"SELECT uid, {ROUTER_CASE} AS email_type FROM mails_e")

_dir_case = "CASE action " + " ".join(f"WHEN '{a}' THEN '{d}'" for a, d in K.DIRECTION_BY_ACTION.items()) + \
    " ELSE 'other' END"
ORACLE["direction_map"] = with_views(["text_inputs"], f"SELECT event_id, action, {_dir_case} AS direction FROM text_inputs")

_chs = ", ".join(f"'{c}'" for c in K.KNOWN_CHANNELS)
ORACLE["merchant_split"] = with_views(["text_inputs"], f"""
WITH s AS (
  SELECT event_id, merchant_raw,
    {strip_sql("split_part(merchant_raw, '-', 1)")} AS head,
    {strip_sql("substr(merchant_raw, strpos(merchant_raw, '-') + 1)")} AS rest,
    contains(merchant_raw, '-') AS has_dash
  FROM text_inputs)
SELECT event_id, merchant_raw,
  CASE WHEN has_dash AND head IN ({_chs}) AND rest <> '' THEN head END AS channel,
  CASE WHEN has_dash AND head IN ({_chs}) AND rest <> '' THEN rest ELSE {strip_sql('merchant_raw')} END AS merchant_key
FROM s""")

ORACLE["fingerprint"] = with_views(["ledger_e"], "SELECT id, fingerprint FROM ledger_e")

ORACLE["parse_amount"] = with_views(["text_inputs"], """
SELECT event_id, amount_text, CAST(TRY_CAST(replace(amount_text, ',', '') AS DECIMAL(18,2)) AS DOUBLE) AS amount
FROM text_inputs""")

ORACLE["billing_period"] = with_views(["ledger_o"], f"""
SELECT id, {period(1)} AS p1, {period(15)} AS p15, {period(28)} AS p28 FROM ledger_o""")

ORACLE["attribution_month"] = with_views(["ledger_o"], f"""
SELECT id, {month_expr(15)} AS m, substr({month_expr(15)}, 1, 4) AS y FROM ledger_o""")

ORACLE["period_range"] = with_views(["ledger_o"], f"""
WITH p AS (SELECT DISTINCT {period(15)} AS m FROM ledger_o),
d AS (SELECT m, make_date(CAST(substr(m, 1, 4) AS INTEGER), CAST(substr(m, 6, 2) AS INTEGER), 15) AS s FROM p)
SELECT m, s AS start_date, CAST(s + INTERVAL 1 MONTH AS DATE) - 1 AS end_date FROM d""")

ORACLE["json_extract"] = with_views(["alert_src"], """
SELECT source_msg_id, type, amount, card_last4 FROM alert_src""")

ORACLE["alert_normalise"] = with_views(["alert_kept"], """
SELECT source_msg_id,
  CASE WHEN error IS NULL THEN type END AS type,
  CASE WHEN error IS NULL THEN card_last4 END AS card_last4,
  CASE WHEN error IS NULL THEN txn_time END AS txn_time,
  CASE WHEN error IS NULL THEN amount END AS amount,
  CASE WHEN error IS NULL THEN counterparty END AS counterparty,
  CASE WHEN error IS NULL THEN channel END AS channel,
  CASE WHEN error IS NULL THEN kind END AS kind,
  CASE WHEN error IS NULL THEN note END AS note,
  error
FROM alert_kept""")

ORACLE["amount_hint"] = with_views(["ledger_e"], """
WITH g AS (
  SELECT merchant_key, count(*) AS n, list_sort(list_distinct(list(amount))) AS ds
  FROM ledger_e WHERE NOT voided GROUP BY merchant_key)
SELECT merchant_key, n,
  CASE WHEN len(ds) = 1 THEN CAST(n AS VARCHAR) || '笔，金额固定' || CAST(ds[1] AS VARCHAR)
       WHEN len(ds) <= 4 THEN CAST(n AS VARCHAR) || '笔，金额' || array_to_string(list_transform(ds, lambda x: CAST(x AS VARCHAR)), '/')
       ELSE CAST(n AS VARCHAR) || '笔，金额' || CAST(ds[1] AS VARCHAR) || '~' || CAST(ds[-1] AS VARCHAR) || '不等' END AS hint
FROM g""")

ORACLE["received_local"] = with_views(["mails_e"], """
SELECT uid, CASE WHEN uid % 10 <> 7 THEN received + INTERVAL 8 HOUR ELSE TIMESTAMP '2024-01-31 00:00:00' END AS received_local
FROM mails_e""")

# ---- mail sources ----------------------------------------------------------------

_senders = ("(contains(lower(sender), 'ccsvc@message.cmbchina.com') OR "
            "contains(lower(sender), '95555@message.cmbchina.com'))")
ORACLE["incremental_scan"] = with_views(["mails_e"], "SELECT uid, msg_id FROM mails_e WHERE uid > 500")
ORACLE["scan_newest_n"] = with_views(["mails_e"], """
SELECT uid, msg_id FROM mails_e WHERE uid > 500 ORDER BY uid DESC LIMIT 100""")
ORACLE["mail_search"] = with_views(["mails_e"], f"""
SELECT DISTINCT uid FROM mails_e WHERE {_senders} AND CAST(received AS DATE) >= DATE '2024-01-10'""")
ORACLE["sender_union"] = ORACLE["mail_search"]
ORACLE["recent_mail_count"] = with_views(["mails_e"], """
SELECT sender, count(*) AS n FROM mails_e
WHERE received >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY GROUP BY sender""")
ORACLE["mail_dedup"] = with_views(["mails_e"], """
WITH lg AS (SELECT * FROM mails_e WHERE received < TIMESTAMP '2024-01-15 00:00:00'),
nw AS (SELECT * FROM mails_e WHERE received >= TIMESTAMP '2024-01-10 00:00:00')
SELECT msg_id, min(uid) AS uid FROM nw WHERE msg_id NOT IN (SELECT msg_id FROM lg) GROUP BY msg_id""")
ORACLE["mail_log_upsert"] = with_views(["mails_e"], """
WITH lg AS (SELECT msg_id, uid, 'parsed' AS status FROM mails_e WHERE received < TIMESTAMP '2024-01-15 00:00:00'),
nw AS (SELECT msg_id, max(uid) AS uid, 'reparsed' AS status FROM mails_e
       WHERE received >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY msg_id)
SELECT * FROM lg WHERE msg_id NOT IN (SELECT msg_id FROM nw)
UNION ALL SELECT * FROM nw""")

# ---- extraction ------------------------------------------------------------------

_route_card = ("CASE WHEN email_type = 'credit_daily' THEN 'credit' "
               "WHEN contains(lower(sender), '95555@message.cmbchina.com') AND trim(subject) = '一卡通账户变动通知' "
               "THEN 'debit' END")
_route_out = ("CASE WHEN email_type = 'credit_daily' THEN 'transactions' "
              "WHEN contains(lower(sender), '95555@message.cmbchina.com') AND trim(subject) = '一卡通账户变动通知' "
              "THEN 'ai_record' END")
ORACLE["mail_route"] = with_views(["mails_typed"], f"""
SELECT uid, msg_id, email_type, {_route_card} AS parser_card_type, {_route_out} AS parser_output FROM mails_typed""")

ORACLE["digest_extract"] = with_views(["digest_src"], """
WITH d AS (SELECT *, date_trunc('second', txn_time) AS t2 FROM digest_src)
SELECT 'g' || CAST(user_id AS VARCHAR) || '-' || strftime(digest_date, '%Y%m%d') || '-' || CAST(part AS VARCHAR) AS source_msg_id,
  card_last4, t2 AS txn_time, CAST(amount AS DOUBLE) AS amount, action, direction, merchant_raw,
  merchant_key, channel, CAST(user_id * 1000 + 0.5 AS DOUBLE) AS avail_credit, user_id * 37 AS points,
  sha1(concat_ws('|', card_last4, strftime(t2, '%Y-%m-%d %H:%M:%S'), CAST(amount AS VARCHAR), merchant_raw, action)) AS fingerprint
FROM d""")

MAIL_STATUS_SQL = f"""
WITH r AS (SELECT uid, msg_id, email_type, {_route_out} AS parser_output FROM mails_typed),
ok AS (SELECT event_id FROM alert_kept WHERE error IS NULL)
SELECT uid, msg_id, email_type,
  CASE WHEN parser_output IS NULL THEN 'skipped'
       WHEN parser_output = 'transactions' THEN 'error'
       WHEN uid IN (SELECT event_id FROM ok) THEN 'parsed' ELSE 'skipped' END AS status,
  CASE WHEN parser_output = 'transactions' THEN 'digest yielded 0 transactions' END AS error
FROM r
UNION ALL SELECT ('0x' || substr(md5(m), 1, 12))::BIGINT, m, 'credit_daily', 'parsed', NULL
FROM (SELECT DISTINCT 'g' || CAST(user_id AS VARCHAR) || '-' || strftime(digest_date, '%Y%m%d') || '-' || CAST(part AS VARCHAR) AS m
      FROM digest_src)"""
ORACLE["mail_status"] = with_views(["mails_typed", "alert_kept", "digest_src"], MAIL_STATUS_SQL)
ORACLE["ingest_stats"] = with_views(["mails_typed", "alert_kept", "digest_src"], f"""
WITH st AS ({MAIL_STATUS_SQL.strip()})
SELECT email_type || ':' || status AS type_status, count(*) AS n FROM st GROUP BY 1""")

ORACLE["alert_route"] = with_views(["alert_kept"], f"""
WITH a AS (
  SELECT source_msg_id, card_last4, CAST(strptime(txn_time, '%Y-%m-%d %H:%M') AS TIMESTAMP) AS t,
    CAST(amount AS DECIMAL(18,2)) AS amt,
    CASE WHEN type = 'transfer_out' THEN '转账' ELSE '消费' END AS action,
    CASE WHEN type = 'transfer_out' THEN counterparty WHEN channel <> '' THEN channel || '-' || counterparty
         ELSE counterparty END AS merchant_raw
  FROM alert_kept WHERE error IS NULL AND type IN ('expense', 'transfer_out')),
s AS (
  SELECT *, {strip_sql("split_part(merchant_raw, '-', 1)")} AS head,
    {strip_sql("substr(merchant_raw, strpos(merchant_raw, '-') + 1)")} AS rest,
    contains(merchant_raw, '-') AS has_dash FROM a)
SELECT source_msg_id, card_last4, 'debit' AS card_type, t AS txn_time, CAST(amt AS DOUBLE) AS amount, action,
  'expense' AS direction, merchant_raw,
  CASE WHEN has_dash AND head IN ({_chs}) AND rest <> '' THEN rest ELSE {strip_sql('merchant_raw')} END AS merchant_key,
  CASE WHEN has_dash AND head IN ({_chs}) AND rest <> '' THEN head END AS channel,
  sha1(concat_ws('|', card_last4, strftime(t, '%Y-%m-%d %H:%M:%S'), CAST(amt AS VARCHAR), merchant_raw, action)) AS fingerprint
FROM s""")

# ---- advice ----------------------------------------------------------------------

ORACLE["pending_merchants"] = with_views(["ledger_e", "suggestions_e"], f"""
SELECT t.merchant_key, count(*) AS n,
  {money('sum(CASE WHEN t.amount > 0 THEN t.amount ELSE 0 END)')} AS spend,
  max(t.merchant_raw) AS sample, max(t.card_type) AS card,
  max(CASE WHEN t.status = 'suggested' THEN t.category END) AS suggested,
  max(s.operation) AS suggested_operation, max(s.related_transaction_ids) AS suggested_related_ids,
  max(s.reason) AS suggested_operation_reason
FROM ledger_e t LEFT JOIN suggestions_e s ON s.transaction_id = t.id
WHERE t.status IN ('pending', 'suggested') AND NOT t.voided AND t.merchant_key IS NOT NULL
GROUP BY t.merchant_key""")

ORACLE["pending_header"] = with_views(["ledger_e", "suggestions_e"], """
WITH pm AS (
  SELECT t.merchant_key, count(*) AS n, max(CASE WHEN t.status = 'suggested' THEN t.category END) AS suggested
  FROM ledger_e t LEFT JOIN suggestions_e s ON s.transaction_id = t.id
  WHERE t.status IN ('pending', 'suggested') AND NOT t.voided AND t.merchant_key IS NOT NULL
  GROUP BY t.merchant_key)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_rows,
  count(*) FILTER (WHERE suggested IS NOT NULL) AS with_ai, count(*) FILTER (WHERE suggested IS NULL) AS without_ai
FROM pm""")

PICK_COLS = ("merchant_key, adv_key, category, operation, "
             "array_to_string(list_transform(related_ids, lambda x: CAST(x AS VARCHAR)), ',') AS related_ids")
ACTIVE = "(SELECT name FROM categories_v WHERE active = 1)"
ORACLE["advice_prefix_join"] = with_views(["adv_picked"], f"SELECT {PICK_COLS} FROM adv_picked")
ORACLE["advice_valid"] = with_views(["adv_picked", "categories_v"],
                                    f"SELECT {PICK_COLS} FROM adv_picked WHERE category IN {ACTIVE}")
ORACLE["advice_uncertain"] = with_views(
    ["adv_picked", "categories_v"],
    f"SELECT {PICK_COLS} FROM adv_picked WHERE category IS NULL OR category NOT IN {ACTIVE}")

ORACLE["merchant_recent20"] = with_views(["ledger_e"], """
WITH om AS (SELECT DISTINCT merchant_key FROM ledger_e
            WHERE status IN ('pending', 'suggested') AND NOT voided AND merchant_key IS NOT NULL),
r AS (SELECT merchant_key, id, CAST(amount AS DOUBLE) AS amount, txn_time, direction, card_last4,
        row_number() OVER (PARTITION BY merchant_key ORDER BY txn_time DESC, id DESC) AS rn
      FROM ledger_e WHERE NOT voided AND merchant_key IN (SELECT merchant_key FROM om))
SELECT merchant_key, id, amount, txn_time, direction, card_last4, CAST(rn AS BIGINT) AS rn FROM r WHERE rn <= 20""")

EDIT_OUT = "id, voided, category, category_src, status, note"


def _merchant_update(dec_sql: str, mode: str) -> str:
    if mode == "suggest":
        on = "d.merchant_key IS NOT NULL AND l.status IN ('pending', 'suggested')"
        cat, src, st = "d.category", "'hermes'", "'suggested'"
    elif mode == "clear":
        on = "d.merchant_key IS NOT NULL AND l.status = 'suggested'"
        cat, src, st = "NULL", "NULL", "'pending'"
    else:
        on = "d.merchant_key IS NOT NULL AND l.status IN ('pending', 'suggested')"
        cat, src, st = "d.category", "'manual'", "'confirmed'"
    return with_views(["ledger_e", "adv_picked", "categories_v"], f"""
WITH d AS ({dec_sql})
SELECT l.id, l.voided, CASE WHEN {on} THEN {cat} ELSE l.category END AS category,
  CASE WHEN {on} THEN {src} ELSE l.category_src END AS category_src,
  CASE WHEN {on} THEN {st} ELSE l.status END AS status, l.note
FROM ledger_e l LEFT JOIN d ON d.merchant_key = l.merchant_key""")


VALID_DEC = f"SELECT merchant_key, category FROM adv_picked WHERE category IN {ACTIVE}"
UNSURE_DEC = f"SELECT merchant_key, NULL AS category FROM adv_picked WHERE category IS NULL OR category NOT IN {ACTIVE}"
ORACLE["merchant_suggest"] = _merchant_update(VALID_DEC, "suggest")
ORACLE["merchant_clear"] = _merchant_update(UNSURE_DEC, "clear")
ORACLE["merchant_confirm"] = _merchant_update(VALID_DEC, "confirm")

ORACLE["classify_apply"] = with_views(["ledger_e", "adv_picked", "categories_v"], f"""
WITH d AS (SELECT merchant_key, category, 'suggest' AS act FROM ({VALID_DEC})
           UNION ALL SELECT merchant_key, category, 'clear' AS act FROM ({UNSURE_DEC})),
j AS (SELECT l.*, d.act, d.category AS dcat,
        (d.act = 'suggest' AND l.status IN ('pending', 'suggested')) AS sug,
        (d.act = 'clear' AND l.status = 'suggested') AS clr
      FROM ledger_e l LEFT JOIN d ON d.merchant_key = l.merchant_key)
SELECT id, voided,
  CASE WHEN sug THEN dcat WHEN clr THEN NULL ELSE category END AS category,
  CASE WHEN sug THEN 'hermes' WHEN clr THEN NULL ELSE category_src END AS category_src,
  CASE WHEN sug THEN 'suggested' WHEN clr THEN 'pending' ELSE status END AS status, note
FROM j""")

SUGG_SQL = f"""
WITH reqs AS (
  SELECT unnest(related_ids) AS transaction_id, operation, related_ids, reason FROM adv_picked
  WHERE operation IN ('merge', 'offset', 'void', 'split') AND related_ids IS NOT NULL
  UNION ALL
  SELECT l.id, 'none', CAST([] AS BIGINT[]), '' FROM ledger_e l
  WHERE l.status IN ('pending', 'suggested') AND NOT l.voided
    AND l.merchant_key IN (SELECT merchant_key FROM adv_picked WHERE operation = 'none')),
norm0 AS (
  SELECT *, CASE WHEN list_contains(related_ids, transaction_id) THEN related_ids
                 ELSE list_prepend(transaction_id, related_ids) END AS l0 FROM reqs),
norm AS (SELECT *, list_filter(l0, lambda x, i: list_position(l0, x) = i) AS ids FROM norm0),
ups AS (
  SELECT transaction_id, arg_max({{'operation': operation, 'ids': ids, 'reason': reason}},
                                 {{'operation': operation, 'ids': ids}}) AS u
  FROM norm WHERE operation <> 'none' GROUP BY transaction_id),
up AS (SELECT transaction_id, u.operation AS operation, u.ids AS ids, u.reason AS reason FROM ups),
chk AS (
  SELECT x.transaction_id, bool_and(coalesce(NOT lv.voided, false)) AS all_live
  FROM (SELECT transaction_id, unnest(ids) AS ref FROM up) x
  LEFT JOIN ledger_e lv ON lv.id = x.ref AND NOT lv.voided
  GROUP BY x.transaction_id),
good AS (SELECT up.* FROM up JOIN chk USING (transaction_id) WHERE all_live),
bad AS (SELECT up.transaction_id, up.operation, 'transaction not found or voided' AS error
        FROM up JOIN chk USING (transaction_id) WHERE NOT all_live),
newrows AS (
  SELECT transaction_id, operation,
    '[' || array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ', ') || ']' AS related_transaction_ids,
    {strip_sql("coalesce(reason, '')")} AS reason
  FROM good),
kept AS (
  SELECT * FROM suggestions_e
  WHERE transaction_id NOT IN (SELECT transaction_id FROM norm WHERE operation = 'none')
    AND transaction_id NOT IN (SELECT transaction_id FROM newrows))"""
ORACLE["suggestion_upsert"] = with_views(["ledger_e", "adv_picked", "suggestions_e"],
                                         SUGG_SQL + "\nSELECT * FROM kept UNION ALL SELECT * FROM newrows")
ORACLE["suggestion_invalid"] = with_views(["ledger_e", "adv_picked", "suggestions_e"], SUGG_SQL + "\nSELECT * FROM bad")

# ---- notify ----------------------------------------------------------------------

QUEUE_SQL = """
SELECT l.id, l.card_type, l.card_last4, l.txn_time, l.status, l.category, l.merchant_raw, l.amount,
  s.operation AS suggested_operation, s.related_transaction_ids AS suggested_related_ids, s.reason AS suggested_reason
FROM ledger_e l LEFT JOIN suggestions_e s ON s.transaction_id = l.id
WHERE l.notify_status IS NULL AND NOT l.voided"""
ORACLE["notify_queue"] = with_views(["ledger_e", "suggestions_e"], f"""
WITH q AS ({QUEUE_SQL})
SELECT id, card_type, card_last4, txn_time, status, category, merchant_raw, CAST(amount AS DOUBLE) AS amount,
  suggested_operation, suggested_related_ids, suggested_reason FROM q""")

_labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.OPERATION_LABELS.items())
DIGEST_SQL = f"""
WITH q AS ({QUEUE_SQL}),
rows AS (
  SELECT card_type, card_last4, txn_time, id, 0 AS sub,
    ' #' || CAST(id AS VARCHAR) || ' ¥' || CAST(amount AS VARCHAR) || ' ' || substr(coalesce(merchant_raw, ''), 1, 18) || ' ' ||
    CASE WHEN category IS NOT NULL AND category <> '' THEN '→ ' || category ||
              CASE WHEN status IN ('pending', 'suggested') THEN '（AI建议，请确认）' ELSE '' END
         ELSE '→ ❓待分类' END AS line,
    status IN ('pending', 'suggested') AS need_confirm
  FROM q),
g AS (SELECT card_type, card_last4, min({{'t': txn_time, 'i': id}}) AS g FROM q GROUP BY 1, 2),
adv AS (
  SELECT q.*, g.g, CAST(suggested_related_ids AS BIGINT[]) AS ids FROM q JOIN g USING (card_type, card_last4)
  WHERE suggested_operation IN ('merge', 'offset', 'void', 'split')),
adv2 AS (SELECT * FROM adv WHERE len(ids) > 0),
once AS (
  SELECT suggested_operation, ids,
    arg_min({{'card_type': card_type, 'card_last4': card_last4, 'txn_time': txn_time, 'id': id, 'reason': suggested_reason}},
            {{'a': card_type, 'b': g, 'c': txn_time, 'd': id}}) AS r
  FROM adv2 GROUP BY suggested_operation, ids),
o2 AS (
  SELECT r.card_type AS card_type, r.card_last4 AS card_last4, r.txn_time AS txn_time, r.id AS id,
    CASE suggested_operation {_labels} END AS label,
    array_to_string(list_transform(ids, lambda v: '#' || CAST(v AS VARCHAR)), ' ') AS id_text,
    coalesce(nullif(r.reason, ''), '识别到可能的账务操作') AS reason
  FROM once),
digest_lines AS (
SELECT * FROM rows
UNION ALL SELECT card_type, card_last4, txn_time, id, 1, '   💡 建议' || label || ' ' || id_text || '：' || reason, false FROM o2
UNION ALL SELECT card_type, card_last4, txn_time, id, 2, '   如需执行，请回复“确认' || label || ' ' || id_text || '”', false FROM o2)"""
ORACLE["notify_digest"] = with_views(["ledger_e", "suggestions_e"], DIGEST_SQL + "\nSELECT * FROM digest_lines")
ORACLE["digest_message"] = with_views(["ledger_e", "suggestions_e"], DIGEST_SQL + """,
total AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE status IN ('pending', 'suggested')) AS open,
         arg_min(id, {'a': card_type, 'b': txn_time, 'c': id}) AS example FROM q)
SELECT 0 AS section, NULL AS card_type, NULL AS card_last4, NULL::BIGINT AS id, 0 AS sub,
       '📒 tallyframe · 新交易 ' || n || ' 笔' AS line FROM total WHERE n > 0
UNION ALL SELECT 1, card_type, card_last4, NULL, -1,
       CASE WHEN card_type = 'credit' THEN '信用卡' ELSE '借记卡' END || card_last4 FROM g
UNION ALL SELECT 1, card_type, card_last4, id, sub, line FROM digest_lines
UNION ALL SELECT 2, NULL, NULL, NULL, 0, '其中 ' || open || ' 笔需你确认。回复即可改，例：「#' || example || ' 改成孩子相关」'
FROM total WHERE open > 0""")

ORACLE["ledger_after_notify"] = with_views(["ledger_e", "suggestions_e"], f"""
WITH q AS ({QUEUE_SQL})
SELECT l.id, CASE WHEN q.id IS NOT NULL THEN 'sent' ELSE l.notify_status END AS notify_status,
  CASE WHEN q.id IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE l.notified_at END AS notified_at,
  CASE WHEN q.id IS NOT NULL THEN 'mail' END AS notify_channel
FROM ledger_e l LEFT JOIN q ON q.id = l.id""")

ORACLE["freshness"] = with_views(["ledger_e", "deposits_e", "mails_typed", "categories_v", "knowledge_v"], """
SELECT
  (SELECT max(txn_time) FROM ledger_e WHERE NOT voided AND card_type = 'credit') AS last_credit_txn,
  (SELECT max(txn_time) FROM ledger_e WHERE NOT voided AND card_type = 'debit') AS last_debit_txn,
  (SELECT count(*) FROM ledger_e WHERE notify_status = 'sent') AS notify_sent,
  (SELECT max(notified_at) FROM ledger_e WHERE notify_status = 'sent') AS notify_last,
  (SELECT count(*) FROM deposits_e) AS deposits_n,
  (SELECT max(txn_time) FROM deposits_e) AS deposits_last,
  (SELECT max(received) FROM mails_typed WHERE email_type = 'credit_daily') AS last_credit_email,
  (SELECT count(*) FROM categories_v WHERE active = 1) AS categories_n,
  (SELECT count(*) FROM knowledge_v) AS knowledge_n""")

# ---- ingest upserts ----------------------------------------------------------------

ORACLE["txn_insert_ignore"] = with_views(["ledger_e"], """
WITH b AS (
  SELECT *, id AS arrival FROM ledger_e WHERE txn_time >= TIMESTAMP '2024-01-15 00:00:00'
  UNION ALL SELECT *, id + 1000000000 FROM ledger_e WHERE txn_time >= TIMESTAMP '2024-01-25 00:00:00'),
f AS (SELECT fingerprint, arg_min(id, arrival) AS id FROM b GROUP BY fingerprint)
SELECT id, fingerprint, 'pending' AS status, CAST(NULL AS VARCHAR) AS category FROM f
WHERE fingerprint NOT IN (SELECT fingerprint FROM ledger_e WHERE txn_time < TIMESTAMP '2024-01-20 00:00:00')""")

ORACLE["deposit_insert_ignore"] = with_views(["deposits_e"], """
WITH b AS (
  SELECT *, id AS arrival FROM deposits_e WHERE txn_time >= TIMESTAMP '2024-01-15 00:00:00'
  UNION ALL SELECT *, id + 1000000000 FROM deposits_e WHERE txn_time >= TIMESTAMP '2024-01-25 00:00:00'),
f AS (SELECT source_msg_id, arg_min({'id': id, 'amount': amount}, arrival) AS r FROM b GROUP BY source_msg_id)
SELECT r.id AS id, source_msg_id, CAST(r.amount AS DOUBLE) AS amount FROM f
WHERE source_msg_id NOT IN (SELECT source_msg_id FROM deposits_e WHERE txn_time < TIMESTAMP '2024-01-20 00:00:00')""")

ORACLE["category_seed_upsert"] = """
WITH pr AS (SELECT DISTINCT o_orderpriority AS p, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS num FROM orders),
ex AS (SELECT 'p' || CAST(num AS VARCHAR) AS key, p AS name, 'old' AS descr, num % 2 AS active, 10 - num AS sort
       FROM pr WHERE p <> '4-NOT SPECIFIED'),
sd AS (SELECT 'p' || CAST(num AS VARCHAR) AS key, lower(p) AS name, 'seed ' || p AS descr, num - 1 AS position FROM pr)
SELECT coalesce(ex.key, sd.key) AS key, coalesce(sd.name, ex.name) AS name, coalesce(sd.descr, ex.descr) AS descr,
  coalesce(ex.active, 1) AS active, CAST(coalesce(sd.position, ex.sort) AS BIGINT) AS sort
FROM ex FULL OUTER JOIN sd ON ex.key = sd.key"""

ORACLE["orphan_check"] = with_views(["ledger_e", "mails_e"], """
SELECT id, source_msg_id FROM ledger_e
WHERE source_msg_id IS NOT NULL AND source_msg_id NOT IN (SELECT msg_id FROM mails_e)""")

# ---- commands ----------------------------------------------------------------------


def _edits(where: str) -> str:
    return with_views(["ledger_o", "commands_o"], f"""
WITH c AS (SELECT * FROM commands_o WHERE {where}),
pr AS (
  SELECT txn_id AS id,
    arg_max(op = 'void', seq) FILTER (WHERE op IN ('void', 'restore')) AS v,
    arg_max(payload, seq) FILTER (WHERE op = 'set_category') AS cat,
    arg_max(payload, seq) FILTER (WHERE op = 'set_note') AS nt,
    bool_or(op IN ('set_category', 'confirm')) AS conf,
    bool_or(op = 'set_category') AS man
  FROM c GROUP BY txn_id)
SELECT l.id, coalesce(pr.v, l.voided) AS voided, coalesce(pr.cat, l.category) AS category,
  CASE WHEN coalesce(pr.man, false) THEN 'manual' ELSE l.category_src END AS category_src,
  CASE WHEN coalesce(pr.conf, false) THEN 'confirmed' ELSE l.status END AS status,
  coalesce(pr.nt, l.note) AS note
FROM ledger_o l LEFT JOIN pr ON pr.id = l.id""")


ORACLE["ledger_after_void"] = _edits("op IN ('void', 'restore')")
ORACLE["ledger_after_edit"] = _edits("true")

ORACLE["command_validate"] = with_views(["op_requests_e", "categories_v"], f"""
SELECT request_id, operation,
  CASE WHEN operation IN ('merge', 'offset') AND coalesce(len(ids), 0) < 2 THEN 'need at least two transactions'
       WHEN operation = 'void' AND coalesce(len(ids), 0) <> 1 THEN 'void takes exactly one transaction'
       WHEN operation = 'split' AND coalesce(len(ids), 0) <> 1 THEN 'split takes exactly one transaction'
       WHEN operation = 'split' AND coalesce(len(amounts), 0) < 2 THEN 'split needs at least two amounts'
       WHEN operation NOT IN ('merge', 'offset', 'void', 'split') THEN 'unsupported operation'
       WHEN category IS NOT NULL AND category NOT IN {ACTIVE} THEN 'unknown category' END AS error
FROM op_requests_e""").replace("SELECT request_id, operation,\n  CASE", "SELECT request_id, operation, err IS NULL AS ok, err AS error FROM (SELECT request_id, operation,\n  CASE", 1).replace(
    "END AS error\nFROM op_requests_e", "END AS err\nFROM op_requests_e)")

SPLIT_SQL = """
sp AS (
  SELECT s.request_id, s.txn_id, s.amounts, p.amount AS parent_amount, p.voided,
    CASE WHEN p.id IS NULL THEN 'not found' WHEN p.voided THEN 'voided'
         WHEN len(s.amounts) < 2 THEN 'need at least two parts'
         WHEN abs(list_sum(s.amounts) - p.amount) > 0.01 THEN 'parts do not sum' END AS err
  FROM splits_e s LEFT JOIN ledger_e p ON p.id = s.txn_id),
good AS (SELECT * FROM sp WHERE err IS NULL),
kids AS (
  SELECT g.request_id, g.txn_id, unnest(g.amounts) AS part, generate_subscripts(g.amounts, 1) - 1 AS pos FROM good g),
children AS (
  SELECT ('0x' || substr(md5('split:' || k.request_id || ':' || k.pos), 1, 15))::BIGINT AS id, l.fingerprint || '#s' || CAST(k.pos AS VARCHAR) AS fingerprint,
    l.card_last4, l.card_type, l.txn_time, CAST(k.part AS DECIMAL(18,2)) AS amount, l.direction, l.action,
    l.merchant_raw, l.merchant_key, false AS voided, 'pending' AS status, '拆自 #' || CAST(k.txn_id AS VARCHAR) AS note
  FROM kids k JOIN ledger_e l ON l.id = k.txn_id)"""
ORACLE["split_children"] = with_views(["ledger_e", "splits_e"], "WITH " + SPLIT_SQL + """
SELECT id, fingerprint, txn_time, CAST(amount AS DOUBLE) AS amount, merchant_key, status, note FROM children""")
ORACLE["split_then_pair"] = with_views(["ledger_e", "splits_e"], "WITH " + SPLIT_SQL + """,
split_ledger AS (
  SELECT l.id, l.card_last4, l.txn_time, l.amount, l.direction, l.merchant_key,
    (l.voided OR l.id IN (SELECT txn_id FROM good)) AS voided FROM ledger_e l
  UNION ALL SELECT id, card_last4, txn_time, amount, direction, merchant_key, voided FROM children),""" +
    PAIRS_SQL.format(view="split_ledger") + """
SELECT id AS refund_id, pair_id AS expense_id, card_last4, merchant_key,
       CAST(abs(amount) AS DOUBLE) AS amount, txn_time AS refund_time
FROM ann WHERE direction = 'refund' AND pair_id IS NOT NULL""")

MERGE_SQL = f"""
rows AS (SELECT i.request_id, i.pos, l.* FROM merge_ids_e i JOIN ledger_e l ON l.id = i.id AND NOT l.voided),
agg AS (
  SELECT request_id, count(*) AS n, round(sum(amount), 2) AS net,
    arg_min({{'id': id, 'card_last4': card_last4, 'txn_time': txn_time, 'merchant_key': merchant_key}},
            {{'t': txn_time, 'p': pos}}) AS first,
    min({period(15)}) AS first_period
  FROM rows GROUP BY request_id),
res AS (
  SELECT m.*, coalesce(a.n, 0) AS n, a.net, a.first, a.first_period,
    CASE WHEN coalesce(a.n, 0) < 2 THEN 'need at least two live transactions'
         WHEN m.expected_operation = 'offset' AND abs(a.net) >= 0.01 THEN 'net is not zero: cannot offset' END AS err
  FROM merges_e m LEFT JOIN agg a ON a.request_id = m.request_id)"""
ORACLE["merge_net"] = with_views(["ledger_e", "merge_ids_e", "merges_e"], "WITH " + MERGE_SQL + """
SELECT ('0x' || substr(md5('merge:' || request_id), 1, 15))::BIGINT AS id, first.txn_time AS txn_time, CAST(net AS DOUBLE) AS amount,
  CASE WHEN net < 0 THEN 'refund' ELSE 'expense' END AS direction,
  coalesce(month, first_period) AS effective_month,
  CASE WHEN category IS NOT NULL THEN 'confirmed' ELSE 'pending' END AS status, category,
  first.merchant_key AS merchant_key, first.card_last4 AS card_last4
FROM res WHERE err IS NULL AND abs(net) >= 0.01""")
ORACLE["merge_offset"] = with_views(["ledger_e", "merge_ids_e", "merges_e"], "WITH " + MERGE_SQL + """
SELECT request_id, CAST(n AS BIGINT) AS count FROM res WHERE err IS NULL AND abs(net) < 0.01""")
ORACLE["offset_rejected"] = with_views(["ledger_e", "merge_ids_e", "merges_e"], "WITH " + MERGE_SQL + """
SELECT request_id, err AS error, CAST(n AS BIGINT) AS count FROM res WHERE err IS NOT NULL""")

ORACLE["category_rename"] = with_views(["ledger_e"], """
SELECT id, CASE WHEN category = 'cat1' THEN '餐饮' ELSE category END AS category FROM ledger_e""")

ORACLE["category_delete"] = with_views(["ledger_e", "categories_v"], """
WITH k AS (SELECT * FROM (VALUES ('k1'), ('k4'), ('k9'), ('kX')) t(key)),
r AS (SELECT k.key, c.name FROM k LEFT JOIN categories_v c ON c.key = k.key),
u AS (SELECT category AS name, count(*) AS live_n FROM ledger_e WHERE NOT voided AND category IS NOT NULL GROUP BY 1),
j AS (SELECT r.key, r.name, coalesce(u.live_n, 0) AS live_n FROM r LEFT JOIN u ON u.name = r.name)
SELECT key, name,
  CASE WHEN name IS NULL THEN 'category not found' WHEN live_n > 0 THEN 'category still in use' END IS NULL AS ok,
  CASE WHEN name IS NULL THEN 'category not found' WHEN live_n > 0 THEN 'category still in use' END AS error,
  CAST(live_n AS BIGINT) AS live_n
FROM j""")


ORACLE["command_table"] = with_views(["ledger_e"], f"""
WITH asked AS (SELECT * FROM ledger_e WHERE direction = 'expense' AND id % 7 = 0),
good AS (SELECT * FROM asked WHERE NOT voided AND id % 11 <> 0),
mg AS (
  SELECT g.id, n.id AS other, 10 + n.amount AS net, least(g.txn_time, n.txn_time) AS txn_time,
    CASE WHEN n.txn_time < g.txn_time THEN n.card_last4 ELSE g.card_last4 END AS card_last4,
    CASE WHEN n.txn_time < g.txn_time THEN n.merchant_key ELSE g.merchant_key END AS merchant_key,
    ('0x' || substr(md5('merge:m' || g.id), 1, 15))::BIGINT AS into_id
  FROM good g JOIN ledger_e n ON n.id = g.id + 1 AND NOT n.voided WHERE g.id % 14 = 0),
kids AS (
  SELECT g.*, p.pos, ('0x' || substr(md5('split:s' || g.id || ':' || p.pos), 1, 15))::BIGINT AS kid,
         CASE WHEN p.pos = 0 THEN 10 ELSE g.amount - 10 END AS part
  FROM good g, (VALUES (0), (1)) p(pos)),
grand AS (
  SELECT k.*, p.pos AS pos2, ('0x' || substr(md5('split:u' || k.id || ':' || p.pos), 1, 15))::BIGINT AS grandkid,
         CASE WHEN p.pos = 0 THEN 5 ELSE k.amount - 15 END AS part2
  FROM kids k, (VALUES (0), (1)) p(pos) WHERE k.pos = 1 AND k.id % 2 = 1),
merged_note AS (SELECT CASE WHEN net = 0 THEN '{K.NOTE_OFFSET}' ELSE '{K.NOTE_MERGED}' END AS suffix, * FROM mg),
all_rows AS (
  SELECT l.id, l.card_last4, l.merchant_key, l.txn_time, l.direction, l.amount,
    l.voided OR g.id IS NOT NULL OR (c.id IS NOT NULL AND l.id % 11 = 0) OR m.id IS NOT NULL AS voided,
    CASE WHEN l.id % 101 = 0 THEN 'c70' ELSE l.category END AS category,
    CASE WHEN l.id % 5 = 0 OR l.id % 101 = 0 THEN 'confirmed' ELSE l.status END AS status,
    CASE WHEN c.id IS NOT NULL AND l.id % 5 = 0 THEN 'after'
         WHEN g.id IS NOT NULL THEN coalesce(l.note, '') || '{K.NOTE_SPLIT}'
         WHEN m.id IS NOT NULL THEN coalesce(l.note, '') || m.suffix ELSE l.note END AS note,
    CASE WHEN m.net <> 0 THEN m.into_id END AS merged_into
  FROM ledger_e l LEFT JOIN asked c ON c.id = l.id LEFT JOIN good g ON g.id = l.id LEFT JOIN merged_note m ON m.other = l.id
  UNION ALL
  SELECT k.kid, k.card_last4, k.merchant_key, k.txn_time, k.direction, k.part,
    (k.pos = 1 AND k.id % 2 = 1) OR (k.pos = 0 AND m.id IS NOT NULL),
    CASE WHEN k.pos = 0 AND k.id % 3 = 0 THEN 'cat2' END, CASE WHEN k.pos = 0 AND k.id % 3 = 0 THEN 'confirmed' ELSE 'pending' END,
    '{K.NOTE_SPLIT_FROM}' || k.id || CASE WHEN k.pos = 1 AND k.id % 2 = 1 THEN '{K.NOTE_SPLIT}'
                                          WHEN k.pos = 0 AND m.id IS NOT NULL THEN m.suffix ELSE '' END,
    CASE WHEN k.pos = 0 AND m.net <> 0 THEN m.into_id END
  FROM kids k LEFT JOIN merged_note m ON m.id = k.id
  UNION ALL
  SELECT grandkid, card_last4, merchant_key, txn_time, direction, part2, false, NULL, 'pending', '{K.NOTE_SPLIT_FROM}' || kid, NULL FROM grand
  UNION ALL
  SELECT into_id, card_last4, merchant_key, txn_time, CASE WHEN net < 0 THEN 'refund' ELSE 'expense' END, net, false, NULL, 'pending', NULL, NULL
  FROM mg WHERE net <> 0),""" + PAIRS_SQL.format(view="all_rows") + """
SELECT r.id, CAST(r.amount AS DOUBLE) AS amount, r.voided OR a.pair_id IS NOT NULL AS voided, r.category, r.status, r.note,
  r.merged_into, a.pair_id AS offset_of
FROM all_rows r LEFT JOIN ann a ON a.id = r.id""")

ORACLE["merge_overlap"] = with_views(["ledger_e"], """
WITH r AS (
  SELECT id // 4 AS four, max(CASE WHEN id % 4 = 0 AND NOT voided THEN amount END) AS r0, max(CASE WHEN id % 4 = 1 AND NOT voided THEN amount END) AS r1,
    max(CASE WHEN id % 4 = 2 AND NOT voided THEN amount END) AS r2, max(CASE WHEN id % 4 = 3 AND NOT voided THEN amount END) AS r3,
    count(*) FILTER (WHERE id % 4 IN (0, 1)) AS na, count(*) FILTER (WHERE id % 4 IN (1, 2)) AS nb, count(*) FILTER (WHERE id % 4 IN (2, 3)) AS nc
  FROM ledger_e GROUP BY 1),
a AS (SELECT *, r0 IS NOT NULL AND r1 IS NOT NULL AS ok_a FROM r),
b AS (SELECT *, NOT ok_a AND r1 IS NOT NULL AND r2 IS NOT NULL AS ok_b FROM a),
c AS (SELECT *, NOT ok_b AND r2 IS NOT NULL AND r3 IS NOT NULL AS ok_c FROM b),
res AS (
  SELECT 'a' || four AS request_id, ok_a AS ok, CASE WHEN ok_a THEN r0 + r1 END AS net, (r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT AS n FROM c WHERE na > 0
  UNION ALL SELECT 'b' || four, ok_b, CASE WHEN ok_b THEN r1 + r2 END, (r1 IS NOT NULL AND NOT ok_a)::INT + (r2 IS NOT NULL)::INT FROM c WHERE nb > 0
  UNION ALL SELECT 'c' || four, ok_c, CASE WHEN ok_c THEN r2 + r3 END, (r2 IS NOT NULL AND NOT ok_b)::INT + (r3 IS NOT NULL)::INT FROM c WHERE nc > 0)
SELECT request_id, ok, CASE WHEN NOT ok THEN 'need at least two live transactions' END AS error, ok AND net = 0 AS offset,
  CAST(net AS DOUBLE) AS net, CAST(n AS BIGINT) AS count FROM res""")

ORACLE["alert_deposits"] = with_views(["alert_kept"], """
SELECT source_msg_id, card_last4, CAST(strptime(txn_time, '%Y-%m-%d %H:%M') AS TIMESTAMP) AS txn_time,
       CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount, kind, counterparty AS payer, note
FROM alert_kept WHERE error IS NULL AND type = 'income'""")
ORACLE["alert_totals"] = with_views(["alert_kept"], """
SELECT CASE WHEN type = 'income' THEN 'income' ELSE 'unrouted' END AS kind, count(*) AS n
FROM alert_kept WHERE error IS NULL GROUP BY 1""")
ORACLE["classify_counters"] = with_views(["adv_picked", "categories_v"], f"""
SELECT (SELECT count(*) FROM ({VALID_DEC})) + (SELECT count(*) FROM ({UNSURE_DEC})) AS merchants,
       (SELECT count(*) FROM ({VALID_DEC})) AS suggested, (SELECT count(*) FROM ({UNSURE_DEC})) AS uncertain""")
ORACLE["category_update"] = with_views(["ledger_e"], """
SELECT CASE WHEN category = 'cat1' THEN '餐饮' ELSE category END AS category, count(*) AS n FROM ledger_e GROUP BY 1""")
ORACLE["edit_results"] = with_views(["ledger_o", "commands_o"], """
SELECT c.txn_id, c.seq, c.op, l.id IS NOT NULL AS ok, CASE WHEN l.id IS NULL THEN 'not found' END AS error
FROM commands_o c LEFT JOIN ledger_o l ON l.id = c.txn_id""")
ORACLE["mail_scan"] = with_views(["mails_e"], f"SELECT *, {ROUTER_CASE} AS email_type FROM mails_e")

# ---- JSON output: nulls are left out, times with milliseconds ---------------------------
_json_fields = [
    ("id", "id::VARCHAR"), ("card_last4", "to_json(card_last4)::VARCHAR"), ("card_type", "to_json(card_type)::VARCHAR"),
    ("txn_time", """'"' || strftime(txn_time, '%Y-%m-%dT%H:%M:%S.%g') || '"'"""), ("amount", "amount::VARCHAR"),
    *[(c, f"to_json({c})::VARCHAR") for c in ("direction", "merchant_raw", "merchant_key", "category", "status")],
    ("voided", "voided::VARCHAR"), ("offset_of", "offset_of::VARCHAR"), ("merged_into", "merged_into::VARCHAR"),
    ("effective_month", "to_json(effective_month)::VARCHAR"), ("note", "to_json(note)::VARCHAR")]
_json_parts = ", ".join(f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || {v} END""" for c, v in _json_fields)
ORACLE["ledger_json_export"] = with_views(["ledger_e"], f"""
WITH l AS (SELECT {LIST_COLS} FROM ledger_e)
SELECT '{{' || array_to_string(list_filter([{_json_parts}], lambda x: x IS NOT NULL), ',') || '}}' AS json FROM l""")

ORACLE["spend_rollup"] = with_views(["ledger_o"], f"""
WITH r AS (SELECT {month_expr(15)} AS m, substr({month_expr(15)}, 1, 4) AS y, coalesce(category, '__uncat__') AS c, amount
           FROM ledger_o WHERE NOT voided AND direction IN {SPEND})
SELECT y, m, c, CAST(grouping(y, m, c) AS INTEGER) AS level, {money('sum(amount)')} AS spend, count(*) AS n
FROM r GROUP BY ROLLUP (y, m, c)""")

ORACLE["digest_text"] = with_views(["ledger_e", "suggestions_e"], DIGEST_SQL + """,
cum AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY card_type, card_last4 ORDER BY txn_time, id, sub
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM digest_lines),
parts AS (SELECT *, CAST(floor(before / 4000) AS INTEGER) AS part FROM cum)
SELECT card_type, card_last4, part, count(*) AS n_lines,
  CASE WHEN card_type = 'credit' THEN '信用卡' ELSE '借记卡' END || card_last4 || chr(10) ||
  string_agg(line, chr(10) ORDER BY txn_time, id, sub) AS text
FROM parts GROUP BY 1, 2, 3""")

ORACLE["txn_batch_stats"] = with_views(["ledger_e"], """
WITH b AS (
  SELECT fingerprint FROM ledger_e WHERE txn_time >= TIMESTAMP '2024-01-15 00:00:00'
  UNION ALL SELECT fingerprint FROM ledger_e WHERE txn_time >= TIMESTAMP '2024-01-25 00:00:00'),
f AS (SELECT DISTINCT fingerprint FROM b
      WHERE fingerprint NOT IN (SELECT fingerprint FROM ledger_e WHERE txn_time < TIMESTAMP '2024-01-20 00:00:00'))
SELECT (SELECT count(*) FROM f) AS inserted, (SELECT count(*) FROM f) AS pending, (SELECT count(*) FROM b) - (SELECT count(*) FROM f) AS dup""")

WIDE_SQL = """
m AS (SELECT DISTINCT 'u ' || user_id || ' ' || event_type AS merchant_key, user_id, user_id // 8 AS batch_id FROM events),
a AS (
  SELECT batch_id, CASE user_id % 4 WHEN 0 THEN merchant_key WHEN 1 THEN merchant_key || ' (2笔)' WHEN 2 THEN 'u ' || user_id
                        ELSE 'x' || merchant_key END AS adv_key,
    user_id * 10 + length(merchant_key) AS pos, 'cat' || user_id % 3 AS category FROM m)"""
ORACLE["advice_prefix_wide"] = f"""
WITH {WIDE_SQL},
c AS (
  SELECT m.merchant_key, a.adv_key, a.category, row_number() OVER (PARTITION BY m.merchant_key ORDER BY a.adv_key <> m.merchant_key, a.pos) AS r
  FROM m JOIN a ON a.batch_id = m.batch_id AND (starts_with(a.adv_key, m.merchant_key) OR starts_with(m.merchant_key, a.adv_key)))
SELECT m.merchant_key, c.adv_key, c.category FROM m LEFT JOIN c ON c.merchant_key = m.merchant_key AND c.r = 1"""
ORACLE["classification_batches"] = f"""
WITH {WIDE_SQL} SELECT count(*) AS merchants, true AS each_once, true AS bounded FROM m"""
ORACLE["sql_functions"] = with_views(["ledger_o"], f"""
SELECT id, {period(15)} AS p15, {month_expr(15)} AS m, CAST(greatest(1, least(28, id % 40)) AS INTEGER) AS d, direction IN {SPEND} AS spend
FROM ledger_o""")

# ---- streams ---------------------------------------------------------------------
STREAM_ROWS = """
dx AS ({digest}), al AS ({alert}),
every AS (
  SELECT fingerprint, card_last4, 'credit' AS card_type, txn_time, amount, direction, merchant_key, channel FROM dx
  UNION ALL SELECT fingerprint, card_last4, card_type, txn_time, amount, direction, merchant_key, channel FROM al),
inserted AS (SELECT DISTINCT ON (fingerprint) *, fingerprint AS id, false AS voided FROM every)"""


ORACLE["stream_ledger"] = "WITH RECURSIVE " + STREAM_ROWS.format(digest=ORACLE["digest_extract"], alert=ORACLE["alert_route"]) + "," + \
    PAIRS_SQL.format(view="inserted") + """
SELECT i.fingerprint, i.card_last4, i.card_type, i.txn_time, i.amount, i.direction, i.merchant_key, i.channel, 'pending' AS status,
  a.pair_id IS NOT NULL AS voided, a.pair_id AS pair_fingerprint
FROM inserted i LEFT JOIN ann a ON a.id = i.id"""
ORACLE["stream_deposits"] = ORACLE["alert_deposits"]
_digest_mails = """SELECT DISTINCT 'g' || CAST(user_id AS VARCHAR) || '-' || strftime(digest_date, '%Y%m%d') || '-' || CAST(part AS VARCHAR) AS msg_id,
  digest_date FROM digest_src"""
STREAM_LOG = f"""
dm AS ({_digest_mails}),
log AS (
  SELECT msg_id, 'credit_daily' AS email_type, 'parsed' AS status FROM dm
  UNION ALL SELECT s.source_msg_id, 'debit_event', CASE WHEN k.source_msg_id IS NOT NULL THEN 'parsed' ELSE 'skipped' END
  FROM alert_src s LEFT JOIN alert_kept k ON k.source_msg_id = s.source_msg_id WHERE k.error IS NULL)"""
ORACLE["stream_mail_log"] = with_views(["digest_src", "alert_src", "alert_kept"], f"WITH {STREAM_LOG} SELECT * FROM log")
ORACLE["run_totals"] = with_views(["digest_src", "alert_src", "alert_kept"], "WITH " + STREAM_LOG + "," + STREAM_ROWS.format(
    digest=ORACLE["digest_extract"], alert=ORACLE["alert_route"]) + """,
t AS (
  SELECT 'inserted' AS total, count(*) AS n FROM inserted UNION ALL SELECT 'pending', count(*) FROM inserted
  UNION ALL SELECT 'dup', (SELECT count(*) FROM every) - (SELECT count(*) FROM inserted)
  UNION ALL SELECT 'income', count(*) FROM alert_kept WHERE error IS NULL AND type = 'income'
  UNION ALL SELECT 'waiting', count(*) FROM alert_kept WHERE error IS NOT NULL
  UNION ALL SELECT 'already_seen', count(*) FROM dm WHERE day(digest_date) <= 3
  UNION ALL SELECT email_type || ':' || status, count(*) FROM log GROUP BY 1)
SELECT * FROM t WHERE n > 0""")
ORACLE["stream_pairs"] = ORACLE["refund_pairs"]
ORACLE["stream_dedup"] = with_views(["mails_e"], "SELECT DISTINCT msg_id FROM mails_e")
ORACLE["stream_incremental"] = ORACLE["incremental_scan"]
