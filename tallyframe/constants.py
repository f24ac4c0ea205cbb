"""Fixed values that must equal the reference behaviour for identical results.

Everything in this module is data, kept in its natural order and spelled out
plainly; the operators read it from here.
"""
from __future__ import annotations

# ---- fixed values: action word -> ledger direction (default 'other') ----------
DIRECTION_BY_ACTION = {
    "消费": "expense",
    "退货": "refund",
    "撤销": "refund",
    "取现": "withdraw",
    "预借现金": "withdraw",
    "还款": "repayment",
    "快捷支付扣款": "expense",
    "快捷支付": "expense",
    "网上支付": "expense",
    "自助转账": "transfer",
    "跨行转账": "transfer",
    "转账": "transfer",
    "代扣": "expense",
    "扣款": "expense",
    "结息": "income",
    "利息": "income",
    "入账": "income",
    "工资": "income",
    "手续费": "fee",
    "费用": "fee",
    "分期": "installment",
}

# ---- fixed values: payment channels that prefix a merchant as "<channel>-<merchant>"
KNOWN_CHANNELS = ("支付宝", "财付通", "微信", "微信支付", "银联")

# ---- fixed values: directions that count as spend ----------------------------
SPEND_DIRECTIONS = ("expense", "refund", "fee", "withdraw")

# ---- fixed values: statuses still waiting for the user ------------------------
OPEN_STATUSES = ("pending", "suggested")

# ---- fixed values: operations an advice row may carry -------------------------
VALID_OPERATIONS = ("merge", "offset", "void", "split")

# ---- fixed values: mail router -------------------------------------------------
CREDIT_DAILY_SENDER = "ccsvc@message.cmbchina.com"
DEBIT_SENDER = "95555@message.cmbchina.com"
BANK_DOMAIN_TOKEN = "cmbchina"
CREDIT_DAILY_SUBJECT_TOKEN = "每日信用管家"
STATEMENT_SUBJECT_TOKENS = ("账单", "帳單")
DEBIT_EVENT_SUBJECT_TOKEN = "账户变动"
HK_SUBJECT_TOKEN = "香港"
HK_STATEMENT_SUBJECT_TOKENS = ("月結單", "月结单")
MARKETING_SUBJECT_TOKENS = ("拒收", "退订", "优惠", "分期", "额度", "礼包")
DEBIT_ALERT_SUBJECT = "一卡通账户变动通知"

# Mail types produced by the router.
CREDIT_DAILY = "credit_daily"
DEBIT_EVENT = "debit_event"
CREDIT_STATEMENT = "credit_statement"
HK_STATEMENT = "hk_statement"
MARKETING = "marketing"
OTHER = "other"
MAIL_TYPES = (CREDIT_DAILY, DEBIT_EVENT, CREDIT_STATEMENT, HK_STATEMENT, MARKETING, OTHER)

# ---- fixed values: daily digest line patterns (Java regex, Unicode classes) ---
RE_AVAIL = r"(?U)^￥\s*([\d,]+\.\d{2})$"
RE_POINTS = r"(?U)^([\d,]+)$"
RE_DATE = r"(?U)(\d{4})/(\d{2})/(\d{2})\s*您的消费明细"
RE_TIME = r"(?U)^(\d{2}:\d{2}:\d{2})$"
RE_AMOUNT = r"(?U)^CNY\s*(-?[\d,]+\.\d{1,2})$"
RE_DETAIL = r"(?U)^尾号(\d{4})\s+(\S+)\s+(.+)$"
DIGEST_LOOKAHEAD = 3

# ---- fixed values: AI alert taxonomy -------------------------------------------
ALERT_EXPENSE = "expense"
ALERT_TRANSFER_OUT = "transfer_out"
ALERT_INCOME = "income"
ALERT_IGNORE = "ignore"
ALERT_TYPES = (ALERT_EXPENSE, ALERT_TRANSFER_OUT, ALERT_INCOME, ALERT_IGNORE)
MERGE_ACTION = "合并"
TRANSFER_ACTION = "转账"
EXPENSE_ACTION = "消费"

# ---- fixed values: note suffixes written by commands ----------------------------
NOTE_SPLIT = " [已拆分]"
NOTE_OFFSET = " [已抵消]"
NOTE_MERGED = " [已合并]"
NOTE_SPLIT_FROM = "拆自 #"
UNCAT = "__uncat__"
UNCAT_LABEL = "未分类"

# ---- fixed values: HTML entities decoded by the text flattener -------------------
# (name, replacement, decoded without the trailing ';' as browsers do)
HTML_ENTITIES = (
    ("lt", "<", True),
    ("gt", ">", True),
    ("quot", '"', True),
    ("apos", "'", False),
    ("nbsp", "\u00a0", True),
    ("copy", "©", True),
    ("reg", "®", True),
    ("middot", "·", True),
    ("yen", "¥", True),
    ("#39", "'", False),
    ("amp", "&", True),
)

# Received-time zone of the mailbox wall clock.
LOCAL_ZONE = "Asia/Shanghai"

# Default page sizes.
PAGE_LEDGER = 200
PAGE_DEPOSITS = 500
PAGE_PENDING = 20
RECENT_PER_MERCHANT = 20
CLASSIFY_BATCH = 40

# ---- fixed values: notifier ------------------------------------------------------
UNCERTAIN_STATUSES = ("pending", "suggested")
OPERATION_LABELS = {
    "merge": "合并",
    "offset": "抵消",
    "void": "不计入",
    "split": "拆分",
}
CARD_LABELS = {"credit": "信用卡", "debit": "借记卡"}
DIGEST_TITLE = "📒 %s · 新交易 %d 笔"
DIGEST_FOOTER = "其中 %d 笔需你确认。回复即可改，例：「#%d 改成孩子相关」"
CATEGORY_SRC_AI = "hermes"
CATEGORY_SRC_MANUAL = "manual"

# ---- fixed values: HTML patterns of the text flattener ---------------------------
RE_SCRIPT_STYLE = r"(?is)<script.*?</script>|<style.*?</style>"
RE_BR = r"(?is)<br[\t\n\x0b\x0c\r ]*/?>"
RE_BLOCK_CLOSE = r"(?is)</(td|tr|div|p|table|li|h[1-6])>"
RE_ANY_TAG = r"(?s)<[^>]+>"
RE_INLINE_WS = "[ \t\u00a0]+"

# ---- fixed values: texts of the amount hint ---------------------------------------
HINT_FIXED = "笔，金额固定"
HINT_AMOUNTS = "笔，金额"
HINT_VARIES = "不等"

# ---- fixed values: texts of the digest lines ---------------------------------------
TAG_CATEGORY = "→ "
TAG_CONFIRM = "（AI建议，请确认）"
TAG_OPEN = "→ ❓待分类"
ADVICE_REASON = "识别到可能的账务操作"
ADVICE_LEAD = "   💡 建议"
ADVICE_REPLY = "   如需执行，请回复“确认"
ADVICE_COLON = "："
ADVICE_CLOSE = "”"
