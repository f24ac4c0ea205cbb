"""Scalar text, money and JSON column functions.

All of them are built from JVM-side expressions (regexp_replace, split,
higher-order functions, sha1, from_json) and need no Python worker. Those with
higher-order functions are evaluated row by row outside whole-stage codegen.
"""
from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Characters Python's str.strip()/str.isspace() treat as white space, as one
# explicit class (Java regex syntax; also valid RE2 syntax for the oracle).
WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# The standard library's entity table: names with their ';', and those valid without it. As one text for a plan,
# names under their first letter, so that a look-up passes over few of them.
_NAMED = json.dumps({c: {n: v for n, v in html5.items() if n[0] == c} for c in sorted({n[0] for n in html5})})
#: Looked for first, with their ';': nearly all that pages hold.
_COMMON = ("amp", "nbsp", "quot", "lt", "gt", "copy", "middot", "apos")
_BARE = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
# What numeric references 128 to 159 stand for: Windows-1252, where it has a character.
_WINDOWS_1252 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _code_point(code: Column) -> Column:
    """The character of a code point; U+FFFD where there is none, nothing for control codes."""
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = ((code >= 1) & (code <= 8)) | ((code >= 14) & (code <= 31)) | (code == 11) | ((code >= 127) & (code < 160))
    windows = F.element_at(F.array(*[F.lit(c) for c in _WINDOWS_1252]), (code - 127).cast("int"))
    return (F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | ((code >= 0xD800) & (code <= 0xDFFF)), "\ufffd")
            .when((code >= 128) & (code < 160), windows).when(control, "").otherwise(text))


def unescape_entities(c: Column) -> Column:
    """Decode all named and numeric HTML entities in one pass, as browsers do.

    The text is cut at '&'; each piece starts with what may be an entity. The
    few common names are looked at first, then numbers, then the standard library's
    table; names that are valid without ';' also match as a prefix, the longest first.
    """
    names = F.from_json(F.lit(_NAMED), "map<string,map<string,string>>")

    def value_of(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, "^#([0-9]+);?", 1)
        hexed = F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1)
        named = F.regexp_extract(p, "^([0-9A-Za-z]+;)", 1)
        short = F.regexp_extract(p, _BARE, 1)
        number = F.when(digits != "", digits.try_cast("bigint")).otherwise(
            F.conv(F.substring(F.regexp_replace(hexed, "^0+", ""), 1, 8), 16, 10).try_cast("bigint"))
        head = F.regexp_extract(p, "^(#(?:[0-9]+|[xX][0-9a-fA-F]+);?)", 1)
        plain = F.concat(F.lit("&"), p)
        out = None
        for name in _COMMON:
            rest = F.concat(F.lit(html5[name + ";"]), F.substr(p, F.lit(len(name) + 2)))
            on = F.startswith(p, F.lit(name + ";"))
            out = F.when(on, rest) if out is None else out.when(on, rest)
        return (out.when(F.startswith(p, F.lit("#")), F.when(head != "", F.concat(_code_point(number), F.substr(p, F.length(head) + 1)))
                         .otherwise(plain))
                .when(~F.rlike(p, F.lit("^[0-9A-Za-z]")), plain)
                .when(value_of(named).isNotNull(), F.concat(value_of(named), F.substr(p, F.length(named) + 1)))
                .when(F.rlike(p, F.lit(_BARE)), F.concat(value_of(short), F.substr(p, F.length(short) + 1)))
                .otherwise(plain))

    parts = F.split(c, "&")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(F.contains(c, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(tail, ""))).otherwise(c)


def strip_ws(c: Column) -> Column:
    """Python-style ``str.strip()``."""
    return F.regexp_replace(c, F.lit(f"^{WS_CLASS}+|{WS_CLASS}+$"), F.lit(""))


def html_to_lines(html: Column | str) -> Column:
    """Visible text of an HTML body as an array of trimmed, non-empty lines (B1)."""
    t = _c(html)
    t = F.regexp_replace(t, F.lit(K.RE_SCRIPT_STYLE), F.lit(" "))
    t = F.regexp_replace(t, F.lit(K.RE_BR), F.lit("\n"))
    t = F.regexp_replace(t, F.lit(K.RE_BLOCK_CLOSE), F.lit("\n"))
    t = F.regexp_replace(t, F.lit(K.RE_ANY_TAG), F.lit(" "))
    t = unescape_entities(t)
    trimmed = F.transform(F.split(t, "\n"), lambda ln: strip_ws(F.regexp_replace(ln, F.lit(K.RE_INLINE_WS), F.lit(" "))))
    return F.filter(trimmed, lambda ln: ln != F.lit(""))


def html_flat_text(text: Column | str, html: Column | str) -> Column:
    """Flat body (B2): the plain part, else the de-tagged HTML; white space collapsed."""
    plain = F.nullif(_c(text), F.lit(""))
    detagged = F.regexp_replace(_c(html), F.lit(r"(?is)<[^>]+>"), F.lit(" "))
    body = F.coalesce(plain, detagged, F.lit(""))
    return strip_ws(F.regexp_replace(body, F.lit(f"{WS_CLASS}+"), F.lit(" ")))


def _any_contains(c: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in tokens])


def mail_type(sender: Column | str, subject: Column | str) -> Column:
    """Ordered sender/subject rules -> one of six mail types."""
    s = F.lower(F.coalesce(_c(sender), F.lit("")))
    subj = F.coalesce(_c(subject), F.lit(""))
    is_daily = F.contains(s, F.lit(K.CREDIT_DAILY_SENDER))
    is_debit = F.contains(s, F.lit(K.DEBIT_SENDER))
    is_bank = F.contains(s, F.lit(K.BANK_DOMAIN_TOKEN))
    statement = _any_contains(subj, K.STATEMENT_SUBJECT_TOKENS)
    return (
        F.when(is_daily & F.contains(subj, F.lit(K.CREDIT_DAILY_SUBJECT_TOKEN)), F.lit(K.CREDIT_DAILY))
        .when(is_daily & statement, F.lit(K.CREDIT_STATEMENT))
        .when(is_daily, F.lit(K.OTHER))
        .when(is_debit & F.contains(subj, F.lit(K.DEBIT_EVENT_SUBJECT_TOKEN))
              & ~F.contains(subj, F.lit(K.HK_SUBJECT_TOKEN)), F.lit(K.DEBIT_EVENT))
        .when(is_debit, F.lit(K.OTHER))
        .when(is_bank & _any_contains(subj, K.HK_STATEMENT_SUBJECT_TOKENS), F.lit(K.HK_STATEMENT))
        .when(is_bank & statement, F.lit(K.CREDIT_STATEMENT))
        .when(_any_contains(subj, K.MARKETING_SUBJECT_TOKENS), F.lit(K.MARKETING))
        .otherwise(F.lit(K.OTHER))
    )


def direction_of(action: Column | str) -> Column:
    """Action word -> direction through a literal map, default 'other' (B4)."""
    m = F.create_map(*[F.lit(x) for kv in K.DIRECTION_BY_ACTION.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(action)), F.lit("other"))


def merchant_split(raw: Column | str) -> tuple[Column, Column]:
    """Split '<channel>-<merchant>' on the first '-' (B5).

    Returns (channel, merchant_key). The channel is kept only when it is a known
    one and the remainder is non-empty; otherwise (null, trimmed raw).
    """
    raw = _c(raw)
    has_dash = F.contains(raw, F.lit("-"))
    pos = F.instr(raw, "-")
    head = strip_ws(F.substring_index(raw, "-", 1))
    rest = strip_ws(raw.substr(pos + 1, F.length(raw)))
    ok = has_dash & head.isin(*K.KNOWN_CHANNELS) & (rest != F.lit(""))
    channel = F.when(ok, head)
    key = F.when(ok, rest).otherwise(strip_ws(raw))
    return channel, key


def money_text(amount: Column | str) -> Column:
    """Two-decimal text of an amount, half-up on the decimal value (no float rounding)."""
    return _c(amount).cast("decimal(18,2)").cast("string")


def fingerprint(card_last4, txn_time, amount, merchant_raw, action) -> Column:
    """sha1 over card | time text | %.2f amount | merchant_raw | action.

    Null fields print as 'None', the text the reference's formatting produces.
    """
    def txt(c):
        return F.coalesce(_c(c).cast("string"), F.lit("None"))
    t = F.coalesce(F.date_format(_c(txn_time), "yyyy-MM-dd HH:mm:ss"), F.lit("None"))
    parts = [txt(card_last4), t, F.coalesce(money_text(amount), F.lit("None")),
             txt(merchant_raw), txt(action)]
    return F.sha1(F.concat_ws("|", *parts))


def parse_amount(s: Column | str, scale: int = 2) -> Column:
    """Thousands-separated number text -> decimal; unparsable -> null."""
    return F.regexp_replace(_c(s), F.lit(","), F.lit("")).try_cast(f"decimal(18,{scale})")


def parse_int(s: Column | str) -> Column:
    """Thousands-separated integer text -> BIGINT; unparsable -> null (B7, points)."""
    return F.regexp_replace(_c(s), F.lit(","), F.lit("")).try_cast("bigint")


def json_object_text(text: Column | str) -> Column:
    """First '{' to last '}' of a reply, else '{}' (B13)."""
    m = F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)
    return F.when(F.coalesce(m, F.lit("")) == F.lit(""), F.lit("{}")).otherwise(m)


def received_local(received_utc: Column | str, fallback: Column | None = None,
                   zone: str = K.LOCAL_ZONE) -> Column:
    """Received instant (UTC, NTZ) -> naive wall clock in the mailbox zone.

    Unparsable/missing values fall back to ``fallback`` (the ingestion time of
    the batch, passed in by the caller so the result is reproducible).
    """
    conv = F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(received_utc))
    return conv if fallback is None else F.coalesce(conv, fallback)


def amount_hint_text(n: Column, distinct_sorted: Column) -> Column:
    """Money hint per merchant (B15): fixed / slash list (<= 4) / min~max."""
    k = F.size(distinct_sorted)
    as_txt = F.transform(distinct_sorted, lambda x: x.cast("decimal(18,2)").cast("string"))
    first = F.element_at(as_txt, 1)
    last = F.element_at(as_txt, -1)
    return (F.when(k == 1, F.concat(n.cast("string"), F.lit(K.HINT_FIXED), first))
            .when(k <= 4, F.concat(n.cast("string"), F.lit(K.HINT_AMOUNTS), F.array_join(as_txt, "/")))
            .otherwise(F.concat(n.cast("string"), F.lit(K.HINT_AMOUNTS), first, F.lit("~"), last,
                                F.lit(K.HINT_VARIES))))
