"""Operator 6, URL filters [native]: a temporal list join.

Lists change over time: an entry says that from a day on, a key (a host, a domain, or a host with a path
prefix) is blocked, allowed, or off the list. Sorted by day, the entries of one list and key become
validity intervals [from, until). A capture offers its own keys, from the most to the least specific: host
with path prefixes, host, parent domains of two or more labels, as far as the lists hold keys of that many
steps or labels, and is evaluated against the entries that were active when it
was fetched. That is an as-of join: intervals are cut at months, captures know their month, and the join
is an equi-join on key and month that keeps the one interval of each list that holds the fetch time. A
key that never changes costs one row a month; a host with a third of all captures is a skewed join key,
which Spark splits, as the other side has few rows for each key and month.

The verdict of a capture is that of its most specific active entry; among equally specific ones "allow"
beats "block". Without an active entry a capture is kept.

Defined cases: hosts are compared in lower case without user, port, "www." and a final stop; a null or
malformed URL has no host, matches nothing and is kept with a null host; a null fetch time matches
nothing; two entries of one list and key on one day: the later in code point order of the action stands;
repeated captures are judged each.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import read_table

FOREVER = "9999-12-31"
DAYS = 730
START = "2023-01-01"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port, "www." and a final stop; null if there is none."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "\\.$", ""), "^www\\.", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column, steps_most: Column | None = None, labels_least: Column | None = None) -> Column:
    """Array of (key, weight): path prefixes, host and parent domains; more specific ones weigh more.

    Prefixes of more than ``steps_most`` steps and parents of fewer than ``labels_least`` labels may be left
    out, when no list has such keys; by default none is.
    """
    host = host_of(url)
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    labels = F.split(host, "\\.")
    deepest = F.size(steps) if steps_most is None else F.least(F.size(steps), steps_most)
    highest = F.size(labels) - (F.lit(2) if labels_least is None else F.greatest(F.lit(2), labels_least))
    up_to = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(up_to(deepest), lambda n: F.struct(
        F.concat_ws("/", F.array(host), F.slice(steps, 1, n)).alias("key"), n.alias("weight")))
    parents = F.transform(up_to(highest), lambda n: F.struct(
        F.array_join(F.slice(labels, n + 1, F.size(labels) - n), ".").alias("key"), (-n).alias("weight")))
    own = F.array(F.struct(host.alias("key"), F.lit(0).alias("weight")))
    none = F.array().cast("array<struct<key:string,weight:int>>")
    return F.when(host.isNotNull(), F.concat(prefixes, own, parents)).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, active_from, active_until) from dated entries (list, key, action, day)."""
    daily = entries.groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    by_key = Window.partitionBy("list", "key").orderBy("day")
    rows = daily.withColumn("active_until", F.coalesce(F.lead("day").over(by_key), F.lit(FOREVER).cast("date")))
    return rows.where(F.col("action").isin("block", "allow")).select(
        "list", "key", "action", F.col("day").alias("active_from"), "active_until")


def month_of(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (capture_id, url, fetched) with host, n_active, key, list, action, active_from, keep."""
    span = captures.agg(F.min(month_of(F.col("fetched"))).alias("lo"), F.max(month_of(F.col("fetched"))).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    valid = intervals(entries)
    first = F.greatest(month_of(F.col("active_from")), F.lit(lo))
    last = F.least(month_of(F.date_sub("active_until", 1)), F.lit(hi))
    valid = valid.withColumns({"first": first, "last": last}).where("first <= last")
    valid = valid.select("list", "key", "action", "active_from", "active_until",
                         F.explode(F.sequence("first", "last")).alias("month"))
    # keys beyond the lists' own depth match nothing; what the lists need is one row of two numbers
    parts = F.split("key", "/")
    need = entries.agg(F.max(F.size(parts) - 1).alias("steps"), F.min(F.size(F.split(parts[0], "\\."))).alias("labels")).first()
    keys = keys_of(F.col("url"), F.lit(need["steps"] or 0), F.lit(need["labels"] or 2))
    asked = captures.select("capture_id", "url", "fetched", F.explode(keys).alias("k"))
    asked = asked.select("capture_id", "url", "fetched", "k.key", "k.weight", month_of(F.col("fetched")).alias("month"))
    met = asked.join(valid, ["key", "month"]).where("fetched >= active_from AND fetched < active_until")
    rank = F.struct("weight", (F.col("action") == "allow").alias("allowed"), "list")
    told = F.struct("key", "list", "action", "active_from")
    best = met.groupBy("capture_id", "url", "fetched").agg(
        F.countDistinct("list", "key").alias("n_active"), F.max_by(told, rank).alias("best"))
    best = best.select(F.col("capture_id").alias("c"), F.col("url").alias("u"), F.col("fetched").alias("f"), "n_active", "best")
    out = captures.join(best, captures["capture_id"].eqNullSafe(F.col("c")) & captures["url"].eqNullSafe(F.col("u"))
                        & captures["fetched"].eqNullSafe(F.col("f")), "left")
    return out.select(captures["capture_id"], captures["url"], captures["fetched"], host_of(captures["url"]).alias("host"),
                      F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "best.key", "best.list", "best.action",
                      "best.active_from", F.coalesce(F.col("best.action") == "allow", F.col("best.action").isNull()).alias("keep"))


def _number(text: Column, salt: str) -> Column:
    """A number below 2**24 that depends on a text alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 6), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures, with fetch days spread over two years by the page's id."""
    day = F.date_add(F.lit(START).cast("date"), _number(F.col("page_id").cast("string"), "fetch") % DAYS)
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated entries that follow the pages' own hosts, their domains and first path steps.

    Every host has a history of its own on the list "hosts" of up to three entries; domains are on
    "domains"; a third of the (host, first step) pairs are on "paths".
    """
    hosts = pages.select(
        host_of(F.col("url")).alias("host"),
        F.get(F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != ""), F.lit(0)).alias("step"))
    hosts = hosts.where("host IS NOT NULL").distinct()
    labels = F.split(F.col("host"), "\\.")
    domain = F.array_join(F.slice(labels, -2, 2), ".")
    kinds = hosts.select(F.lit("hosts").alias("list"), F.col("host").alias("key")).unionByName(
        hosts.where(F.size(labels) > 2).select(F.lit("domains").alias("list"), domain.alias("key"))).unionByName(
        hosts.where(F.col("step").isNotNull() & (_number(F.concat_ws("/", "host", "step"), "path") % 3 == 0)).select(
            F.lit("paths").alias("list"), F.concat_ws("/", "host", "step").alias("key"))).distinct()
    turns = kinds.withColumn("turn", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))))
    tag = F.concat_ws("|", "list", "key", "turn")
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("off"), F.lit("block")), _number(tag, "action") % 4 + 1)
    return turns.select("list", "key", action.alias("action"),
                        F.date_add(F.lit(START).cast("date"), _number(tag, "day") % (2 * DAYS)).alias("day")).where(
        F.col("day") < F.date_add(F.lit(START).cast("date"), DAYS))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(page_captures(pages), page_lists(pages))
    return out.select(F.col("capture_id").alias("page_id"), F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "host",
                      "n_active", "key", "list", "action", F.date_format("active_from", "yyyy-MM-dd").alias("active_from"), "keep")


ORACLE_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
    nullif(regexp_replace(regexp_replace(lower(regexp_extract(url,
      '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '^www\.', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps,
    DATE '2023-01-01' + (('0x' || md5('fetch' || page_id::VARCHAR)[1:6])::INTEGER % 730)::INTEGER AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host, steps[1] AS step, string_split(host, '.') AS labels FROM parsed WHERE host IS NOT NULL),
kinds AS (
  SELECT DISTINCT 'hosts' AS list, host AS key FROM hosts
  UNION SELECT 'domains', array_to_string(labels[-2:], '.') FROM hosts WHERE len(labels) > 2
  UNION SELECT 'paths', host || '/' || step FROM hosts
        WHERE step IS NOT NULL AND ('0x' || md5('path' || host || '/' || step)[1:6])::INTEGER % 3 = 0),
turns AS (SELECT list, key, list || '|' || key || '|' || turn AS tag FROM kinds, (VALUES ('1'), ('2'), ('3')) t(turn)),
entries AS (
  SELECT list, key, ['block', 'allow', 'off', 'block'][('0x' || md5('action' || tag)[1:6])::INTEGER % 4 + 1] AS action,
         DATE '2023-01-01' + (('0x' || md5('day' || tag)[1:6])::INTEGER % 1460)::INTEGER AS day FROM turns),
daily AS (SELECT list, key, day, max(action) AS action FROM entries WHERE day < DATE '2023-01-01' + 730 GROUP BY ALL),
spans AS (SELECT *, coalesce(lead(day) OVER (PARTITION BY list, key ORDER BY day), DATE '9999-12-31') AS until FROM daily),
asked AS (
  SELECT page_id, fetched, host || '/' || array_to_string(steps[1:n], '/') AS key, 100 + n AS weight
  FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS n FROM parsed) WHERE host IS NOT NULL
  UNION ALL SELECT page_id, fetched, host, 50 FROM parsed WHERE host IS NOT NULL
  UNION ALL SELECT page_id, fetched, array_to_string(string_split(host, '.')[n + 1:], '.'), 50 - n
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) - 1)) AS n FROM parsed)),
met AS (
  SELECT a.page_id, a.key, s.list, s.action, s.day,
         row_number() OVER (PARTITION BY a.page_id ORDER BY a.weight DESC, s.action = 'allow' DESC, s.list DESC) AS r,
         count(*) OVER (PARTITION BY a.page_id) AS n
  FROM asked a JOIN spans s ON a.key = s.key AND a.fetched >= s.day AND a.fetched < s.until
  WHERE s.action IN ('block', 'allow'))
SELECT p.page_id, strftime(p.fetched, '%Y-%m-%d') AS fetched, p.host, coalesce(m.n, 0)::BIGINT AS n_active, m.key, m.list,
       m.action, strftime(m.day, '%Y-%m-%d') AS active_from, coalesce(m.action, 'allow') = 'allow' AS keep
FROM parsed p LEFT JOIN met m ON m.page_id = p.page_id AND m.r = 1
"""
