"""Operator 11, filter interaction audit: what every filter removes in every order, by Hart and Mas-Colell's potential.

A removal game is played by n filters: the worth v(S) of a coalition S is the number of documents that at least
one filter of S fails. Documents are reduced to (part, set of failed filters, labels, count), a table bounded by
the parts; from it come the worths of all 2^n coalitions. The potential follows recursively from the empty
coalition upwards, P(S) = (v(S) + sum of P(S without i)) / |S|. A filter's Shapley value is P(all) - P(all without
it); with n! P in place of P every division is exact, and the value is the filter's removals summed over all n!
orders. What a filter removes at a step is v(S with it) - v(S), S being the filters before it; likewise with
worths that count only labelled documents.

"Identical to a smaller doc_id's text" is judged on 256-bit hashes of the texts. Equal rows are counted before
any shuffle; a text's copies meet as counts by part and label, so a text in a third of all rows is a few rows.

Defined cases: a null text is empty; an empty text has no words, so it fails the word count, not the shares. A
null ``lang`` is the part ''. A null id comes after all ids and has no labels: such a row is a copy if any row
with an id has its text. Rows that repeat an id count one by one, with the same labels, and none of them is a
smaller id than the other. Labels that repeat an id: 1 if any of them is 1. An empty table gives no rows. Columns
other than those named are not looked at.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fence import fence
from ..sources.tables import read_table
from .common import documents

SPACE = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS = 200
LEAST_DISTINCT = 50   # per cent of the words
MOST_CAPITALS = 3     # per cent of the code points
MARKS = "[#$%&*|]"
TEXT_FILTERS = "ABCD"
FILTERS = "ABCDE"     # E is the filter of copies


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, sha, failed): each document with the bits of the text filters it fails (A 1, B 2, C 4, D 8)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                       text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    rows = fence(rows)  # the words are made once
    n_words, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [n_words < LEAST_WORDS,
             100 * distinct < LEAST_DISTINCT * n_words,
             100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length("text"),
             F.col("text").rlike(MARKS)]
    bits = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), bits.alias("failed"))


def with_copies(failed: DataFrame, labels: DataFrame, copy_bit: int = 1 << len(TEXT_FILTERS)) -> DataFrame:
    """(part, failed, good, toxic, n): numbers of documents by failed filters, the filter of copies among them.

    ``labels``: (doc_id, quality, toxic).
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = failed.groupBy("doc_id", "sha", "part", "failed").agg(F.count(F.lit(1)).alias("n"))
    known = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").withColumns(
        {"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    unknown = rows.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    by_text = known.unionByName(unknown).groupBy("sha", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("sha"))  # over counts by part and label, not over documents
    by_text = by_text.withColumn("first", first)
    originals = F.when(F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("failed"), originals.cast("long").alias("n")),
                   F.struct(F.col("failed").bitwiseOR(F.lit(copy_bit)).alias("failed"), (F.col("n") - originals).cast("long").alias("n")))
    split = by_text.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def worths(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, docs, worth, good, toxic): arrays over all 2^n coalitions, of documents that some member fails."""
    coalitions = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))))
    hit = F.when(F.col("failed").bitwiseAND(F.col("coalition")) != 0, F.col("n")).otherwise(F.lit(0))
    none = F.lit(0)
    sums = coalitions.groupBy("part", "coalition").agg(
        F.sum("n").alias("docs"), F.sum(hit).alias("worth"), F.sum(F.when(F.col("good"), hit).otherwise(none)).alias("good"),
        F.sum(F.when(F.col("toxic"), hit).otherwise(none)).alias("toxic"))
    rows = sums.groupBy("part").agg(F.max("docs").alias("docs"),
                                    F.array_sort(F.collect_list(F.struct("coalition", "worth", "good", "toxic"))).alias("all"))
    return rows.select("part", "docs", *[F.col("all")[c].alias(c) for c in ("worth", "good", "toxic")])


def potential(worth: Column, n_filters: int) -> Column:
    """n! times the potential of every coalition, in the order of their bits; 0 for the empty one.

    A coalition without one member has a smaller number, so it stands already in what has been worked out.
    """
    whole = F.lit(math.factorial(n_filters)).cast("long")

    def add(done: Column, coalition: Column) -> Column:
        fewer = [F.when(coalition.bitwiseAND(F.lit(1 << i)) != 0,
                        F.get(done, coalition.bitwiseXOR(F.lit(1 << i)))).otherwise(F.lit(0).cast("long")) for i in range(n_filters)]
        value = whole * F.get(worth, coalition) + sum(fewer[1:], fewer[0])
        return F.array_append(done, F.call_function("div", value, F.bit_count(coalition)))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), add)


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, failed, good, toxic, n).

    ``filters``: one letter each, the first for bit 1 of ``failed``, the second for bit 2, and so on.
    """
    n = len(filters)
    everyone = (1 << n) - 1
    parts = worths(counts, n)
    parts = fence(parts.withColumn("potential", potential(F.col("worth"), n)))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = parts.withColumn("filter_order", F.explode(orders))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    bit_of = F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)])
    earlier = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("at")), ""), F.lit(0),
                          lambda bits, f: bits.bitwiseOR(F.coalesce(F.element_at(bit_of, f), F.lit(0))))
    rows = fence(rows.withColumns({"bit": F.element_at(bit_of, F.col("filter")), "before": earlier}))
    after = F.col("before").bitwiseOR(F.col("bit"))
    others = F.lit(everyone).bitwiseXOR(F.col("bit"))

    def gain(of: str, big: Column = after, small: Column = F.col("before")) -> Column:
        return F.get(of, big) - F.get(of, small)

    return rows.select(
        "part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), (F.col("docs") - F.get("worth", after)).alias("kept"),
        gain("worth").alias("removed"), (F.get("worth", F.col("bit")) - gain("worth")).alias("redundant"),
        gain("worth", F.lit(everyone), others).alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        gain("potential", F.lit(everyone), others).alias("shapley"), "filter")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = with_copies(failures(documents(spark, sf_dir)), read_table(spark, sf_dir, "labels"))
    return audit(counts)


_ORDERS = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
         (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         (first_id IS NOT NULL AND (d.doc_id IS NULL OR d.doc_id > first_id))::INT AS e
  FROM d JOIN firsts USING (t) LEFT JOIN marks m ON m.doc_id = d.doc_id),
g AS (SELECT part, {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS fails, a + b + c + d + e AS n_fails, good, toxic, count(*) AS n
      FROM f GROUP BY ALL),
orders AS (SELECT unnest([{_ORDERS}]) AS filter_order),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
s AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM steps),
seen AS (
  SELECT part, filter_order, step, filter, n, good, toxic, n_fails,
         CASE filter WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END AS here,
         (contains(earlier, 'A') AND fails.A = 1) OR (contains(earlier, 'B') AND fails.B = 1)
         OR (contains(earlier, 'C') AND fails.C = 1) OR (contains(earlier, 'D') AND fails.D = 1)
         OR (contains(earlier, 'E') AND fails.E = 1) AS gone
  FROM g CROSS JOIN s),
r AS (
  SELECT part, filter_order, step::INT AS step, filter,
         sum(CASE WHEN NOT gone AND here = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND here = 1 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND here = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN here = 1 AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND here = 1 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND here = 1 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
