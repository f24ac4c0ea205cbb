"""Operator 7, mixing sources to target weights [native]: a time-varying curriculum.

Every source has a target number of words and a weight schedule over training time 0..1, piecewise linear
through given knots. The integral of its schedule, scaled so that it ends at the target, is the source's
cumulative demand. The source's documents stand in a fixed pseudo-random order, once for each epoch;
whole documents are taken while the middle of one lies below the target, so a source misses its target by
half a document at most. The position of a taken copy is the time at which the demand reaches its middle:
the demand inverted, a square root in closed form on each piece of the schedule. Sorting by range of
position gives the training order (:func:`in_training_order`).

Targets share ``ratio`` of all words by weight; a target stops at ``epochs`` times its source's size and
the excess is shared by the others by weight, until none is above. In closed form: order the sources by
size over weight; with the first k of them full, the others share what is left; the water level is right
for the k at which it first stays below the next source's limit.

Sums along a source run within buckets of its order and over bucket totals, so a source with a third of
all documents is spread like the others. Sources are ordered by code point, null last, as a source of
its own. Reruns agree: the order comes from the id alone (repeated ids: then from the text's hash).

Defined cases: null and blank texts have size 0 and are never taken; a source without words has target 0
and takes nothing; an empty table gives an empty result; documents with a null id order by their text.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LAST_ID, documents, n_words, saved

RATIO = 1.5
EPOCHS = 2
WEIGHTS = (3.0, 1.0, 2.0)
#: Schedules by turns, as (time, rate) knots: early, level and late sources.
SCHEDULES = (((0.0, 2.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)))
BUCKETS = 256
BUCKET_ROWS = 100_000


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, s_key, place, tie): s_key is the source without nulls, place is a pseudo-random order that depends on the row alone."""
    text = docs[text_col].cast("string")
    doc_id = docs[id_col].cast("long")
    source = docs[source_col].cast("string")
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), n_words(text).alias("size"),
                       F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("s_key"),
                       F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))).alias("place"),
                       F.xxhash64(text, source).alias("tie"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS) -> DataFrame:
    """One row for each source: source, number (from 0), weight, source_size, target."""
    by_source = sizes.groupBy("s_key", "source").agg(F.sum("size").alias("source_size"))
    numbered = by_source.withColumn(
        "number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    w = numbered.withColumn("weight", weight).withColumn("cap", (epochs * F.col("source_size")).cast("double"))
    live = F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0)
    w = w.withColumn("live", live).withColumn("limit", F.when(F.col("live") > 0, F.col("cap") / F.col("live")).otherwise(0.0))
    full = Window.orderBy("limit", "number").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("limit", "number").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("level", (F.lit(float(ratio)) * F.sum("source_size").over(every)
                               - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.nullif(F.sum("live").over(rest), F.lit(0.0)))
    w = w.withColumn("water", F.max(F.when((F.col("live") > 0) & (F.col("level") <= F.col("limit")), F.col("level"))).over(every))
    target = F.least("cap", F.coalesce(F.col("live") * F.col("water"), F.col("cap")))
    return w.select("s_key", "source", "number", "weight", "source_size", target.alias("target"))


def along_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``before``: the words of the source's documents that stand before this one."""
    buckets = max(BUCKETS, sizes.count() // BUCKET_ROWS)
    rows = sizes.withColumn("bucket", F.pmod(F.conv(F.substring("place", 1, 6), 16, 10).cast("long"), F.lit(1 << 24))
                            * F.lit(buckets) / F.lit(1 << 24))
    rows = rows.withColumn("bucket", F.floor("bucket").cast("int"))
    totals = rows.groupBy("s_key", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("s_key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("s_key", "bucket").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, ["s_key", "bucket"])
    return rows.withColumn("before", F.col("earlier") + F.col("inside"))


def position(share: Column, schedule: Column) -> Column:
    """The time at which a piecewise linear schedule has used up a share (0..1) of its integral.

    ``schedule`` is an array of pieces (t0, t1, r0, r1, done, total) in order of time.
    """
    want = lambda p: share * p["total"] - p["done"]
    piece = F.element_at(F.filter(schedule, lambda p: want(p) >= 0), -1)
    left = F.greatest(want(piece), F.lit(0.0))
    slope = (piece["r1"] - piece["r0"]) / (piece["t1"] - piece["t0"])
    root = F.sqrt(F.greatest(piece["r0"] * piece["r0"] + 2 * slope * left, F.lit(0.0)))
    step = 2 * left / F.nullif(piece["r0"] + root, F.lit(0.0))
    return F.least(piece["t0"] + F.coalesce(step, F.lit(0.0)), piece["t1"])


def _pieces(schedule) -> Column:
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(schedule, schedule[1:])]
    out = []
    for i, ((t0, r0), (t1, r1)) in enumerate(zip(schedule, schedule[1:])):
        values = (("t0", t0), ("t1", t1), ("r0", r0), ("r1", r1), ("done", sum(areas[:i])), ("total", sum(areas)))
        out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in values]))
    return F.array(*out)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS,
        schedules=SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, place, source_size, target, taken and positions (one for each copy taken)."""
    sizes = saved(sized(docs, id_col, text_col, source_col))  # words are counted once
    goal = targets(sizes, weights, ratio, epochs).select("s_key", "number", "source_size", "target")
    rows = along_sources(sizes).join(goal, "s_key")
    schedule = F.element_at(F.array(*[_pieces(s) for s in schedules]), (F.col("number") % len(schedules) + 1).cast("int"))
    middles = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)),
                          lambda e: F.col("before") + e * F.col("source_size") + F.col("size") / 2)
    middles = F.filter(middles, lambda m: (m < F.col("target")) & (F.col("size") > 0))
    rows = rows.withColumn("schedule", schedule).withColumn("middles", middles)
    rows = rows.withColumn("positions", F.transform("middles", lambda m: position(m / F.col("target"), F.col("schedule"))))
    return rows.select("doc_id", "source", "size", "place", "tie", "source_size", "target",
                       (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy, sorted by its place in training: a range partition, then a sort within."""
    copies = mixed.select(*[c for c in mixed.columns if c != "positions"], F.posexplode("positions").alias("epoch", "position"))
    return copies.orderBy("position", "place", "epoch")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in training order, all columns, each as often as the mix takes it.

    Rows that are equal in id, text and source are one another's copies here.
    """
    no_id = F.lit(int(LAST_ID))
    copies = mix(docs).select(F.coalesce("doc_id", no_id).alias("of_id"), F.col("tie").alias("of_tie"),
                              F.posexplode("positions").alias("epoch", "position"))
    tie = F.xxhash64(docs["text"].cast("string"), docs["source"].cast("string"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    texts = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], 
                        F.coalesce(docs["doc_id"].cast("long"), no_id).alias("of_id"), tie.alias("of_tie"))
    # the first of equal rows; on the exchange that the join needs anyway, without a sort of texts before it
    same = Window.partitionBy("of_id", "of_tie").orderBy("of_tie")
    texts = texts.withColumn("again", F.lag(F.lit(True)).over(same)).where("again IS NULL").drop("again")
    out = texts.join(copies, ["of_id", "of_tie"])
    return out.orderBy("position", "of_tie", "epoch").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first place in training, those that are not taken last."""
    mixed = mix(documents(spark, sf_dir))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", "place", F.size("positions").alias("copies"),
                        F.get("positions", F.lit(0)).alias("first_position"), F.get("positions", F.lit(1)).alias("second_position"))
    return rows.orderBy(F.asc_nulls_last("first_position"), "place").drop("place")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS place FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE [3.0, 1.0, 2.0][number % 3 + 1] END::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap FROM sources),
limits AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 0 END AS lim FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM limits)
             - (SELECT coalesce(sum(b.cap), 0) FROM limits b WHERE (b.lim, b.number) < (a.lim, a.number)))
         / nullif((SELECT sum(b.w) FROM limits b WHERE (b.lim, b.number) >= (a.lim, a.number)), 0) AS level
  FROM limits a),
goals AS (
  SELECT source, source_size, number,
         least(cap, coalesce(w * (SELECT max(level) FROM levels WHERE w > 0 AND level <= lim), cap)) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, number,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
middles AS (
  SELECT *, CASE WHEN size > 0 AND before + size / 2.0::DOUBLE < target THEN before + size / 2.0::DOUBLE END AS m1,
         CASE WHEN size > 0 AND before + source_size + size / 2.0::DOUBLE < target
              THEN before + source_size + size / 2.0::DOUBLE END AS m2 FROM placed),
-- demand per unit of time: 2 falling to 0.5, level, or 0.5 up to half time and then rising to 2
timed AS (
  SELECT *, list_transform([m1, m2], lambda m: CASE
           WHEN number % 3 = 0 THEN (2 - sqrt(4 - 3 * (m / target * 1.25))) / 1.5
           WHEN number % 3 = 1 THEN m / target
           WHEN m / target * 0.875 < 0.25 THEN m / target * 0.875 / 0.5
           ELSE 0.5 + (sqrt(0.25 + 6 * (m / target * 0.875 - 0.25)) - 0.5) / 3 END) AS times FROM middles)
SELECT doc_id, size, source_size, target,
       (size * ((m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT))::BIGINT AS taken,
       (m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT AS copies, times[1] AS first_position, times[2] AS second_position
FROM timed
"""
