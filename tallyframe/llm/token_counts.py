"""Operator 8, token counts: an exact length histogram with suffix sums.

Documents are encoded and counted by encoded length; everything about lengths then follows from the
histogram, which has one row for each length that occurs. With sums over all longer lengths, any
context limit is answered without another pass over the corpus: how many documents exceed it, how many
tokens are there in all and after cutting at the limit, and which length a quantile falls on.

Sums over the histogram run within ranges of ``RANGE`` lengths and over the totals of the ranges, so no
task takes the whole of it.

Defined cases: null, empty and blank texts have length 0 and are counted; repeated rows count each; an
empty table gives an empty histogram.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blobs_of, documents, give_back, id_text, saved
from .hashing import chunks
from .tokens import CHUNK, vocabulary_path, word_ids

RANGE = 256


def lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in batches:
            blobs = blobs_of(pa.Table.from_batches([batch]))
            n = [len(x) // 4 for a, b in chunks([len(x) for x in blobs], CHUNK) for x in encoder.of(blobs[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64))], ["doc_id", "n_tokens"])
        give_back()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs, with exact sums below and above it.

    length, n_docs, n_tokens (n_docs * length), docs_over (documents longer than it), tokens_over (their
    tokens), docs_to and tokens_to (documents of that length or shorter), truncated_tokens (all documents'
    tokens with the length as context limit), dropped_tokens, share_docs and share_tokens (of documents and
    tokens in documents of that length or shorter: a quantile q is the first length whose share is >= q).
    """
    bins = counted.groupBy(F.col(length_col).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    bins = bins.withColumns({"n_tokens": F.col("n_docs") * F.col("length"),
                             "rng": F.floor(F.col("length") / RANGE).cast("long")})
    bins = saved(bins)  # read twice below; the corpus is encoded once
    totals = bins.groupBy("rng").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = Window.orderBy(F.desc("rng")).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(F.lit(0))
    totals = totals.select(F.col("rng").alias("of"), F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
                           F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
                           F.sum("d").over(all_of).alias("d_all"), F.sum("t").over(all_of).alias("t_all"))
    longer = Window.partitionBy("rng").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = bins.join(totals, F.col("rng") == F.col("of"))
    out = out.withColumns({
        "docs_over": F.col("d_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)),
        "tokens_over": F.col("t_above") + F.coalesce(F.sum("n_tokens").over(longer), F.lit(0))})
    out = out.withColumns({
        "docs_to": F.col("d_all") - F.col("docs_over"), "tokens_to": F.col("t_all") - F.col("tokens_over"),
        "truncated_tokens": F.col("t_all") - F.col("tokens_over") + F.col("length") * F.col("docs_over"),
        "dropped_tokens": F.col("tokens_over") - F.col("length") * F.col("docs_over")})
    return out.select("length", "n_docs", "n_tokens", "docs_over", "tokens_over", "docs_to", "tokens_to",
                      "truncated_tokens", "dropped_tokens", (F.col("docs_to") / F.col("d_all")).alias("share_docs"),
                      (F.coalesce(F.col("tokens_to") / F.nullif("t_all", F.lit(0)), F.lit(1.0))).alias("share_tokens"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits, from the histogram alone: (context, docs_over, total_tokens, truncated_tokens)."""
    from functools import reduce
    one = [hist.agg(F.lit(c).cast("long").alias("context"),
                    F.coalesce(F.sum(F.when(F.col("length") > c, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
                    F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"),
                    F.coalesce(F.sum(F.least("length", F.lit(c)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"))
           for c in limits]
    return reduce(DataFrame.unionByName, one)


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the shortest length that this share of documents does not exceed."""
    picks = F.explode(F.array(*[F.lit(float(q)) for q in shares]))
    return (hist.select(picks.alias("share"), "length", "share_docs").where("share_docs >= share")
            .groupBy("share").agg(F.min("length").alias("length")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(documents(spark, sf_dir)))
