"""Operator 9, toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. The character model counts trigrams over the whole of every document (:mod:`noisy_channel`). The
   table has a fixed size, whatever the corpus: 64 ** 3 counts.
2. Disguised words (look-alike digits and signs, drawn-out letters, letters set apart) are decoded by
   Viterbi in their lattices under that model.
3. A logistic model over restored words and their beginnings is fitted on labelled rows: ``SAMPLE`` of
   them at most, chosen by a hash of the id. Of all hashed features the ``FEATURES`` that lean most to
   toxic texts are kept. Rows held out (crc32 of the id as text, modulo 4, is 2) are never learnt from.
4. Every document is scored by that model. Only its text is an input.

Defined cases: null and empty texts get the model's score of no evidence; if labels are missing or of
one kind, every score is the (smoothed) share of toxic rows; an id labelled more than once is toxic if any
row says so; a null id is not held out; repeated rows are scored each.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..sources.tables import read_table
from . import hashing
from .common import documents, give_back, id_text, saved
from .noisy_channel import KEPT, Channel, class_table, count_trigrams

SAMPLE = 20_000
FEATURES = 2048
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.3
ROWS_AT_ONCE = 256


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trigram_counts(rows: DataFrame) -> np.ndarray:
    """Class trigrams of all texts. Each task sends its non-zero counts; their sum has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing.forget_powers()  # a worker may have served other operators before
        table, total = class_table(), None
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = count_trigrams([t for t in batch.column("text").slice(i, 64).to_pylist() if t], table)
                total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])
        give_back()

    sums = rows.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    counts = np.zeros(64 ** 3, np.int64)
    counts[got["gram"].to_numpy()] = got["n"].to_numpy()
    return counts


class Features:
    """Hashed features of a text: its restored words and their beginnings. With ``only``, no others."""

    def __init__(self, counts: np.ndarray, only: Container[int] | None = None):
        self.channel, self.only = Channel(counts), only
        self.of_word: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        got = self.of_word.get(w)
        if got is None:
            names = ["=" + w] + [w[:n] for n in PREFIXES if len(w) > n]
            got = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names)
            if self.only is not None:
                got = tuple(f for f in got if f in self.only)
            if len(self.of_word) < KEPT and len(w) <= 40:
                self.of_word[w] = got
        return got

    def text(self, text: str | None) -> Counter:
        """For each feature the number of distinct words that have it."""
        return Counter(f for w in self.channel.words(text or "") for f in self.word(w))


def _value(words: np.ndarray | int):
    """A feature's value, from the number of distinct words that have it."""
    return np.log2(1.0 + words)


def _logistic(rows: list[list[int]], values: list[list[int]], y: np.ndarray, n: int, steps: int = 600,
              ridge: float = 0.05) -> tuple[float, np.ndarray]:
    """Weights of a logistic model with a ridge, by gradient steps scaled for each feature (Adagrad)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([c for r in rows for c in r], np.int64)
    x = _value(np.array([v for r in values for v in r], float))
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    past, past_b = np.full(n, 1e-6), 1e-6
    for _ in range(steps):
        z = b + np.bincount(at, weights=w[cols] * x, minlength=len(y))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad, grad_b = np.bincount(cols, weights=g[at] * x, minlength=n) + ridge * w, g.sum()
        past, past_b = past + grad ** 2, past_b + grad_b ** 2
        w, b = w - 0.2 * grad / np.sqrt(past), b - 0.2 * grad_b / np.sqrt(past_b)
    return float(b), w


def fit(rows: DataFrame, labels: DataFrame, counts: np.ndarray, sample: int = SAMPLE, features: int = FEATURES,
        label_col: str = "toxic") -> tuple[float, dict[int, float]]:
    """Intercept and weight of each chosen feature, from a bounded sample of labelled rows."""
    known = labels.where(~held_out(labels["doc_id"]) & labels[label_col].isNotNull() & labels["doc_id"].isNotNull())
    known = known.groupBy(known["doc_id"].cast("long").alias("id")).agg(F.max(labels[label_col]).cast("int").alias("y"))
    n = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))).limit(2 * sample)
    train = saved(rows.join(F.broadcast(chosen), rows["doc_id"] == F.col("id")).select("text", "y"))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found, of = Features(counts), {0: Counter(), 1: Counter()}, Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found[y].update(model.text(text).keys())
                of[y] += 1
        found[0][-1], found[1][-1] = of[0], of[1]
        names = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([found[0][k] for k in names], pa.int64()),
                                          pa.array([found[1][k] for k in names], pa.int64())], ["f", "clean", "toxic"])
        del model, found, names
        give_back()

    leaning = saved(train.mapInArrow(lean, "f int, clean long, toxic long").groupBy("f").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    total = leaning.where("f = -1").first()
    n0, n1 = (total["clean"], total["toxic"]) if total else (0, 0)
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return prior, {}
    p = (F.col("clean") + F.col("toxic") + 1) / (n0 + n1 + 2)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    top = leaning.where((F.col("f") >= 0) & (F.col("toxic") >= 2)).select("f", z.alias("z")).where("z > 2")
    names = [r["f"] for r in top.orderBy(F.desc("z"), "f").limit(features).collect()]
    place = {f: i for i, f in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Features(counts, place)
        for batch in batches:
            found = [sorted((place[f], k) for f, k in model.text(t).items())
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[f for f, _ in x] for x in found], pa.list_(pa.int32())),
                                              pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32())),
                                              batch.column("y")], ["x", "n", "y"])
        del model
        give_back()

    got = train.mapInArrow(vectors, "x array<int>, n array<int>, y int").collect()
    b, w = _logistic([r["x"] for r in got], [r["n"] for r in got], np.array([r["y"] for r in got], float), max(1, len(names)))
    return b, dict(zip(names, w.tolist()))


def score(rows: DataFrame, counts: np.ndarray, b: float, weights: dict[int, float], carry: list[str],
          text_col: str = "text") -> DataFrame:
    """The carried columns and, last, the score of every row's text. Rows are scored a few at a time."""
    schema = T.StructType([*(rows.schema[c] for c in carry), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing.forget_powers()
        model = Features(counts, weights)
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch, z = whole.slice(at, ROWS_AT_ONCE), []
                for text in batch.column(text_col):
                    found = model.text(text.as_py())
                    z.append(b + sum(weights[f] * _value(n) for f, n in sorted(found.items())))
                s = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(s, pa.float64())], [*carry, "score"])
        del model
        give_back()

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of ``docs``. ``labelled`` holds the texts that ``labels`` refers to."""
    rows = id_text(docs, id_col, text_col)
    known = id_text(labelled, id_col, text_col)
    counts = trigram_counts(rows)
    b, weights = fit(known, labels, counts)
    return score(rows, counts, b, weights, ["doc_id"])


def keep_clean(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``), all columns, whose score stays below the threshold."""
    ship_package(docs.sparkSession)
    counts = trigram_counts(docs)
    b, weights = fit(id_text(labelled), labels, counts)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    out = score(rows, counts, b, weights, names, names[docs.columns.index("text")]).where(F.col("score") < threshold)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = toxicity(docs, docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
