"""Operator 4, exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of candidates, which grow in size with the table up to ``CANDIDATE_BLOCK``. A task
reads a block, sorts it along every dimension once, and then lets all queries stream past. For a query, the lists
are read side by side from the end that its sign in that dimension prefers, ``STEP`` entries at a time; each vector
met for the first time gets its whole score by random access. What no list has shown yet cannot score more than the
sum of the lists' current entries times the query: when that bound is below the k-th best score, the search stops.
It goes on while the bound equals the k-th score, as an unseen vector with a smaller id could still win the tie. A
block's best k of each query meet those of the other blocks in one aggregation. A task holds one block and one
batch of queries, whatever their numbers.

Components are integers, ``floor(scale * x)``. Scores are exact: in 64 bits while no sum can pass them, in Python's
integers otherwise. A component or a score among the best k that does not fit 64 bits is an error.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, neither
as queries nor as candidates; vectors of another length than the query's are not compared with it; rows
that repeat an id are candidates each, and as queries each scores on its own: the k best of all of them are the
id's answer; a query meets no row of its own id; a null id takes no part. No queries or no candidates: no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import read_table

K = 10
SCALE = 1024
EVERY = 100
CANDIDATE_BLOCK = 1 << 16
TASKS = 24      # blocks at least, so that a small table is spread too
LEAST_BLOCK = 256
STEP = 64
FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dims, v): usable vectors as arrays of long."""
    x = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(fine)
    fits = F.forall("x", lambda c: F.abs(F.lit(float(scale)) * c) < float(1 << 62))
    v = F.when(fits, F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))).otherwise(
        F.raise_error(F.lit("a component does not fit 64 bits")).cast("array<long>"))
    return rows.select("vec_id", F.size("x").alias("dims"), v.alias("v"))


class SortedLists:
    """A block of candidates, and their order along every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)

    def best(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best, highest score first, smaller id first among equals."""
        n, dims = self.vectors.shape
        if self.largest * int(np.abs(query).max(initial=0)) * dims >= 1 << 62:
            return self._best_of_large(own, query, k)
        used = np.flatnonzero(query)
        down = query[used] > 0
        seen = np.zeros(n, bool)
        seen[self.ids == own] = True
        scores, rows = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            depth = np.arange(a, b)
            at = np.where(down[:, None], n - 1 - depth, depth)
            met = self.lists[at, used[:, None]].ravel() if len(used) else depth
            fresh = np.unique(met)
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            scores = np.concatenate([scores, self.vectors[fresh] @ query])
            rows = np.concatenate([rows, fresh])
            keep = np.lexsort((self.ids[rows], -scores))[:k]
            scores, rows = scores[keep], rows[keep]
            bound = int((self.values[at[:, -1], used] * query[used]).sum()) if len(used) else 0
            if len(scores) == k and bound < scores[-1]:
                break
        return list(zip(scores.tolist(), self.ids[rows].tolist()))

    def _best_of_large(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The same with Python's integers, by all scores: sums may pass 64 bits on the way."""
        scores = [(-sum(int(x) * int(y) for x, y in zip(v, query)), int(i)) for i, v in zip(self.ids, self.vectors) if i != own]
        best = [(-s, i) for s, i in sorted(scores)[:k]]
        if any(not -(1 << 63) <= s < 1 << 63 for s, _ in best):
            raise OverflowError("a score does not fit 64 bits")
        return best


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = batch.column(batch.schema.names.index("v")).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, dims)


def _answers(k: int):
    """Rows (block, dims, of, vec_id, v), a block's candidates (of 0) before the queries (of 1) -> each query's best k."""

    def run(batches):
        key, waiting, lists = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            column = lambda c: batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            keys = np.stack([column("block"), column("dims"), column("of")], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(batch)]
            ids = column("vec_id")
            for a, b in zip(edges, edges[1:]):
                block, dims, of = keys[a].tolist()
                if key != (block, dims):
                    key, waiting, lists = (block, dims), [], None
                vectors = _vectors(batch.slice(a, b - a), dims)
                if not of:
                    waiting.append((ids[a:b], vectors))
                    continue
                if waiting:
                    lists = SortedLists(np.concatenate([i for i, _ in waiting]), np.concatenate([v for _, v in waiting]))
                    waiting = []
                if lists is None:
                    continue
                found = [(int(own), i, s) for own, query in zip(ids[a:b], vectors) for s, i in lists.best(int(own), query, k)]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from two results of :func:`integers`."""
    ship_package(queries.sparkSession)
    # of rows equal in id and vector no more than k can be among a query's best
    same = candidates.groupBy("vec_id", "dims", "v").agg(F.count(F.lit(1)).alias("n"))
    candidates = same.select("vec_id", "dims", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(k)))).alias("copy"))
    n = candidates.count()
    blocks = max(1, -(-n // block), min(TASKS, n // LEAST_BLOCK))
    rows = candidates.select(F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(blocks)).cast("int").alias("block"), "dims", F.lit(0).alias("of"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dims", F.lit(1).alias("of"), "vec_id", "v")
    met = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "dims", "of")
    found = met.mapInArrow(_answers(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(read_table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % EVERY == 0), rows)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
