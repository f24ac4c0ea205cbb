"""Operator 1, substring dedup: a Count-min prefilter, then exact grouping of what may repeat.

A window is ``window`` consecutive words of one document. Documents are dealt into blocks by id.
Pass 1: every block counts all its windows in a Count-min sketch; shards merge the blocks' sketches
(:mod:`sketch`), whose estimates are never too low. Pass 2: only windows estimated to occur twice or
more are grouped exactly, by a 128-bit hash of the window; each block sends a window once, with the
smallest id that holds it there, so a passage in a third of all documents costs one entry a block.
Pass 3: every word covered by a window that also starts in a document with a smaller id goes.

Defined cases: a null text has no words; a text shorter than a window keeps all its words; rows with
one and the same id do not remove each other's words; a null id counts as the largest. An empty
table gives an empty result. A single document is held in memory by its task.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import blobs_of, documents, id_text, ids_of, n_blocks, total_bytes
from .hashing import BASES, U, mix, rolling, word_hashes

WINDOW = 50
BLOCK_BYTES = 8 << 20
EXACT_SHARD_BYTES = 8 << 20
PART_SCHEMA = "block long, shard long, h1 binary, h2 binary, least binary"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string"


class _Windows:
    """All windows of a block: two hashes each, place of the first word, and the document's order."""

    def __init__(self, table: pa.Table, window: int):
        self.blobs, self.ids = blobs_of(table), ids_of(table)
        words, self.counts = word_hashes(self.blobs)
        ends = np.cumsum(self.counts)
        n = max(0, len(words) - window + 1)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)[:n]
        inside = np.arange(n) + window <= ends[doc]
        self.start = np.flatnonzero(inside)
        self.doc = doc[inside]
        self.h1 = rolling(words, window, 0)[inside]
        self.h2 = rolling(mix(words ^ BASES[0]), window, 1)[inside]

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("start", "doc", "h1", "h2"):
            setattr(self, name, getattr(self, name)[chosen])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """h1, h2 and smallest id of each distinct window in hash order; the place of every window in them."""
        ids = self.ids[self.doc]
        order = np.lexsort((ids, self.h2, self.h1))
        a, b = self.h1[order], self.h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[new], b[new], ids[order][new], place


def _shard_bounds(h1: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    s = ((h1 >> U(32)) * U(shards)) >> U(32)
    first = np.flatnonzero(np.diff(s, prepend=U(2**63)))
    return s[first].astype(np.int64), np.append(first, len(h1))


def _group_exactly(table: pa.Table) -> pa.Table:
    """One shard of candidate windows: which of each block's windows has a smaller id elsewhere?"""
    h1, h2, least = ([sketch.expand(x, t) for x in table.column(c).to_pylist()]
                     for c, t in (("h1", np.uint64), ("h2", np.uint64), ("least", np.int64)))
    sizes = [len(x) for x in h1]
    a, b, ids = np.concatenate(h1), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((ids, b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    smallest = np.empty(len(x), np.int64)
    smallest[order] = ids[order][new][np.cumsum(new) - 1]
    body = [np.packbits(p).tobytes() for p in np.split(smallest < ids, np.cumsum(sizes)[:-1])]
    return pa.table({"block": table.column("block"), "kind": pa.array([1] * len(body), pa.int32()),
                     "shard": table.column("shard"), "body": pa.array(body, pa.binary())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every document."""
    rows = id_text(docs, id_col, text_col)
    nbytes = total_bytes(rows)
    blocks = n_blocks(nbytes, block_bytes)
    bits = sketch.bits_for(nbytes / 6)
    shards = n_blocks(nbytes, EXACT_SHARD_BYTES)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "text")

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return sketch.fill(key[0].as_py(), _Windows(table, window).h1, bits)

    def candidates(table: pa.Table, got: pa.Table) -> _Windows:
        w = _Windows(table, window)
        w.keep(sketch.ask(w.h1, sketch.answers(got, 0), bits)[0])
        return w

    def send(key, table: pa.Table, got: pa.Table) -> pa.Table:
        h1, h2, least, _ = candidates(table, got).distinct()
        s, at = _shard_bounds(h1, shards)
        cut = list(zip(at[:-1].tolist(), at[1:].tolist()))
        return pa.table({"block": pa.array([key[0].as_py()] * len(s), pa.int64()), "shard": pa.array(s, pa.int64()),
                         **{c: pa.array([sketch.squeeze(v[a:b]) for a, b in cut], pa.binary())
                            for c, v in (("h1", h1), ("h2", h2), ("least", least))}})

    def remove(key, table: pa.Table, got: pa.Table) -> pa.Table:
        w = candidates(table, got)
        h1, _, least, place = w.distinct()
        smaller = np.zeros(len(h1), bool)
        exact = sketch.answers(got, 1)
        s, at = _shard_bounds(h1, shards)
        for shard, a, b in zip(s.tolist(), at[:-1].tolist(), at[1:].tolist()):
            smaller[a:b] = np.unpackbits(np.frombuffer(exact[shard], np.uint8), count=b - a)
        repeated = w.start[smaller[place] | (w.ids[w.doc] > least[place])]
        edge = np.zeros(int(w.counts.sum()) + 1, np.int32)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept, gone = [], []
        for blob, part in zip(w.blobs, np.split(covered, np.cumsum(w.counts)[:-1])):
            words = blob.split()
            gone.append(int(part.sum()))
            if gone[-1]:
                words = [x for x, c in zip(words, part.tolist()) if not c]
            kept.append(b" ".join(words))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(w.counts, pa.int64()),
                         "n_removed": pa.array(gone, pa.int64()),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    by_block = dealt.groupBy("block")
    estimates = sketch.merged(by_block.applyInArrow(count, sketch.ROWS_SCHEMA))
    parts = by_block.cogroup(estimates.groupBy("block")).applyInArrow(send, PART_SCHEMA)
    exact = parts.groupBy("shard").applyInArrow(_group_exactly, sketch.ANSWER_SCHEMA)
    told = estimates.unionByName(exact)
    return by_block.cogroup(told.groupBy("block")).applyInArrow(remove, RESULT_SCHEMA)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
placed AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words WHERE len(ws) >= 50),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS w FROM placed),
first_at AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
repeated AS (SELECT doc_id, i FROM windows JOIN first_at USING (w) WHERE least < doc_id),
single AS (SELECT doc_id, ws[k] AS word, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM words)),
marked AS (
  SELECT s.doc_id, s.word, s.k, (
    max(CASE WHEN r.i IS NOT NULL THEN s.k END) OVER (PARTITION BY s.doc_id ORDER BY s.k) > s.k - 50) AS gone
  FROM single s LEFT JOIN repeated r ON r.doc_id = s.doc_id AND r.i = s.k),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone IS NOT TRUE) AS kept_text
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
