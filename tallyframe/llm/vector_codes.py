"""Operator 13, vector code compression: product codes from exact integer k-means over Hilbert-sorted blocks.

Components become integers, ``floor(scale * x)``. A vector is cut into equal consecutive parts, and every part
position has a codebook. Parts are sorted along a Hilbert curve and cut into flat blocks of ``BLOCK`` neighbours;
a block keeps its points with the box around them (least and largest value in each dimension) and their sum. The
blocks are written once. In every round a block compares its box with the codebook: an entry whose least distance
to the box is above another's largest distance cannot be nearest to any point inside, not even in a tie. Where one
entry is left the block's count and sum go to it unread; otherwise a small kernel of exact integers compares
the points with the entries left. Tasks add up by entry before anything is sent; a round returns one row for each
entry to the driver, at most ``entries`` times the dimensions in all, and the next round's codebooks go out with
its tasks. Points that are equal, however many, are dealt by row number after their place on the curve.

Kernels multiply in 64-bit floating point while all sums stay below 2**53, where that is exact, and in 64-bit
integers beyond. Components of 2**24 or more after scaling raise an error, so that no sum can overflow.

Defined cases: vectors that are null, empty, or hold null or non-finite components are dropped. Codebooks start
from the smallest distinct ids, a null id after all others, of rows that repeat an id the least vector; with fewer
ids there are fewer entries. Rows that repeat an id, or equal others, are coded each, one row out for one row in.
A length that is no multiple of the parts, or differs between rows, is an error. An empty table gives no rows and
empty codebooks. Other columns are not looked at.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import read_table
from .common import saved

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 128
TASK_BYTES = 8 << 20   # of points in one task
KEY_BITS = 62
LARGEST = 1 << 24
SALTS = 16
POINTS = "part int, key long, row long, point binary"
BLOCKS = "part int, n int, rows binary, points binary, low binary, high binary, total binary"
SUMS = "part int, entry int, n long, total binary"
CODES = "row long, part int, code int, error long"


# ---- points on the curve -----------------------------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (0 .. 2**bits - 1); dimensions * bits <= 63.

    Skilling's transform, for all rows at once.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            turned = (x[i] >> bit & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip = np.where(x[-1] >> bit & 1, flip ^ ((1 << bit) - 1), flip)
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for xi in x:
            key = key << 1 | ((xi ^ flip) >> bit & 1)
    return key


def _grid(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """Cell numbers of points in a grid over the box low..high, as fine as a key can hold; the box only shapes the order."""
    dims = min(points.shape[1], KEY_BITS)
    bits = min(20, KEY_BITS // dims)
    span = np.maximum(high - low + 1, 1)[:dims]
    cells = (points[:, :dims] - low[:dims]) * (1 << bits) // span
    return np.clip(cells, 0, (1 << bits) - 1), bits


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    values = column.combine_chunks().to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _place(low: np.ndarray, high: np.ndarray, parts: int):
    """Rows of vectors -> one row for each part, with its place on the curve."""
    dims = len(low)

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.names.index("v"))
            vectors = lists.flatten().to_numpy(zero_copy_only=False)
            if len(vectors) != len(batch) * dims or (np.diff(lists.offsets.to_numpy()) != dims).any():
                raise ValueError(f"vectors of another length than {dims}")
            vectors = vectors.reshape(-1, dims).astype(np.int64)
            row = batch.column(batch.schema.names.index("row"))
            width = dims // parts
            for p in range(parts):
                cut = slice(p * width, (p + 1) * width)
                cells, bits = _grid(vectors[:, cut], low[cut], high[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), p, np.int32)), pa.array(hilbert_keys(cells, bits)), row,
                     _binary(vectors[:, cut].astype(np.int32))], names=["part", "key", "row", "point"])

    return run


def _flat_blocks(block: int):
    """Sorted points -> blocks of neighbours with box and sum."""

    def made(part: int, rows: np.ndarray, points: np.ndarray) -> tuple:
        wide = points.astype(np.int64)
        return (part, len(rows), rows.tobytes(), points.tobytes(), wide.min(0).tobytes(), wide.max(0).tobytes(), wide.sum(0).tobytes())

    def table(out: list) -> pa.RecordBatch:
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                          names=["part", "n", "rows", "points", "low", "high", "total"])

    def run(batches):
        part, rows, points = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            parts, new_rows = t["part"].to_numpy(), t["row"].to_numpy()
            new_points = _matrix(t["point"], np.int32)
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            out = []
            for a, b in zip(edges, edges[1:]):
                if part is not None and part == parts[a]:
                    rows, points = np.concatenate([rows, new_rows[a:b]]), np.concatenate([points, new_points[a:b]])
                else:
                    if part is not None and len(rows):
                        out.append(made(part, rows, points))
                    part, rows, points = int(parts[a]), new_rows[a:b], new_points[a:b]
                whole = len(rows) // block * block
                out += [made(part, rows[i:i + block], points[i:i + block]) for i in range(0, whole, block)]
                rows, points = rows[whole:], points[whole:]
            if out:
                yield table(out)
        if part is not None and len(rows):
            yield table([made(part, rows, points)])

    return run


# ---- rounds ------------------------------------------------------------------------------


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries, ascending, that may be nearest to some point of the box."""
    outside = np.maximum(np.maximum(low - book, book - high), 0)
    across = np.maximum(np.abs(book - low), np.abs(book - high))
    return np.flatnonzero((outside * outside).sum(1) <= (across * across).sum(1).min())


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (the first of several) and its squared distance, exactly, as int64."""
    size = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = np.float64 if 4 * size * size * points.shape[1] < 1 << 53 else np.int64
    p, b = points.astype(exact), book.astype(exact)
    apart = (b * b).sum(1) - 2 * (p @ b.T)
    code = apart.argmin(1)
    return code, (apart[np.arange(len(p)), code] + (p * p).sum(1)).astype(np.int64)


def _block_rows(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield r["part"], r["n"], r


def _sums(books: list[np.ndarray]):
    """Blocks -> counts and sums by entry, added up over the task."""
    width = books[0].shape[1]

    def run(batches):
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for part, n, r in _block_rows(batches):
            book = books[part]
            near = shortlist(np.frombuffer(r["low"], np.int64), np.frombuffer(r["high"], np.int64), book)
            if len(near) == 1:
                counts[part][near[0]] += n
                totals[part][near[0]] += np.frombuffer(r["total"], np.int64)
                continue
            points = np.frombuffer(r["points"], np.int32).reshape(n, width).astype(np.int64)
            code = near[nearest(points, book[near])[0]]
            counts[part] += np.bincount(code, minlength=len(book))
            np.add.at(totals[part], code, points)
        for part, count in enumerate(counts):
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]),
                     _binary(totals[part][used])], names=["part", "entry", "n", "total"])

    return run


def _added(table: pa.Table) -> pa.Table:
    entry = table["entry"].to_numpy()
    kinds, at = np.unique(entry, return_inverse=True)
    rows = _matrix(table["total"], np.int64)
    totals, counts = np.zeros((len(kinds), rows.shape[1]), np.int64), np.zeros(len(kinds), np.int64)
    np.add.at(totals, at, rows)
    np.add.at(counts, at, table["n"].to_numpy())
    return pa.table([pa.array(np.full(len(kinds), table["part"][0].as_py(), np.int32)), pa.array(kinds.astype(np.int32)),
                     pa.array(counts), _binary(totals)], names=["part", "entry", "n", "total"])


def _codes(books: list[np.ndarray]):
    """Blocks -> code and squared distance of every point."""
    width = books[0].shape[1]

    def run(batches):
        for part, n, r in _block_rows(batches):
            near = shortlist(np.frombuffer(r["low"], np.int64), np.frombuffer(r["high"], np.int64), books[part])
            points = np.frombuffer(r["points"], np.int32).reshape(n, width).astype(np.int64)
            code, error = nearest(points, books[part][near])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(r["rows"], np.int64)), pa.array(np.full(n, part, np.int32)),
                 pa.array(near[code].astype(np.int32)), pa.array(error)], names=["row", "part", "code", "error"])

    return run


# ---- the operator ------------------------------------------------------------------------


def usable(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """(row, vec_id, label, v): vectors that take part, as integers; ``row`` numbers the rows of the saved table."""
    x = vectors[vector_col].cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), x.alias("x"))
    rows = rows.where(F.coalesce((F.size(x) > 0) & finite, F.lit(False)))
    small = F.forall("x", lambda e: F.abs(e * scale) < float(LARGEST))
    v = F.when(small, F.transform("x", lambda e: F.floor(e * scale).cast("int"))).otherwise(
        F.raise_error(F.lit(f"a component of {LARGEST} or more after scaling")).cast("array<int>"))
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", v.alias("v")))


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """One matrix of entries for each part, from the smallest ids; no matrices for an empty table."""
    ids = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    chosen = rows.join(F.broadcast(ids.withColumnRenamed("vec_id", "of")), F.col("vec_id").eqNullSafe(F.col("of")))
    least = chosen.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last())
    vectors = [r.v for r in least.collect()]
    if not vectors:
        return []
    if len({len(v) for v in vectors}) > 1 or len(vectors[0]) % parts:
        raise ValueError("vectors must have one length, a multiple of the number of parts")
    return np.split(np.array(vectors, np.int64), parts, axis=1)


def blocks_of(rows: DataFrame, books: list[np.ndarray], block: int = BLOCK) -> DataFrame:
    """The saved blocks. The start codebooks' box shapes the curve, whatever lies outside is at its edge."""
    start = np.concatenate(books, axis=1)
    per_task = max(1, TASK_BYTES // (4 * books[0].shape[1]))
    tasks = max(1, math.ceil(rows.count() * len(books) / per_task))
    points = rows.select("row", "v").mapInArrow(_place(start.min(0), start.max(0), len(books)), POINTS)
    points = points.repartitionByRange(tasks, "part", "key", "row").sortWithinPartitions("part", "key", "row")
    return saved(points.mapInArrow(_flat_blocks(block), BLOCKS))


def one_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of the points nearest to them; unused entries stay."""
    sums = blocks.mapInArrow(_sums(books), SUMS)
    sums = sums.groupBy("part", F.col("entry") % F.lit(32)).applyInArrow(_added, SUMS)
    books = [b.copy() for b in books]
    for part, entry, n, total in sums.collect():
        books[part][entry] = np.frombuffer(total, np.int64) // n
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             block: int = BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (row, vec_id, label, codes array<int>, error long), saved, and the final codebooks."""
    ship_package(vectors.sparkSession)
    rows = usable(vectors, scale, id_col, vector_col, label_col)
    books = first_books(rows, parts, entries)
    names = rows.select("row", "vec_id", "label")
    if not books:
        return names.withColumns({"codes": F.array().cast("array<int>"), "error": F.lit(0).cast("long")}), []
    blocks = blocks_of(rows, books, block)
    for _ in range(rounds):
        books = one_round(blocks, books)
    coded = blocks.mapInArrow(_codes(books), CODES).groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda c: c["code"]).alias("codes"),
        F.sum("error").alias("error"))
    return saved(names.join(coded, "row")), books


def books_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position within the part."""
    return ",".join(str(c) for b in books for c in b.ravel().tolist())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    # a label may stand in a third of all rows: its total meets them in several places
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = by_label.select(F.col("label").alias("of_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    rows = coded.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    rows = rows.join(by_label, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt")))
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return rows.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
                       F.lit(digest).alias("codebooks_sha256"), "label", "codes")


def _sql() -> str:
    """Plain k-means of the same rounds: every part against every entry."""
    steps = ["""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings WHERE len(embedding) > 0
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE)))),
cut AS (SELECT row, vec_id, len(e) // 4 AS w, unnest(range(4)) AS part, e FROM v),
p AS MATERIALIZED (SELECT row, vec_id, part, w, e[part * w + 1:(part + 1) * w] AS x FROM cut),
b0 AS MATERIALIZED (
  SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p)
  WHERE entry < 256)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, part, x, w, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c),
                               'entry': entry}}) AS best
  FROM p JOIN b{r} USING (part) GROUP BY row, part, x, w)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (
  SELECT part, entry, list(value ORDER BY pos) AS c FROM (
    SELECT part, best.entry AS entry, pos, floor(sum(x[pos]) / count(*)) AS value
    FROM a{r}, unnest(range(1, w + 1)) AS u(pos) GROUP BY ALL) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))""")
    last = f"""
f AS (SELECT row, string_agg(printf('%02x', best.entry::INT), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error,
             list(best.entry::INT ORDER BY part) AS codes FROM a{ROUNDS} GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS s
      FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256, label, codes
FROM f JOIN v USING (row) CROSS JOIN h"""
    return ",".join(steps) + "," + last


ORACLE_SQL = _sql()
