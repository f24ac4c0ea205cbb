"""Operator 10, SimHash near-dedup: pivot distance tables.

Each document has a 64-bit fingerprint over its word shingles; fingerprints link at ``radius`` or
fewer differing bits. For every distinct fingerprint the Hamming distances to ``PIVOTS`` reference
fingerprints are computed once. By the triangle inequality two fingerprints differ in at least as many
bits as any of these distances differ, so a pair whose largest coordinate difference exceeds the radius
is discarded, and only survivors are compared bit by bit.

So that no fingerprint meets all others, pairs first meet in tables: the 64 bits are cut into n blocks,
and since ``radius`` differing bits touch ``radius`` blocks at most, two linked fingerprints agree in
some choice of n - radius blocks. There is one table for each choice, keyed by these blocks. n grows with
the number of fingerprints so that a key stays nearly unique; for any n no link is lost. Within a key,
up to ``SMALL`` fingerprints are compared pair by pair; more are linked by growing each component from
its members, which writes one edge for each fingerprint, not one for each pair. Keys with over
``CAP`` fingerprints are cut into parts, and every two parts meet in a task of their own.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; fewer words
than a shingle count as one shingle; a null id counts as the largest, and a component's id is null only if
no row in it has one. Fingerprints alone link rows: rows with one id and different texts, or without ids,
are documents of their own. Two components may thus have one id, or both none; ``component`` tells them apart.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, blobs_of, documents, give_back, id_text, saved
from .components import components
from .hashing import U

SHINGLE = 4
RADIUS = 4
SEED = 42
PIVOTS = np.random.Generator(np.random.PCG64(10)).integers(0, 2**64, 24, dtype=np.uint64)
SMALL = 8
CAP = 1 << 16
SALTS = 16
LANES = U(0x0101010101010101)


def _vote(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits set in over half of each text's hashes. Counts of one set bit in eight are added up at a
    time, in the eight bytes of a word, 255 hashes at most before they are taken apart."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts[full])
    begins = ends - counts[full]
    pieces = -(-counts[full] // 255)
    first_piece = np.cumsum(pieces) - pieces
    at = np.repeat(begins, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first_piece, pieces))
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> U(shift)) & LANES, at).view(np.uint8).reshape(-1, 8)
        set_bits = np.add.reduceat(lanes.astype(np.int64), first_piece, axis=0)
        for lane in range(8):
            on = 2 * set_bits[:, lane] > counts[full]
            out[full] |= on.astype(np.uint64) << U(8 * lane + shift)
    return out


def fingerprints_of(blobs: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts: A-Z in lower case, words between ASCII white space, all shingles."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for blob in blobs:
        words = blob.lower().split()
        if len(words) <= shingle:
            hashes += [digest(b" ".join(words), SEED)] * bool(words)
            counts.append(int(bool(words)))
            continue
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        n = len(words) - shingle + 1
        hashes += [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())]
        counts.append(n)
    return _vote(np.array(hashes, np.uint64), np.array(counts, np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, fp): a hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = blobs_of(pa.Table.from_batches([batch]))
            fp = np.concatenate([fingerprints_of(blobs[i:i + 64], shingle) for i in range(0, len(blobs), 64)]
                                or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(fp.view(np.int64))],
                                             ["doc_id", "tie", "fp"])
        give_back()

    rows = id_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, fp long")


def block_widths(n: int, radius: int) -> list[int]:
    """Widths of the fewest blocks whose keys are nearly unique among n fingerprints."""
    for blocks in range(radius + 1, 65):
        widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        if sum(widths[radius:]) >= min(48, max(1, n).bit_length() + 1):
            return widths
    return [1] * 64


def _coordinates(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)


def _tables(widths: list[int], radius: int):
    """Emits each fingerprint, with its pivot distances, once for each choice of agreeing blocks."""
    lows = np.cumsum([0] + widths[:-1])
    masks = [((1 << w) - 1) << int(a) for w, a in zip(widths, lows)]
    choices = [U(sum(c)) for c in combinations(masks, len(widths) - radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            far = pa.array([x.tobytes() for x in _coordinates(fp)], pa.binary())
            for i, mask in enumerate(choices):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), i, np.int32)), pa.array((fp & mask).view(np.int64)),
                     batch.column("fp"), batch.column("rep"), far], ["choice", "key", "fp", "rep", "far"])

    return run


def _grow(fp: np.ndarray, far: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that span the components of many fingerprints. Candidates of a member are cut out of the
    free ones by pivot distances, first through the order of one pivot, then by the largest difference."""
    free = np.argsort(far[:, 0], kind="stable")
    edges, waiting = [], []
    while len(free) or waiting:
        if not waiting:
            waiting, free = [int(free[0])], free[1:]
        x = waiting.pop()
        near = far[free, 0].astype(np.int16)
        a, b = np.searchsorted(near, int(far[x, 0]) - radius), np.searchsorted(near, int(far[x, 0]) + radius, "right")
        candidates = free[a:b]
        ok = np.abs(far[candidates].astype(np.int16) - far[x]).max(axis=1, initial=0) <= radius
        ok[ok] = np.bitwise_count(fp[candidates[ok]] ^ fp[x]) <= radius
        found = candidates[ok]
        edges += [(x, int(y)) for y in found]
        waiting += found.tolist()
        keep = np.ones(len(free), bool)
        keep[a:b] = ~ok
        free = free[keep]
    return edges


def _linker(radius: int):
    """Edges within runs of one key, from rows sorted by key; a run may go on over batches."""

    def link(rows: pa.Table) -> pa.RecordBatch:
        fp = rows.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        rep = rows.column("rep").combine_chunks().to_numpy(zero_copy_only=False)
        far = np.frombuffer(b"".join(rows.column("far").to_pylist()), np.int8).reshape(len(fp), -1)
        begins = np.flatnonzero(_starts(rows))
        sizes = np.diff(np.append(begins, len(fp)))
        run = np.repeat(np.arange(len(begins)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        left, right = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d]) if d < len(fp) else np.zeros(0, np.int64)
            i = i[np.abs(far[i].astype(np.int16) - far[i + d]).max(axis=1, initial=0) <= radius]
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            left.append(i)
            right.append(i + d)
        for b in np.flatnonzero(sizes > SMALL).tolist():
            at, n = int(begins[b]), int(sizes[b])
            pairs = np.array(_grow(fp[at:at + n], far[at:at + n], radius), np.int64).reshape(-1, 2) + at
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
        left, right = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(rep[left]), pa.array(rep[right])], ["a", "b"])

    def _starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in ("choice", "key", "part", "other"):
            v = rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            begins = np.flatnonzero(_starts(rows))
            if not len(begins):
                continue
            held = rows.slice(int(begins[-1]))
            if begins[-1]:
                yield link(rows.slice(0, int(begins[-1])))
        if held is not None and held.num_rows:
            yield link(held)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """Edges (a, b) between the representatives of distinct fingerprints (fp, rep): every pair within
    the radius is an edge or joined by a path of edges that are themselves within the radius."""
    n = distinct.count()
    rows = distinct.mapInArrow(_tables(block_widths(n, radius), radius),
                               "choice int, key long, fp long, rep long, far binary")
    many = rows.groupBy("choice", "key").count().where(F.col("count") > cap)
    rows = rows.join(many, ["choice", "key"], "left")
    parts = F.coalesce(F.ceil(F.col("count") / cap), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts)
    rows = rows.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = rows.select("choice", "key", F.least("own", "met").alias("part"), F.greatest("own", "met").alias("other"),
                       "fp", "rep", "far")
    key = ["choice", "key", "part", "other"]
    rows = rows.repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(_linker(radius), "a long, b long").distinct()


def near_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, tie, fp, component_id, component): the smallest id and the smallest fingerprint (as a signed
    long) reachable over links, the row's own included."""
    fps = saved(fingerprints(docs, shingle, id_col, text_col))
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    # a component may be a third of all fingerprints: its id meets them in several places
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("of_fp"), "least", "root", F.coalesce("root", "fp").alias("component"),
        F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    ids = of.where("root IS NOT NULL").groupBy("component").agg(F.min("least").alias("smallest"))
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    of = of.join(ids, ["component", "salt"], "left").select(
        "of_fp", F.coalesce("smallest", "least").alias("component_id"), "component")
    return fps.join(of, F.col("fp") == F.col("of_fp")).select("doc_id", "tie", "fp", "component_id", "component")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id, then the smallest hash of its text, then
    of the whole row."""
    groups = near_components(docs, shingle, radius)
    order = F.struct(F.coalesce("doc_id", F.lit(int(LAST_ID))).alias("id"), "tie")
    first = groups.groupBy("component").agg(F.min(order).alias("first")).select("first.id", "first.tie")
    own_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(int(LAST_ID)))
    own_tie = F.xxhash64(docs["text"].cast("string"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(own_id.alias("id"), own_tie.alias("tie"), *[docs[c].alias(n) for c, n in zip(docs.columns, names)])
    kept = rows.join(first, ["id", "tie"], "left_semi")
    kept = kept.groupBy("id", "tie").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    return kept.select(*[F.col("row")[n].alias(c) for c, n in zip(docs.columns, names)])


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


ORACLE_SQL = None  # DuckDB has no XXH64 with a seed; tests compare with brute force


def brute_force(texts: list[tuple[int, str | None]], shingle: int = SHINGLE, radius: int = RADIUS):
    """(doc_id, fingerprint, component_id) from the definition, for tests."""
    import re
    fps = []
    for d, t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), SEED) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{f:016x}", least[find(i)]) for i, ((d, _), f) in enumerate(zip(texts, fps))]
