"""Operator 3, best-fit packing: documents into sequences of fixed length, improved by local search.

Documents are encoded and end in id 1; only those longer than a sequence are cut, into full pieces and a
last shorter one. Pieces are dealt into groups; each group is packed best-fit decreasing and then
improved by swaps (:mod:`local_search`) until it has as few sequences as a lower bound or no exchange empties
one. What groups can save only together is about a sequence each: of every group the ``OPEN`` emptiest sequences,
or those that have the room of one sequence in all, go up to a level with ``FAN`` times fewer groups, are packed
anew with their neighbours', and so on up to one group; the others are closed where they stand. So no task of a
higher level holds more than ``FAN * OPEN`` sequences, whatever the lengths. Only ids and lengths travel; a level
is written to the shared folder.

Defined cases: a null or empty text is the single id 1; repeated rows are packed one by one; a row with a
null id keeps it. An empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs_of, documents, give_back, id_text, n_blocks, saved, total_bytes
from .hashing import chunks, forget_powers
from .local_search import pack, worth_merging
from .tokens import CHUNK, KEPT, forget_words, vocabulary_path, word_ids

LENGTH = 4096
END = 1
GROUP_BYTES = 64 << 20
FAN = 64
OPEN = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, grp long"
PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, grp long, sequence_id long, offset long, "
          "open boolean")


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, groups: int = 1, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT, keep_words: bool = True) -> DataFrame:
    """Encoded documents in pieces of up to ``length`` ids, dealt into groups."""
    path = path or vocabulary_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(path, kept), 0
        for batch in batches:
            blobs = blobs_of(pa.Table.from_batches([batch]))
            for a, b in chunks([len(x) for x in blobs], CHUNK):
                part = batch.slice(a, b - a)
                ids = encoder.of(blobs[a:b])
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for doc, raw in zip(part.column(0).to_pylist(), ids):
                    raw += end
                    for piece, a in enumerate(range(0, len(raw), 4 * length)):
                        cut = raw[a:a + 4 * length]
                        for name, value in zip(out, (doc, piece, a // 4, len(cut) // 4, zlib.crc32(cut),
                                                     cut if with_ids else None)):
                            out[name].append(value)
                n = len(out["piece"])
                # by turns: any run of a task's pieces is spread evenly, equal ids too
                out["grp"] = (np.arange(seen, seen + n) * 0x9E3779B1 + (out["doc_id"][0] or 0) % groups * 31) % groups if n else []
                seen += n
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("grp", pa.int64())]))
        if not keep_words:
            del encoder
            forget_words()
            forget_powers()
        give_back()

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def _packer(length: int, level: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = table.column("length").combine_chunks().to_numpy(zero_copy_only=False)
        order = pa.compute.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"),
                                                ("piece", "ascending"), ("start", "ascending")]).to_numpy()
        table, sizes = table.take(pa.array(order)), sizes[order]
        bins = pack(sizes, length)
        by_bin = np.argsort(bins, kind="stable")
        inside = np.cumsum(sizes[by_bin]) - sizes[by_bin]
        first = np.flatnonzero(np.diff(bins[by_bin], prepend=-1))
        offset = np.empty(len(sizes), np.int64)
        offset[by_bin] = inside - np.repeat(inside[first], np.diff(np.append(first, len(sizes))))
        filled = np.bincount(bins, weights=sizes).astype(np.int64)
        meets_others = worth_merging(filled, length, OPEN)[bins]
        group = key[0].as_py()
        sequence = (level << 57) | (group << 25) | bins.astype(np.int64)
        out = table.drop_columns([c for c in ("sequence_id", "offset", "open") if c in table.column_names])
        for name, value in (("sequence_id", sequence), ("offset", offset), ("open", meets_others)):
            out = out.append_column(name, pa.array(value))
        return out.select([x.split()[0] for x in PACKED.split(", ")])
    return run


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", group_bytes: int = GROUP_BYTES, kept: int = KEPT,
                   keep_words: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    ``kept`` bounds the words whose ids a Python worker remembers, ``keep_words`` tells whether it does so after
    a task has ended: memory against time, same result.
    """
    rows = id_text(docs, id_col, text_col)
    groups = n_blocks(total_bytes(rows), group_bytes)
    level = 0
    done = None
    todo = pieces(rows, length, path, groups, kept=kept, keep_words=keep_words).drop("ids")
    while True:
        packed = todo.groupBy("grp").applyInArrow(_packer(length, level), PACKED)
        if groups > 1:
            packed = saved(packed)
        final = packed if groups == 1 else packed.where(~F.col("open"))
        done = final if done is None else done.unionByName(final)
        if groups == 1:
            return done.drop("grp", "open")
        groups = -(-groups // FAN)
        level += 1
        todo = packed.where("open").drop("sequence_id", "offset", "open")
        todo = todo.withColumn("grp", F.floor(F.col("grp") / FAN).cast("long"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
