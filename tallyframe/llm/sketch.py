"""A Count-min sketch that is merged and asked in shards, so that it grows with the corpus.

Documents are dealt into blocks. Each block counts its keys in ``rows`` hashed rows of ``2**bits``
cells and sends, for every shard of ``2**SHARD_BITS`` neighbouring cells, the cells it has filled. A
shard adds up the blocks' counts and answers each of them with one bit per level for each cell that
it sent: has the merged count reached the level? A key's estimate is the least count of its cells,
which is never below its true count, so asking for 2 or more loses no repeated key. No task holds
more than a shard of the sketch, and nothing is broadcast.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .hashing import U, mix

SHARD_BITS = 20
ROW_SHIFT = 44
SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0), U(0x082EFA98EC4E6C89))
ROWS_SCHEMA = "block long, shard long, cells binary, counts binary"
ANSWER_SCHEMA = "block long, kind int, shard long, body binary"


def bits_for(n_keys: float, load: float = 4.0) -> int:
    """Cells of a row, as a power of two: ``load`` or more for each key expected."""
    return max(SHARD_BITS, int(np.ceil(np.log2(max(1.0, n_keys * load)))))


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def squeeze(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def expand(body: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys ^ SEEDS[row]) >> U(64 - bits)


def _bounds(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shards that ascending cells fall into, and the bounds of each."""
    shard = cells >> U(SHARD_BITS)
    first = np.flatnonzero(np.diff(shard, prepend=U(2**63)))
    return shard[first].astype(np.int64), np.append(first, len(cells))


def fill(block: int, keys: np.ndarray, bits: int, rows: int = 2) -> pa.Table:
    """A block's part of the sketch. keys: one for each occurrence."""
    out = {"block": [], "shard": [], "cells": [], "counts": []}
    for row in range(rows):
        cells, counts = np.unique(cells_of(keys, row, bits), return_counts=True)
        low = (cells & U((1 << SHARD_BITS) - 1)).astype(np.int64)
        shards, at = _bounds(cells)
        for s, a, b in zip(shards.tolist(), at[:-1].tolist(), at[1:].tolist()):
            out["block"].append(block)
            out["shard"].append(row << ROW_SHIFT | s)
            out["cells"].append(squeeze(np.diff(low[a:b], prepend=0).astype(np.uint32)))
            out["counts"].append(squeeze(counts[a:b].astype(np.uint32)))
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("shard", pa.int64()),
                                           ("cells", pa.binary()), ("counts", pa.binary())]))


def merged(parts: DataFrame, levels: tuple[int, ...] = (2,)) -> DataFrame:
    """Adds the blocks' parts up by shard and answers every block for its own cells."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SHARD_BITS, np.int64)
        own = []
        for c, k in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist()):
            cells = np.cumsum(expand(c, np.uint32).astype(np.int64))
            total[cells] += expand(k, np.uint32)
            own.append(cells)
        body = [b"".join(np.packbits(total[c] >= n).tobytes() for n in levels) for c in own]
        return pa.table({"block": table.column("block"), "kind": pa.array([0] * len(own), pa.int32()),
                         "shard": table.column("shard"), "body": pa.array(body, pa.binary())})

    return parts.groupBy("shard").applyInArrow(add, ANSWER_SCHEMA)


def answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    """A block's answers of one kind, by shard."""
    return {s: b for k, s, b in zip(table.column("kind").to_pylist(), table.column("shard").to_pylist(),
                                    table.column("body").to_pylist()) if k == kind}


def ask(keys: np.ndarray, got: dict[int, bytes], bits: int, rows: int = 2, n_levels: int = 1) -> np.ndarray:
    """For each of a block's keys and each level: has the key's least count in the rows reached it?"""
    out = np.ones((n_levels, len(keys)), bool)
    for row in range(rows):
        cells, inverse = np.unique(cells_of(keys, row, bits), return_inverse=True)
        shards, at = _bounds(cells)
        yes = np.zeros((n_levels, len(cells)), bool)
        for s, a, b in zip(shards.tolist(), at[:-1].tolist(), at[1:].tolist()):
            part = np.frombuffer(got[row << ROW_SHIFT | s], np.uint8).reshape(n_levels, -1)
            yes[:, a:b] = np.unpackbits(part, axis=1, count=b - a).astype(bool)
        out &= yes[:, inverse]
    return out
