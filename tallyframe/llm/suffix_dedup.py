"""Operator 5, suffix-array dedup: byte matches of a given length, found by a family of suffix arrays.

Every string of ``length`` bytes is dealt by its minimizer, the smallest hash of the ``GRAM``-byte
grams in it: equal strings have the same one, and neighbouring strings mostly share it, so they travel
together as one segment of text. Four passes over blocks of documents:

1. Each block counts its minimizer places in a sharded Count-min sketch (:mod:`sketch`); a string whose
   minimizer is estimated to stand in one place only cannot repeat. The estimate is never too low.
2. A minimizer found in ``HOT`` places or more, such as a common line with ever other text around it, is
   split by two further hashes of the same string. Strings that reach a little over the edge of a common
   passage share these too, so each block counts its different segments for each such code in a second sketch.
3. The other segments go to the shard of their minimizer or code. A block sends equal segments once. Where a
   code stands for ``HOT`` segments or more, and more than one for each block, its strings are dealt one by one
   by a hash of all their bytes. A shard takes its segments in the order of their documents, in batches, through a
   :class:`SuffixFamily`: each batch gets a suffix array, is scanned against the levels for matches of
   the full length, and equal-sized levels merge. The shard answers with one bit for each string.
4. Each block removes the bytes that repeated strings cover.

Defined cases: a null text is empty; matches never cross documents; "earlier" is a smaller id, or the
same id and an earlier start, so of rows with one and the same id and text neither is earlier at the
same start; a null id counts as the largest. Texts shorter than ``length`` stay whole.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from . import sketch
from .common import blobs_of, documents, give_back, ids_of, n_blocks, total_bytes
from .hashing import BYTE_VALUE, U, chunks, mix, rolling, sliding
from .suffix_family import SuffixFamily

LENGTH = 100
GRAM = 32
HOT = 128
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 1 << 20
BATCH_BYTES = 1 << 17
CHUNK = 1 << 16
PART_SCHEMA = "block long, shard long, text binary, sizes binary, ids binary, starts binary"
RESULT = (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", T.BinaryType()), ("n_spans", T.LongType()))


class _Chunk:
    """Neighbouring texts of a block as one byte array, with the gram hashes and minimizers in it."""

    def __init__(self, blobs: list[bytes], length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.width = length - self.gram + 1
        self.buf = np.frombuffer(b"".join(blobs), np.uint8)
        sizes = np.array([len(x) for x in blobs], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.grams = rolling(BYTE_VALUE[self.buf], self.gram)
        self.least = sliding(self.grams, self.width)
        self.valid = np.zeros(len(self.least), bool)
        for a, b in zip(self.begins.tolist(), self.ends.tolist()):
            self.valid[a:max(a, b - length + 1)] = True

    def minimizer_hashes(self) -> np.ndarray:
        """Hash of each place that is the smallest of some valid string: one for each occurrence."""
        if not self.valid.any():
            return np.zeros(0, np.uint64)
        bound = np.where(self.valid, self.least, U(0))
        pad = np.zeros(self.width - 1, np.uint64)
        largest = sliding(np.concatenate([pad, bound, pad]), self.width, np.maximum)
        return self.grams[largest == self.grams]

    def runs(self, code: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 string of each run of wanted strings that share a code within a document."""
        if not wanted.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        change = np.ones(len(code), bool)
        change[1:] = (code[1:] != code[:-1]) | (wanted[1:] != wanted[:-1])
        change[self.begins[self.begins < len(code)]] = True
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(code))
        keep = wanted[first]
        return first[keep], last[keep]

    def finer(self, at: np.ndarray) -> np.ndarray:
        """For strings with a very common minimizer: a hash of the largest gram and of a second smallest."""
        second = sliding(self.grams * U(0x5851F42D4C957F2D), self.width)
        return mix(sliding(self.grams, self.width, np.maximum)[at] + mix(second[at]))

    def whole(self, at: np.ndarray) -> np.ndarray:
        """A hash of all bytes of each string."""
        return rolling(BYTE_VALUE[self.buf], self.length)[at]


def _coded(blobs: list[bytes], got: dict[int, bytes], length: int, bits: int):
    """Of a block's chunks that may repeat: the first document, the chunk, each string's code, which strings
    may repeat, and the places of those with a very common minimizer."""
    parts = [(a, _Chunk(blobs[a:b], length)) for a, b in chunks([len(x) for x in blobs], CHUNK)]
    keys = np.concatenate([np.zeros(0, np.uint64), *(c.minimizer_hashes() for _, c in parts)])
    distinct = np.unique(keys)
    repeated, hot = sketch.ask(distinct, got, bits, n_levels=2)
    repeated, hot = distinct[repeated], distinct[hot]
    member = lambda values, among: (
        among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values
        if len(among) else np.zeros(len(values), bool))
    for a, c in parts:
        if not len(c.least) or not len(repeated):
            continue
        change = np.concatenate([[True], c.least[1:] != c.least[:-1]])
        of = np.cumsum(change) - 1
        wanted = member(c.least[change], repeated)[of] & c.valid
        code = c.least.copy()
        common = np.flatnonzero(member(c.least[change], hot)[of] & wanted)
        if len(common):
            code[common] = mix(code[common] + c.finer(common))
        yield a, c, code, wanted, common


def _finer_codes(blobs: list[bytes], got: dict[int, bytes], length: int, bits: int) -> np.ndarray:
    """Codes of a block's strings with very common minimizers, one for each different segment."""
    seen: set[tuple[int, bytes]] = set()
    for _, c, code, _, common in _coded(blobs, got, length, bits):
        hot = np.zeros(len(code), bool)
        hot[common] = True
        first, last = c.runs(code, hot)
        raw = c.buf.tobytes()
        seen.update((k, raw[x:y]) for k, x, y in zip(code[first].tolist(), first.tolist(), (last + (length - 1)).tolist()))
    return np.array([k for k, _ in seen], np.uint64)


class _Segments:
    """Segments of a block that may repeat, in a fixed order; equal ones stand in for each other."""

    def __init__(self, blobs: list[bytes], ids: np.ndarray, got: dict[int, bytes], got_finer: dict[int, bytes], length: int,
                 bits: int, finer_bits: int, shards: int):
        doc, start, size, shard, text = [], [], [], [], []
        parts = list(_coded(blobs, got, length, bits))
        finer = np.unique(np.concatenate([np.zeros(0, np.uint64), *(code[common] for _, _, code, _, common in parts)]))
        crowded = finer[sketch.ask(finer, got_finer, finer_bits)[0]]
        for a, c, code, wanted, common in parts:
            common = common[np.isin(code[common], crowded)]
            if len(common):
                code[common] = mix(code[common] + c.whole(common))
            first, last = c.runs(code, wanted)
            d = np.searchsorted(c.ends, first, side="right")
            doc.append(a + d)
            start.append(first - c.begins[d])
            size.append(last - first)
            shard.append(((mix(code[first]) >> U(32)) * U(shards)) >> U(32))
            raw = c.buf.tobytes()
            text += [raw[x:y] for x, y in zip(first.tolist(), (last + (length - 1)).tolist())]
        join = lambda parts, t: np.concatenate([np.zeros(0, t), *parts]).astype(t)
        self.doc, self.start, self.size = join(doc, np.int64), join(start, np.int64), join(size, np.int64)
        self.shard, self.text, self.ids = join(shard, np.int64), text, ids
        order = np.lexsort((self.start, ids[self.doc] if len(self.doc) else self.doc, self.shard))
        seen: dict[tuple[int, bytes], int] = {}
        self.sent, self.like = [], np.empty(len(order), np.int64)
        for i in order.tolist():
            j = seen.setdefault(text[i], i)
            self.like[i] = j
            if i == j:
                self.sent.append(i)

    def by_shard(self):
        """(shard, its sent segments in order)"""
        sent = np.array(self.sent, np.int64)
        shard = self.shard[sent]
        first = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(first.tolist(), np.append(first[1:], len(sent)).tolist()):
            yield int(shard[a]), sent[a:b]


def _match(table: pa.Table, length: int) -> pa.Table:
    """One shard: its segments, in order of document and start, through the family of suffix arrays."""
    texts = table.column("text").to_pylist()
    sizes, ids, starts = ([sketch.expand(x, np.int64) for x in table.column(c).to_pylist()]
                          for c in ("sizes", "ids", "starts"))
    from_block = [len(x) for x in sizes]
    sizes, ids, starts = np.concatenate(sizes), np.concatenate(ids), np.concatenate(starts)
    joined = b"".join(map(sketch.unpack, texts))
    raw = np.frombuffer(joined, np.uint8)
    spans = sizes + (length - 1)
    begin = np.cumsum(spans) - spans
    order = np.lexsort((starts, ids))
    # of equal segments from several blocks the first is indexed; the later ones repeat it throughout
    seen: dict[bytes, int] = {}
    like = np.empty(len(order), np.int64)
    for i in order.tolist():
        a = int(begin[i])
        like[i] = seen.setdefault(joined[a:a + int(spans[i])], i)
    later = (ids != ids[like]) | (starts != starts[like])
    order = order[like[order] == order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(starts[order]) != 0)
    family = SuffixFamily(length)
    repeated = [np.zeros(0, bool)] * len(sizes)
    total = np.cumsum(spans[order])
    at = 0
    while at < len(order):
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES, side="right"))
        to = max(to, at + 1)
        while to < len(order) and not new[to]:
            to += 1
        own = order[at:to]
        n, size = spans[own], sizes[own]
        text = np.concatenate([raw[b:b + k] for b, k in zip(begin[own].tolist(), n.tolist())])
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        where = np.repeat(np.cumsum(n) - n, size) + place
        doc, start = np.repeat(ids[own], size), np.repeat(starts[own], size) + place
        first, known = family.add(text, where)
        known |= (doc != doc[first]) | (start != start[first])
        for i, part in zip(own.tolist(), np.split(known, np.cumsum(size)[:-1])):
            repeated[i] = part
        at = to
    for i in np.flatnonzero(like != np.arange(len(like))).tolist():
        repeated[i] = np.ones(int(sizes[i]), bool) if later[i] else repeated[int(like[i])]
    cut = np.cumsum([0] + from_block)
    body = [np.packbits(np.concatenate(repeated[a:b])).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return pa.table({"block": table.column("block"), "kind": pa.array([1] * len(body), pa.int32()),
                     "shard": table.column("shard"), "body": pa.array(body, pa.binary())})


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed spans (pairs of int64: start, end), n_spans and the kept bytes.

    ``carry`` names further columns to return, as fields of the struct ``carried``, so that they may be named like
    any of the above. With ``as_text`` the kept part comes as ``kept_text``, without the rest of characters that
    were cut.
    """
    ship_package(docs.sparkSession)
    extra = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                       *[docs[c].alias(n) for c, n in zip(carry, extra)])
    last = T.StructField("kept_text", T.StringType()) if as_text else T.StructField("kept", T.BinaryType())
    schema = T.StructType([rows.schema["doc_id"], *(rows.schema[n] for n in extra), *(T.StructField(*r) for r in RESULT), last])
    nbytes = total_bytes(rows)
    blocks = n_blocks(nbytes, block_bytes)
    bits = sketch.bits_for(nbytes / 30)
    finer_bits = max(sketch.SHARD_BITS, bits - 6)
    shards = n_blocks(nbytes, SHARD_BYTES)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "text", *extra)

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs = blobs_of(table)
        keys = [_Chunk(blobs[a:b], length).minimizer_hashes() for a, b in chunks([len(x) for x in blobs], CHUNK)]
        return sketch.fill(key[0].as_py(), np.concatenate([np.zeros(0, np.uint64), *keys]), bits)

    def segments(table: pa.Table, got: pa.Table) -> _Segments:
        return _Segments(blobs_of(table), ids_of(table), sketch.answers(got, 0), sketch.answers(got, 2), length, bits,
                         finer_bits, shards)

    def count_finer(key, table: pa.Table, got: pa.Table) -> pa.Table:
        codes = _finer_codes(blobs_of(table), sketch.answers(got, 0), length, bits)
        give_back()
        return sketch.fill(key[0].as_py(), codes, finer_bits)

    def send(key, table: pa.Table, got: pa.Table) -> pa.Table:
        s = segments(table, got)
        out = {"block": [], "shard": [], "text": [], "sizes": [], "ids": [], "starts": []}
        for shard, own in s.by_shard():
            out["block"].append(key[0].as_py())
            out["shard"].append(shard)
            out["text"].append(sketch.pack(b"".join([s.text[i] for i in own.tolist()])))
            out["sizes"].append(sketch.squeeze(s.size[own]))
            out["ids"].append(sketch.squeeze(s.ids[s.doc[own]]))
            out["starts"].append(sketch.squeeze(s.start[own]))
        del s
        give_back()
        kinds = [("block", pa.int64()), ("shard", pa.int64()), *((c, pa.binary()) for c in ("text", "sizes", "ids", "starts"))]
        return pa.table(out, schema=pa.schema(kinds))

    def match(table: pa.Table) -> pa.Table:
        return _match(table, length)

    def remove(key, table: pa.Table, got: pa.Table) -> pa.Table:
        s = segments(table, got)
        blobs = blobs_of(table)
        told = sketch.answers(got, 1)
        sizes = np.array([len(x) for x in blobs], np.int64)
        base = np.cumsum(sizes + 1) - (sizes + 1)
        edge = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
        begin = base[s.doc] + s.start
        later = (s.ids[s.doc] != s.ids[s.doc[s.like]]) | (s.start != s.start[s.like])
        np.add.at(edge, begin[later], 1)
        np.add.at(edge, begin[later] + (s.size[later] - 1 + length), -1)
        bits_at, told_bits, n = np.zeros(len(s.size), np.int64), [np.zeros(0, bool)], 0
        for shard, own in s.by_shard():
            size = s.size[own]
            bits_at[own] = n + np.cumsum(size) - size
            told_bits.append(np.unpackbits(np.frombuffer(told[shard], np.uint8), count=int(size.sum())).astype(bool))
            n += int(size.sum())
        yes = np.concatenate(told_bits)
        first = np.flatnonzero(~later)
        size = s.size[first]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        hit = yes[np.repeat(bits_at[s.like[first]], size) + place]
        at = (np.repeat(begin[first], size) + place)[hit]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        covered = np.cumsum(edge) > 0
        out = {"n_bytes": [], "n_removed": [], "spans": [], "n_spans": [], "kept": []}
        for blob, b in zip(blobs, base.tolist()):
            gone = covered[b:b + len(blob)]
            spans, kept = np.zeros((0, 2), np.int64), blob
            if gone.any():
                spans = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
                kept = np.frombuffer(blob, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(blob))
            out["n_removed"].append(len(blob) - len(kept))
            out["spans"].append(np.ascontiguousarray(spans, "<i8").tobytes())
            out["n_spans"].append(len(spans))
            out["kept"].append(kept)
        kept = out.pop("kept")
        del s, covered, edge
        give_back()
        kept = {"kept_text": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())} if as_text \
            else {"kept": pa.array(kept, pa.binary())}
        return pa.table({c: table.column(c) for c in ("doc_id", *extra)}
                        | {c: pa.array(v, pa.binary() if c == "spans" else pa.int64()) for c, v in out.items()} | kept)

    by_block = dealt.groupBy("block")
    estimates = sketch.merged(by_block.applyInArrow(count, sketch.ROWS_SCHEMA), (2, HOT))
    finer = by_block.cogroup(estimates.groupBy("block")).applyInArrow(count_finer, sketch.ROWS_SCHEMA)
    finer = sketch.merged(finer, (max(HOT, blocks),)).withColumn("kind", F.lit(2))
    estimates = estimates.unionByName(finer)
    parts = by_block.cogroup(estimates.groupBy("block")).applyInArrow(send, PART_SCHEMA)
    matched = parts.groupBy("shard").applyInArrow(match, sketch.ANSWER_SCHEMA)
    told = estimates.unionByName(matched)
    out = by_block.cogroup(told.groupBy("block")).applyInArrow(remove, schema)
    carried = [F.struct(*[F.col(n).alias(c) for c, n in zip(carry, extra)]).alias("carried")] if carry else []
    return out.select("doc_id", *carried, *[n for n, _ in RESULT], last.name)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], length: int) -> list[tuple[int, int, int, int, str]]:
    """The same result by a dictionary of all strings, for tests."""
    first: dict[bytes, tuple[int, int]] = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            k = t[i:i + length]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] < (d, i):
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
