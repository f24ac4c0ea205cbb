"""Operators 1, 5 and 10 against brute force, with odd rows."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from llm_fixtures import empty_docs, odd_docs, pairs

from tallyframe.llm import simhash_dedup, sketch, substring_dedup, suffix_dedup
from tallyframe.llm.components import components
from tallyframe.llm.hashing import word_hashes
from tallyframe.llm.suffix_family import SuffixFamily, suffix_order

LAST = 2**63 - 1


def substring_brute(docs, window):
    words = [(d, re.findall("[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, LAST), LAST if d is None else d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (LAST if d is None else d):
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [3, 50])
def test_substring_dedup(spark, window):
    df = odd_docs(spark, ids_null=True)
    got = collections.Counter(tuple(r) for r in substring_dedup.remove_repeats(df, window=window).collect())
    assert got == substring_brute(pairs(df), window)
    assert sum(r[2] for r in got) > 0


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(empty_docs(spark)).count() == 0


def test_estimates_are_never_too_low():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 400, 300).astype(np.uint64) for _ in range(4)]
    import pyarrow as pa
    bits = 20
    parts = pa.concat_tables([sketch.fill(b, keys, bits) for b, keys in enumerate(blocks)])
    total = collections.Counter(int(k) for b in blocks for k in b)
    bodies = collections.defaultdict(dict)
    for shard in set(parts.column("shard").to_pylist()):
        rows = [r for r in parts.to_pylist() if r["shard"] == shard]
        cells = [np.cumsum(sketch.expand(r["cells"], np.uint32).astype(np.int64)) for r in rows]
        counts = np.zeros(1 << sketch.SHARD_BITS, np.int64)
        for r, c in zip(rows, cells):
            counts[c] += sketch.expand(r["counts"], np.uint32)
        for r, c in zip(rows, cells):
            bodies[r["block"]][shard] = np.packbits(counts[c] >= 2).tobytes()
    for b, keys in enumerate(blocks):
        yes = sketch.ask(keys, bodies[b], bits)[0]
        assert all(yes[i] for i, k in enumerate(keys) if total[int(k)] >= 2)
        assert yes.sum() < len(keys) or min(total.values()) >= 2


def test_word_hashes_agree_with_words():
    texts = [b"a b  a\tc", b"", b"\x0b c\n", "é a".encode()]
    hashes, counts = word_hashes(texts, most=4)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words))
    assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words))


@pytest.mark.parametrize("length", [4, 7, 33, 100])
def test_suffix_order_is_lexicographic(length):
    rng = random.Random(length)
    raw = bytes(rng.choice(b"ab\0") for _ in range(600)) + b"a" * 300
    at = np.array(sorted(rng.sample(range(len(raw) - length + 1), 400)))
    rank = suffix_order(np.frombuffer(raw, np.uint8), at, length)
    keys = [raw[i:i + length] for i in at]
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert rank.tolist() == [order[k] for k in keys]


def test_family_levels_merge_geometrically():
    rng, family, seen = random.Random(5), SuffixFamily(4), set()
    for batch in range(13):
        raw = bytes(rng.choice(b"abcd") for _ in range(60))
        at = np.arange(57)
        first, known = family.add(np.frombuffer(raw, np.uint8), at)
        keys = [raw[i:i + 4] for i in at]
        assert known.tolist() == [k in seen for k in keys]
        assert first.tolist() == [keys.index(k) for k in keys]
        seen |= set(keys)
        sizes = [n for n, _ in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(sizes) <= batch.bit_length() + 1
        assert sum(len(k) for _, k in family.levels) == len(seen)


@pytest.mark.parametrize("length,alphabet", [(8, "ab"), (40, "abé"), (100, "ab cdé")])
def test_suffix_dedup(spark, length, alphabet):
    rng = random.Random(length)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(12)]
    docs = [(i * 3, "".join(rng.choice(pool)[rng.randint(0, 50):] for _ in range(rng.randint(0, 4)))) for i in range(50)]
    docs += [(500, "a" * 400), (501, "a" * 300), (7, docs[0][1] + "x"), (510, None), (511, "")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(d, t, 1, b"k") for d, t in docs], "doc_id long, text string, block long, kept binary")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.remove_repeats(df, length=length).collect()}
    assert got == {r[0]: r[1:] for r in suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in docs], length)}


def test_suffix_dedup_repeated_and_null_ids(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefghij") for _ in range(150))
    df = spark.createDataFrame([(5, t), (5, t), (9, t), (None, t), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(5, 0), (5, 0), (9, 150), (None, 150), (2, 0)], key=str)
    assert suffix_dedup.remove_repeats(empty_docs(spark)).count() == 0


def test_suffix_dedup_as_text_carries_columns(spark):
    t = "é" * 120
    df = spark.createDataFrame([(1, t, "a", "x", 7, "s"), (2, "b" + t[:60], "b", "y", 8, "t")],
                               "doc_id long, text string, lang string, c0 string, n_removed int, kept_text string")
    rows = suffix_dedup.remove_repeats(df, carry=("c0", "lang", "n_removed", "kept_text"), as_text=True).collect()
    assert {(r.doc_id, *r.carried) for r in rows} == {(1, "x", "a", 7, "s"), (2, "y", "b", 8, "t")}
    assert {r.doc_id: r.kept_text for r in rows}[2] == "b"


def test_common_line_with_other_context_is_split(spark, monkeypatch):
    rng = random.Random(1)
    line = "this line of words stands in every one of the documents here"
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(130))
    docs = [(i, noise() + line + noise()) for i in range(40)] + [(90, "q" * 99)]
    docs += [(91 + i, docs[i][1][70:]) for i in range(4)]
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {r[0]: r[1:] for r in suffix_dedup.brute_force([(d, t.encode()) for d, t in docs], 100)}


def test_edges_of_a_common_passage_are_spread(spark, monkeypatch):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(180)
    docs = [(i, noise(80) + passage + noise(80)) for i in range(150)] + [(200 + i, passage[40:] + "x" * i) for i in range(60)]
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    blobs, ids = [t.encode() for _, t in docs], np.array([d for d, _ in docs])
    keys = suffix_dedup._Chunk(blobs, 100).minimizer_hashes()
    got = {r["shard"]: r for r in sketch.fill(0, keys, 20).to_pylist()}

    def answer(rows, levels):
        out = {}
        for k, r in rows.items():
            n = sketch.expand(r["counts"], np.uint32)
            out[k] = b"".join(np.packbits(n >= x).tobytes() for x in levels)
        return out

    told = answer(got, (2, 5))
    codes = suffix_dedup._finer_codes(blobs, told, 100, 20)
    told_finer = answer({r["shard"]: r for r in sketch.fill(0, codes, 20).to_pylist()}, (48,))
    assert np.unique(codes, return_counts=True)[1].max() > 100
    s = suffix_dedup._Segments(blobs, ids, told, told_finer, 100, 20, 20, 10_000)
    sent = [len(own) for _, own in s.by_shard()]
    assert max(sent) < 40
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {r[0]: r[1:] for r in suffix_dedup.brute_force([(d, t.encode()) for d, t in docs], 100)}


def test_simhash_near_components(spark):
    df = odd_docs(spark)
    rows = simhash_dedup.near_components(df).collect()
    got = collections.Counter((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in rows)
    assert got == collections.Counter(simhash_dedup.brute_force(pairs(df)))
    assert simhash_dedup.near_components(empty_docs(spark)).count() == 0


def test_simhash_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "z y x w v u t")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash_dedup.near_components(df).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}
    kept = simhash_dedup.one_of_each(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "z y x w v u t"), (4, "a b c d e")]


def test_simhash_unrelated_rows_without_own_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (7, e), (None, e), (9, f), (None, f)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_dedup.near_components(df).collect()
    assert collections.Counter(r.component_id for r in got) == {None: 3, 5: 2, 7: 2, 9: 2}
    assert len({r.component for r in got}) == 6
    kept = [(r.doc_id, r.text) for r in simhash_dedup.one_of_each(df).collect()]
    assert collections.Counter(kept) == collections.Counter([(None, a), (None, b), (5, c), (5, d), (7, e), (9, f)])


def test_simhash_rows_without_ids_do_not_join_others(spark):
    rng = random.Random(1)
    near = []
    for _ in range(2):  # two unrelated families: a text with an id, and another within the radius that has none
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        near.append((" ".join(words), " ".join(words[:-1])))
    blobs = [t.encode() for pair in near for t in pair]
    fp = [int(x) for x in simhash_dedup.fingerprints_of(blobs)]
    assert len(set(fp)) == 4 and all((fp[i] ^ fp[i + 1]).bit_count() <= simhash_dedup.RADIUS for i in (0, 2))
    df = spark.createDataFrame([(1, near[0][0]), (None, near[0][1]), (2, near[1][0]), (None, near[1][1])],
                               "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash_dedup.near_components(df).collect()} == {
        (1, 1), (None, 1), (2, 2), (None, 2)}
    assert {r.doc_id for r in simhash_dedup.one_of_each(df).collect()} == {1, 2}


@pytest.mark.parametrize("cap", [5, 1 << 16])
def test_links_of_dense_groups(spark, cap):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**63, 5)]
    fps = set()
    for i in range(400):
        f = base[i % 5]
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    roots = {r.node: r.root for r in components(simhash_dedup.links(df, 4, cap)).collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert all(roots.get(i, i) == find(i) for i in range(len(fps)))


def test_components_of_a_long_path(spark):
    n = 60
    ids = [(i * 7919) % 1009 for i in range(n)]
    df = spark.createDataFrame(list(zip(ids, ids[1:])) + [(2000, 2001), (2001, 2000), (3000, 3000)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert all(got[i] == min(ids) for i in ids) and got[2001] == got[2000] == 2000 and 3000 not in got


def test_pivot_distances_never_exceed_the_distance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    far = np.abs(simhash_dedup._coordinates(a).astype(int) - simhash_dedup._coordinates(b)).max(axis=1)
    assert (far <= np.bitwise_count(a ^ b)).all()
