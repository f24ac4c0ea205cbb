"""Operators 2, 3, 8 and 9, with odd rows."""
import collections
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import SF, empty_docs, odd_docs, pairs
from pyspark.sql import functions as F

from tallyframe.llm import fingerprint, local_search, noisy_channel, packing, token_counts, tokens, toxicity
from tallyframe.llm.common import documents

# ---- 2: fingerprints ---------------------------------------------------------------------


def vote(spark, text, shingle=fingerprint.SHINGLE):
    """The fingerprint from its definition, term by term; Spark gives the hashes."""
    words = [w for w in (text or "").split() if w]
    if not words:
        return "0" * 16 * fingerprint.SEEDS
    if len(words) < shingle:
        whole = " ".join(words)
        terms = [(whole,) * shingle]
    else:
        terms = [tuple(words[i:i + shingle]) for i in range(len(words) - shingle + 1)]
    rows = spark.createDataFrame(terms, [f"w{i}" for i in range(shingle)])
    hashes = rows.select(*[F.xxhash64(F.lit(s), *[F.xxhash64(f"w{i}") for i in range(shingle)]).alias(f"x{s}")
                           for s in range(fingerprint.SEEDS)]).collect()
    out = ""
    for s in range(fingerprint.SEEDS):
        bits = 0
        for b in range(64):
            if 2 * sum((r[s] >> b) & 1 for r in hashes) > len(hashes):
                bits |= 1 << b
        out += f"{bits:016x}"
    return out


def test_fingerprints_by_definition(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b"), (3, None), (4, ""), (5, "  a b c d e f\n"), (None, "x"),
                                (6, "a b c d e f a b c d e f"), (7, "a")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    assert got == {i: vote(spark, t) for i, t in pairs(df)}
    assert got[1] == got[5] and got[3] == got[4] == "0" * 32


def test_lanes_hold_more_than_a_run(spark):
    df = spark.createDataFrame([(1, "a b c " * 30000), (2, "a b c " * 30)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()}
    # three terms by turns; counts differ by one at most, so the longer text votes like the terms' majority
    assert got[1] == vote(spark, "a b c a b")


def test_op2_query(spark):
    rows = sorted(map(tuple, fingerprint.op2_fingerprints(spark, SF).collect()))
    docs = sorted((d, t or "") for d, t in pairs(documents(spark, SF)))
    assert len(rows) == len(docs)
    prints = {r[0]: r[3] for r in rows}
    bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / (64 * fingerprint.SEEDS)
    better = 0
    for i, (r, (d, t)) in enumerate(zip(rows, docs)):
        after = docs[(i + 1) % len(docs)]
        edited = t[:len(t) - len(t) // 2] + after[1][:len(t) // 2]
        assert r[:3] == (d, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r[5] == pytest.approx(bits(r[3], r[4])) and r[6] == pytest.approx(bits(r[3], prints[after[0]]))
        better += r[5] > r[6]
    assert better > 0.9 * len(rows)


def test_fingerprint_odd_rows(spark):
    df = fingerprint.keyed(odd_docs(spark, ids_null=True))
    order = fingerprint.with_next(df.select("doc_id", "n_chars", "row").distinct()).collect()
    ring = {r.row: r.next for r in order}
    at, seen = order[0].row, []
    while at not in seen:
        seen.append(at)
        at = ring[at]
    assert len(seen) == len(ring)
    by_id = sorted(order, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.row))
    assert [ring[r.row] for r in by_id] == [r.row for r in by_id[1:] + by_id[:1]]
    assert fingerprint.fingerprints(empty_docs(spark)).count() == 0


def test_near_pairs_finds_all(spark):
    rng = np.random.default_rng(3)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(4)]
    fps = set()
    for i in range(60):
        f = base[i % 4]
        for b in rng.integers(0, 128, rng.integers(0, 5)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(f"{f:032x}" for f in fps)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fingerprint string")
    got = {(r.a, r.b, r.bits) for r in fingerprint.near_pairs(df, 3).collect()}
    d = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == {(a, b, d(a, b)) for i, a in enumerate(fps) for b in fps[i + 1:] if d(a, b) <= 3}


def test_near_counts_of_a_large_family(spark, monkeypatch):
    """Many near copies share a key, cut into parts: counts as by comparing all, and no pair leaves the arrays."""
    monkeypatch.setattr(fingerprint, "CAP", 16)
    rng = np.random.default_rng(4)
    base = int.from_bytes(rng.bytes(16), "big")
    fps = {base ^ sum(1 << int(b) for b in rng.choice(128, rng.integers(0, 4), replace=False)) for _ in range(200)}
    fps |= {int.from_bytes(rng.bytes(16), "big") for _ in range(50)} | {0, (1 << 128) - 1, 1 << 127}
    fps = sorted(f"{f:032x}" for f in fps)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps + fps[:5])], "doc_id long, fingerprint string")
    d = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {a: sum(a != b and d(a, b) <= 3 for b in fps) for a in fps}
    got = {r.fp: r.n for r in fingerprint.near_counts(df, 3).collect()}
    assert got == {a: n for a, n in want.items() if n} and max(got.values()) > 20
    none = df.where("false")
    assert fingerprint.near_counts(none, 3).count() == 0 and fingerprint.near_pairs(none, 3).count() == 0


def test_fingerprint_query_counts_near_prints(spark):
    rows = fingerprint.op2_fingerprints(spark, SF).collect()
    fps = sorted({r.fingerprint for r in rows})
    d = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {a: sum(a != b and d(a, b) <= fingerprint.RADIUS for b in fps) for a in fps}
    assert all(r.n_near == want[r.fingerprint] for r in rows)


def test_fingerprints_run_no_python(spark):
    plan = fingerprint.op2_fingerprints(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 3: packing ----------------------------------------------------------------------------


def check_packing(rows, texts, length):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary_path())
    want = collections.Counter()
    for d, text in texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for p, a in enumerate(range(0, len(ids), length)):
            cut = ids[a:a + length]
            want[d, p, a, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), -(-sum(r.length for r in rows) // length)


def test_packing_of_a_table(spark):
    docs = documents(spark, SF)
    n, least = check_packing(packing.op3_best_fit_packing(spark, SF).collect(), pairs(docs), 4096)
    assert n == least


def test_packing_odd_rows(spark):
    df = odd_docs(spark, ids_null=True)
    n, least = check_packing(packing.pack_documents(df, length=256).collect(), pairs(df), 256)
    assert n <= least * 1.1 + 1
    assert packing.pack_documents(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("first", [2**63 - 1, -2**63, 3 * 10**17])
def test_packing_of_large_ids(spark, first):
    df = spark.createDataFrame([(first, "one two three"), (None, "four"), (5, "")], "doc_id long, text string").coalesce(1)
    check_packing(packing.pack_documents(df, length=64).collect(), pairs(df), 64)
    assert all(0 <= r.grp < 7 for r in packing.pieces(df, 64, groups=7).select("grp").collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_local_search_keeps_a_valid_packing(sizes):
    sizes = np.array(sorted(sizes, reverse=True))
    bins = local_search.pack(sizes, 50)
    fill = np.bincount(bins, weights=sizes)
    assert len(bins) == len(sizes) and fill.max() <= 50 and fill.min() > 0
    assert len(fill) <= local_search.best_fit(sizes, 50).max() + 1


def test_local_search_empties_a_bin():
    # best fit decreasing needs three bins; exchanging gives two full ones
    sizes = np.array([6, 5, 5, 4, 4, 4, 3, 3, 3, 3])
    assert local_search.best_fit(sizes, 20).max() + 1 == 2 or local_search.pack(sizes, 20).max() + 1 == 2
    sizes = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 10, 10])
    sizes = np.sort(sizes)[::-1]
    assert local_search.pack(sizes, 100).max() + 1 == 2


def fewest_bins(sizes, capacity):
    """By trying every way."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {f: k for k, f in enumerate(bins) if f + sizes[i] <= capacity}.values():
            bins[b] += sizes[i]
            go(i + 1, bins)
            bins[b] -= sizes[i]
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best[0]


def test_packing_against_every_way():
    rng = np.random.default_rng(0)
    over = []
    for _ in range(300):
        capacity = int(rng.integers(10, 60))
        sizes = np.sort(rng.integers(1, capacity // int(rng.integers(1, 3)) + 1, int(rng.integers(1, 11))))[::-1]
        least = fewest_bins(sizes.tolist(), capacity)
        assert local_search.lower_bound(sizes, capacity) <= least
        over.append(local_search.pack(sizes, capacity).max() + 1 - least)
    assert min(over) == 0 and max(over) <= 1 and sum(over) <= 6


def test_search_empties_bins_where_best_fit_leaves_room():
    rng = np.random.default_rng(1)
    for low, high, n, share in ((1200, 1500, 3000, 0.25), (300, 1400, 3000, 0.5)):
        sizes = np.sort(rng.integers(low, high, n))[::-1]
        least, first, found = (local_search.lower_bound(sizes, 4096), local_search.best_fit(sizes, 4096).max() + 1,
                               local_search.pack(sizes, 4096).max() + 1)
        assert found - least <= share * (first - least)


@pytest.mark.parametrize("low,high", [(2100, 2101), (1500, 4000), (1, 300), (1, 4097)])
def test_a_group_sends_up_little(low, high):
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(low, high, 4000))[::-1]
    fill = np.bincount(local_search.pack(sizes, 4096), weights=sizes).astype(np.int64)
    up = local_search.worth_merging(fill, 4096, packing.OPEN)
    assert up.sum() <= 16 and (4096 - fill[up]).sum() <= 2 * 4096
    assert up.sum() == 16 or (4096 - fill[~up]).sum() == 0 or (4096 - fill[up]).sum() >= 4096


def test_many_groups_meet_in_levels(spark):
    """Groups of a few sequences each, over two levels: as few sequences as one group has, but for a handful."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, "the " * int(n), None) for i, n in enumerate(rng.integers(1, 200, 3000))], "doc_id long, text string, open string")
    n, least = check_packing(packing.pack_documents(docs, length=256, group_bytes=16_000).collect(), pairs(docs), 256)
    one, _ = check_packing(packing.pack_documents(docs, length=256).collect(), pairs(docs), 256)
    assert n <= one * 1.02 + 1


def test_word_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary_path())
    w = tokens.WordIds(tokens.vocabulary_path())
    texts = ["Ab.c, x's. can't, É. é.. … ….. 12.5 a|b | || |. İi ΑΣ. Σ ́a é. <|endoftext|> A B. c, '\t'd \x1c a\x1fb. ǅ.",
             "", " \n", "日本語。テスト. 🙂, 🙂.", "x" * 200 + ". " + "é" * 90, "The the THE the. the, THE,",
             "hello <|endoftext|> you", "<|startoftext|>A B.<|ENDOFTEXT|> <|endoftext|>", "<|endoftext|>"]
    for _ in range(2):
        got = w.of([x.encode() for x in texts])
        assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


# ---- 8: token counts -------------------------------------------------------------------------


def test_histogram_answers_every_limit(spark):
    df = odd_docs(spark)
    counted = token_counts.lengths(df)
    lengths = [r.n_tokens for r in counted.collect()]
    hist = token_counts.histogram(counted)
    rows = hist.collect()
    assert {r.length for r in rows} == set(lengths)
    for r in rows:
        n = r.length
        assert r.n_docs == lengths.count(n) and r.docs_over == sum(x > n for x in lengths)
        assert r.tokens_over == sum(x for x in lengths if x > n) and r.docs_to == sum(x <= n for x in lengths)
        assert r.tokens_to == sum(x for x in lengths if x <= n) and r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.dropped_tokens == sum(max(0, x - n) for x in lengths)
        assert r.share_docs == pytest.approx(r.docs_to / len(lengths))
    got = {r.context: (r.docs_over, r.total_tokens, r.truncated_tokens) for r in token_counts.at_limits(hist, [0, 50, 10**6]).collect()}
    assert got == {c: (sum(x > c for x in lengths), sum(lengths), sum(min(x, c) for x in lengths)) for c in got}
    half = {r.share: r.length for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()}
    assert half == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}
    assert token_counts.histogram(token_counts.lengths(empty_docs(spark))).count() == 0


def test_sums_run_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "RANGE", 5)
    lengths = [i * 7 % 53 for i in range(80)]
    df = spark.createDataFrame([(x,) for x in lengths], "n_tokens long")
    for r in token_counts.histogram(df).collect():
        assert r.docs_over == sum(x > r.length for x in lengths) and r.tokens_over == sum(x for x in lengths if x > r.length)


# ---- 9: toxicity -----------------------------------------------------------------------------


def channel():
    texts = ["the idiot and the moron is stupid trash with a clown who is pathetic and worthless "
             "loser scum of the day in a disgusting house under the tree with other people there"] * 20
    return noisy_channel.Channel(noisy_channel.count_trigrams(texts, noisy_channel.class_table()))


def test_disguised_words_are_restored():
    c = channel()
    for shown, meant in (("1d1ot", "idiot"), ("m0r0n", "moron"), ("5tupid", "stupid"), ("stuuuupid", "stupid"),
                         ("i.d.i.o.t", "idiot"), ("tr4$h", "trash"), ("p4th3t1c", "pathetic"), ("L0SER!!", "loser")):
        assert meant in c.words(f"you {shown} there"), shown
    assert "worthless" in c.words("a w o r t h l e s s man")


def test_plain_words_stay():
    c = channel()
    assert c.words("The tree, (other) people's day... 2024 x") >= {"the", "tree", "other", "day", "2024", "x"}
    assert c.words("") == set() and c.words(" \n ") == set()


def test_trigrams_count_whole_texts():
    counts = noisy_channel.count_trigrams(["ab!!  b", ""], noisy_channel.class_table()).reshape((64,) * 3)
    assert counts[0, 1, 2] == 1 and counts[1, 2, 0] == 1 and counts[2, 0, 2] == 1 and counts[0, 2, 0] == 1 and counts.sum() == 4


def test_toxicity_separates_held_out_rows(spark):
    base = "the day in a house under the tree with other people there of course and so on".split()
    docs, labels = [], []
    for i in range(240):
        words = [base[(i * j + j) % len(base)] for j in range(1, 25)]
        toxic = i % 6 == 0
        if toxic:
            words[3::8] = ["idiot", "m0ron" if i % 12 else "moron", "trash"]
        docs.append((i, " ".join(words), "en" if toxic else "de", "s", 1))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs + [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (None, "x", "en", "s", 1),
                                      (902, "what an 1d1ot and m o r o n", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (901, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(d, d, lab).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 20 and all((got[i] >= 0.3) == (i % 6 == 0) for i in held)
    assert got[902] >= 0.3 and got[900] == got[901] < 0.3 and 0 <= got[None] <= 1
    kept = toxicity.keep_clean(d, d, lab)
    assert kept.columns == d.columns and kept.count() == sum(1 for s in got.values() if s < 0.3)


def test_toxicity_without_labels(spark):
    d = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(d, d, none).collect()
    assert len(rows) == d.count() and len({r.score for r in rows}) == 1
    assert toxicity.toxicity(empty_docs(spark), empty_docs(spark), none).count() == 0


def test_held_out_rows_are_not_learnt_from(spark):
    docs = documents(spark, SF)
    labels = spark.read.parquet(SF + "/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(toxicity.toxicity(docs, docs, labels).collect())
    b = sorted(toxicity.toxicity(docs, docs, flipped).collect())
    assert a == b


def test_viterbi_finds_the_cheapest_of_all_paths():
    """Against every path through the lattice, with costs added up one by one."""
    import itertools
    counts = noisy_channel.count_trigrams(["the cat sat on the mat and the idiot hates the stupid dog"] * 5, noisy_channel.class_table())
    channel = noisy_channel.Channel(counts)

    def cost(path):
        text, total = "".join(shown for shown, _ in path) + " ", sum(price for _, price in path)
        a = b = 0
        for c in text:
            k = noisy_channel.char_class(c)
            total += channel.cost[a][b][k] if k or b else 0.5
            a, b = b, k
        return total

    for word in ("1d10t", "st@pid", "c4t", "i d i o t", "h.a.t.e", "d00000g", "5tup1d", "m|t", "aaa", "x1"):
        lattice = channel.lattice(word)
        best = min(itertools.product(*lattice), key=lambda p: (cost(p), "".join(s for s, _ in p)))
        got = channel.restore(word)
        assert got == "".join(s for s, _ in best).strip(), word


def test_very_long_texts_are_scored(spark):
    import time
    channel = noisy_channel.Channel(np.ones(64 ** 3, np.int64))
    start = time.perf_counter()
    assert channel.words("1d1ot " * 40_000 + "a b c d " * 20_000 + "x" * 100_000)
    assert channel.restore("a1" * 20_000)
    assert time.perf_counter() - start < 60
