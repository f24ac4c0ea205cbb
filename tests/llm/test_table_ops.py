"""Operators 4, 6 and 7 against DuckDB and brute force, with odd rows; the pipeline's stages."""
import datetime as dt
import os

import duckdb
import numpy as np
import pytest
from llm_fixtures import SF, empty_docs, odd_docs, pairs
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tallyframe.llm import mixing, registry, simhash_dedup, suffix_dedup, topk_search, toxicity, url_filter
from tallyframe.llm.common import documents
from tallyframe.sources.tables import DRIVER_TABLES, table_path


def compare(spark, name, sf):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    df = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, round(v, 6) if isinstance(v, float) else v) for v in r)
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, cur.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_agree_with_sql(spark, name):
    compare(spark, name, SF)


def test_entry_has_all():
    numbers = {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert numbers == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert set(registry.SQL) <= set(registry.QUERIES)


# ---- 4 -----------------------------------------------------------------------------------


def brute_top_k(rows, k, every):
    out = []
    for q, v in rows:
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_with_ties_and_odd_vectors(spark, block):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 1024]) for i in range(120)]
    vectors += [(200 + i, vectors[5][1]) for i in range(25)]  # many equal vectors
    vectors += [(300, [0.0] * 5), (301, [0.5] * 4), (310, [0.25] * 4)]
    odd = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 5), (404, [float("inf")] * 5),
           (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in vectors + odd], "vec_id long, embedding array<float>, dims int, cb int")
    rows = topk_search.integers(df)
    got = sorted(map(tuple, topk_search.top_k(rows.where("vec_id % 10 = 0"), rows, 4, block).collect()))
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors]
    assert got == brute_top_k(whole, 4, 10)
    assert topk_search.top_k(rows.where("false"), rows.where("false")).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Rows that repeat an id ask each; the id's answer is the best of all of them, in any order of rows."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [5.0, 0.0]), (2, [0.0, 7.0]), (2, [0.0, 7.0]), (3, [1.0, 1.0])]
    want = [(100, 1, 2, 7 << 20), (100, 2, 2, 7 << 20), (100, 3, 1, 5 << 20)]
    for order in (rows, rows[::-1]):
        df = topk_search.integers(spark.createDataFrame(order, "vec_id long, embedding array<double>"))
        assert sorted(map(tuple, topk_search.top_k(df.where("vec_id = 100"), df, 3).collect())) == want
    many = spark.createDataFrame(rows + [(9, [3.0, 0.0])] * 500, "vec_id long, embedding array<double>")
    df = topk_search.integers(many)
    got = sorted(map(tuple, topk_search.top_k(df.where("vec_id = 100"), df, 6, 8).collect()))
    assert [r[2:] for r in got] == [(2, 7 << 20), (2, 7 << 20), (1, 5 << 20), (9, 3 << 20), (9, 3 << 20), (9, 3 << 20)]


def test_top_k_of_huge_components(spark):
    big = 2.0 ** 50
    rows = [(100, [big, -big]), (1, [2.0, 2.0 - 2 ** -10]), (2, [big, big]), (3, [0.0, 1.0])]
    df = topk_search.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r)[2:] for r in topk_search.top_k(df.where("vec_id = 100"), df, 2).collect()]
    assert got == [(1, 1 << 60), (2, 0)]
    df = topk_search.integers(spark.createDataFrame(rows[:1] + [(5, [big, -big])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(df, df).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk_search.integers(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_top_k_of_empty_tables(spark):
    df = topk_search.integers(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert topk_search.top_k(df, df).count() == 0


def test_search_stops_early():
    rng = np.random.default_rng(0)
    vectors = np.zeros((4000, 6), np.int64)
    vectors[:, 0] = rng.permutation(4000)
    lists = topk_search.SortedLists(np.arange(4000), vectors)
    met = []
    taken = np.unique
    np.unique = lambda *a, **k: met.append(1) or taken(*a, **k)
    try:
        best = lists.best(-1, np.array([3, 0, 0, 0, 0, 0]), 5)
    finally:
        np.unique = taken
    assert [s for s, _ in best] == [3 * x for x in (3999, 3998, 3997, 3996, 3995)] and len(met) <= 2


# ---- 6 -----------------------------------------------------------------------------------


def test_url_judgement(spark):
    d = dt.date
    entries = spark.createDataFrame([
        ("a", "bad.example.com", "block", d(2023, 1, 10)), ("a", "bad.example.com", "off", d(2023, 3, 1)),
        ("a", "bad.example.com", "block", d(2023, 6, 1)), ("b", "example.com", "block", d(2023, 2, 1)),
        ("b", "bad.example.com", "allow", d(2023, 6, 5)), ("p", "ok.example.com/x/y", "block", d(2023, 1, 1)),
        ("p", "ok.example.com", "allow", d(2023, 1, 1)), ("a", "two.example.org", "block", d(2023, 1, 1)),
        ("a", "two.example.org", "allow", d(2023, 1, 1))], "list string, key string, action string, day date")
    asked = [("http://www.BAD.example.com/q", d(2023, 1, 9), None, True), ("http://bad.example.com", d(2023, 1, 10), "block", False),
             ("http://bad.example.com:80/", d(2023, 2, 28), "block", False), ("http://bad.example.com./", d(2023, 3, 1), "block", False),
             ("http://bad.example.com", d(2023, 6, 2), "block", False), ("http://bad.example.com", d(2023, 6, 6), "allow", True),
             ("https://u:p@ok.example.com/x/y/z?q#f", d(2023, 5, 1), "block", False), ("https://ok.example.com/x/z", d(2023, 5, 1), "allow", True),
             ("ftp://two.example.org/", d(2023, 5, 1), "block", False), ("not a url", d(2023, 5, 1), None, True),
             (None, d(2023, 5, 1), None, True), ("http://bad.example.com", None, None, True)]
    captures = spark.createDataFrame([(i, u, f, "x") for i, (u, f, _, _) in enumerate(asked)],
                                     "capture_id long, url string, fetched date, key string")
    got = {r.capture_id: (r.action, r.keep) for r in url_filter.judge(captures.drop("key"), entries).collect()}
    assert got == {i: (a, k) for i, (_, _, a, k) in enumerate(asked)}
    assert url_filter.judge(captures.drop("key").where("false"), entries).count() == 0
    assert url_filter.judge(captures.drop("key"), entries.where("false")).where("keep").count() == len(asked)


def test_url_keys_of_any_depth(spark):
    d = dt.date(2023, 1, 1)
    entries = spark.createDataFrame([
        ("p", "h.example.org/a/b/c/d", "block", d), ("p", "h.example.org/a/b", "allow", d), ("d", "example.com", "block", d),
        ("d", "d.e.example.com", "allow", d), ("d", "net", "block", d)], "list string, key string, action string, day date")
    asked = [("http://h.example.org/a/b/c/d/e", "h.example.org/a/b/c/d", False), ("http://h.example.org/a/b/c", "h.example.org/a/b", True),
             ("http://h.example.org/a//b/c/d", "h.example.org/a/b/c/d", False), ("http://h.example.org/a", None, True),
             ("http://a.b.c.x.y.z.example.com/q", "example.com", False), ("http://1.2.3.4.5.6.d.e.example.com", "d.e.example.com", True),
             ("http://example.com", "example.com", False), ("http://a.b.c.d.e.f.net", None, True), ("http://net/x/y/z", "net", False)]
    captures = spark.createDataFrame([(i, u, d) for i, (u, _, _) in enumerate(asked)], "capture_id long, url string, fetched date")
    got = {r.capture_id: (r.key, r.keep) for r in url_filter.judge(captures, entries).collect()}
    assert got == {i: (k, keep) for i, (_, k, keep) in enumerate(asked)}
    all_keys = captures.select(F.explode(url_filter.keys_of(F.col("url"))).alias("k")).select("k.key").distinct()
    assert {"a.b.c.x.y.z.example.com/q", "c.x.y.z.example.com", "example.com", "h.example.org/a/b/c/d/e"} <= {
        r.key for r in all_keys.collect()}


def test_native_operators_run_no_python(spark):
    for q in (url_filter.op6_url_filters, mixing.op7_mix_sources):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 7 -----------------------------------------------------------------------------------


def filled(sizes, weights, ratio, epochs):
    """Targets by the rule itself: stop what is above, share the excess again."""
    total, full = ratio * sum(sizes), [s == 0 for s in sizes]
    while True:
        rest = total - sum(epochs * s for s, f in zip(sizes, full) if f)
        live = sum(w for w, f in zip(weights, full) if not f)
        t = [epochs * s if f else rest * w / live for s, w, f in zip(sizes, weights, full)]
        over = [not f and x > epochs * s for x, s, f in zip(t, sizes, full)]
        if not any(over):
            return t
        full = [f or o for f, o in zip(full, over)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 500, 30, 0, 70], [5, 1, 1000, 3, 8, 13, 400], [7]])
def test_targets_fill_like_water(spark, sizes):
    rows = [(i, f"s{i}", n, f"ss{i}", "p", 0) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, s_key string, place string, tie long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_odd_rows(spark):
    df = odd_docs(spark, ids_null=True)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        size = sum(r.size for r in own)
        assert all(r.source_size == size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    assert all(r.taken <= 2 * r.size and r.taken == r.size * len(r.positions) for r in rows)
    assert all(0 <= p <= 1 for r in rows for p in r.positions)
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_positions_follow_the_schedule(spark):
    rows = [(i, "x y " * 5, "a") for i in range(300)] + [(1000 + i, "x y " * 5, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, weights=(1.0,), ratio=1.0, schedules=(((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0))))
    order = [(r.source, r.position) for r in mixing.in_training_order(mixed).collect()]
    assert [p for _, p in order] == sorted(p for _, p in order)
    early = [p for s, p in order if s == "a"]
    # share used up at time t: 2t - t*t for the falling line
    assert max(abs((2 * t - t * t) - (i + 0.5) / 300) for i, t in enumerate(early)) < 1e-9
    late = [p for s, p in order if s == "b"]
    area = lambda t: t if t <= 0.5 else 0.5 + (t - 0.5) + 2 * (t - 0.5) ** 2
    assert max(abs(area(t) / 1.5 - (i + 0.5) / 300) for i, t in enumerate(late)) < 1e-9


def test_url_filters_of_empty_tables(spark):
    captures = spark.createDataFrame([], "page_id long, url string")
    out = url_filter.judge(url_filter.page_captures(captures), url_filter.page_lists(captures))
    assert out.count() == 0


# ---- the pipeline --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs, out = documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, SF)
        df.write.parquet(f"{folder}/{name}")
        out.append((docs, spark.read.parquet(f"{folder}/{name}")))
        docs = out[-1][1]
    return out


def test_stage_columns(spark, stages):
    columns = documents(spark, SF).columns
    assert [s.columns for _, s in stages[:-1]] == [columns] * 4
    assert len(corpus_pipeline.STAGES) == 5


def test_toxic_documents_go(spark, stages):
    docs, kept = stages[0]
    scores = toxicity.toxicity(docs, docs, spark.read.parquet(SF + "/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.where("score < 0.3").collect()}


def test_one_of_each_group_stays(stages):
    docs, kept = stages[1]
    want = {c for _, _, c in simhash_dedup.brute_force(pairs(docs))}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    texts = dict(pairs(docs))
    assert all(r.text == texts[r.doc_id] for r in rows)


def test_repeats_are_cut(stages):
    docs, kept = stages[2]
    want = {d: (n, k) for d, n, k, _, _ in suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in pairs(docs)], 100)}
    got = {r.doc_id: r for r in kept.collect()}
    assert set(want) - set(got) == {d for d, (n, k) in want.items() if n and n == k}
    texts = dict(pairs(docs))
    for d, r in got.items():
        assert r.n_chars == len(r.text)
        if not want[d][1]:
            assert r.text == texts[d]
        else:
            assert len(r.text.encode()) <= want[d][0] - want[d][1]


def test_mix_repeats_whole_documents(stages):
    docs, mixed = stages[3]
    want = {r.doc_id: len(r.positions) for r in mixing.mix(docs).collect()}
    got = mixed.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {d: n for d, n in want.items() if n}
    texts = dict(pairs(docs))
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())


def test_all_is_packed(stages):
    from test_text_ops import check_packing
    docs, packed = stages[4]
    n, least = check_packing(packed.collect(), pairs(docs), 4096)
    assert n == least


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.select(F.sum("length")).first() == stages[-1][1].select(F.sum("length")).first()


def test_run_equals_brute_force_from_end_to_end(spark):
    """Every stage by its plain definition (the model's scores are the operator's own), over the whole table."""
    import zlib

    import pyarrow as pa
    from tokenizers import Tokenizer

    from tallyframe.llm import tokens
    docs = documents(spark, SF)
    clean = {r.doc_id for r in toxicity.toxicity(docs, docs, spark.read.parquet(SF + "/labels.parquet")).where("score < 0.3").collect()}
    rows = {r.doc_id: r.asDict() for r in docs.collect() if r.doc_id in clean}
    firsts = {c for _, _, c in simhash_dedup.brute_force([(d, r["text"]) for d, r in rows.items()])}
    rows = {d: r for d, r in rows.items() if d in firsts}
    left = [(d, (r["text"] or "").encode()) for d, r in rows.items()]
    first_at: dict = {}
    for d, t in left:
        for i in range(len(t) - 99):
            first_at[t[i:i + 100]] = min(first_at.get(t[i:i + 100], (d, i)), (d, i))
    for d, t in left:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if first_at[t[i:i + 100]] < (d, i):
                gone[i:i + 100] = b"\1" * 100
        text = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
        if any(gone) and not text:
            del rows[d]
        else:
            rows[d]["text"] = text
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(list(rows.values())))
    copies = {d: n for d, n in con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE_SQL})").fetchall()}
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    want = []
    for d, r in rows.items():
        ids = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want += [(d, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))] * copies[d]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used: dict = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 4096
    assert len(used) == -(-sum(r.length for r in got) // 4096)


def test_odd_documents_pass_all_stages(spark):
    clashing = odd_docs(spark).withColumns({c: F.lit("x") for c in ("n_removed", "spans", "n_spans", "n_bytes", "kept_text", "carried")})
    out = corpus_pipeline.cut_repeats(spark, clashing, SF)
    assert out.columns == clashing.columns and {r.carried for r in out.collect()} == {"x"}
    docs = odd_docs(spark, ids_null=True).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    empty = empty_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
