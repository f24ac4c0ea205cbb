"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""
import random

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, block long, fp long, rep long, "
              "score double, size long, place string, tie long, position double, length long, grp long")


def odd_docs(spark, n=40, seed=3, ids_null=False):
    """Documents with shared passages; columns beyond the first five clash with names the operators use."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("alpha", "be", "gam", "del", "é", "über") for b in ("x", "ya", "zed.", "Q,", "9")]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(70)) for _ in range(4)]
    rows = []
    for i in range(n):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        rows.append((i * 3, f"{own} {rng.choice(passages)}\t{own}" if i % 3 else own, "en", f"s{i % 3}" if i % 7 else None))
    rows += [(500, None, None, None), (501, "", "en", "s0"), (502, " \n\t ", "en", "s0"), (503, "one", "de", "s1"),
             (504, rows[1][1], "en", "s1"), (505, rows[1][1], "en", "s1"), (505, rows[1][1], "en", "s1"),
             (506, " ".join(passages) * 12, "en", "big"), (507, "ab " * 400, "en", "s2")]
    if ids_null:
        rows += [(None, rows[2][1], "en", "s0"), (None, "nothing else", "en", None)]
    rng.shuffle(rows)
    full = [(d, t, lg, s, None if t is None else len(t), 7, 7, 7, 0.5, 7, "p", 7, 0.1, 7, 7) for d, t, lg, s in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def pairs(df):
    """(doc_id, text) rows of a table."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
