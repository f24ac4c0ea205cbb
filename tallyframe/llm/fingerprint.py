"""Operator 2, document fingerprints [native]: SimHash, and permuted block tables to search it.

A document's terms are its word shingles; a term's weight is how often it stands in the document. Every
term votes with its weight on ``64 * SEEDS`` signed bits, by the bits of its hashes, and the signs of the
sums are the fingerprint. Votes are counted without Python and without a row for each bit: a hash is
shifted and masked into 16 words of four 16-bit lanes each, so that one long addition counts four bits;
lanes cannot overflow, as a document is counted in runs of ``RUN`` terms before lanes are taken apart.

Search (:func:`near_counts`, :func:`near_pairs`): fingerprints within ``radius`` bits of each other agree in all
but ``radius`` of n blocks, so there is a table for each choice of agreeing blocks, with these blocks moved to the
front as its key; equal keys meet and are verified by the whole distance. n grows with the number of distinct
fingerprints, so that keys stay nearly unique. A key that many share, as a large family of near copies does, is cut
into parts of about ``CAP`` fingerprints, packed in arrays; each fingerprint meets each part of its key, and what it
finds there is counted inside the array, in the first table only in which a pair agrees. So nothing is sent for a
pair that is not within the radius, and for counts nothing for any pair.

Defined cases: null, empty and blank texts have no terms and the fingerprint of zeros; fewer words than
a shingle are one term; equal texts have equal fingerprints, whatever the id. A null id comes after all ids; rows
equal in id and text are one row in the order of documents but as many in the result, each with the same next
document; rows that share an id but not the text follow each other by the hash of the text. A single document is its
own next. An empty table gives no rows. Other columns are not looked at.
"""
from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fence import fence
from .common import documents, id_text, saved

SHINGLE = 3
SEEDS = 2
RUN = 32767
LANES = 0x0001000100010001
SPLITS = 256
RADIUS = 4
CAP = 256


def _terms(rows: DataFrame, key: str, text_col: str, shingle: int) -> DataFrame:
    """(key, copy, terms): hashes of the words of each shingle, one field for each place in it. Words and their
    hashes are fenced, so that they are made once and not anew for each place."""
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.select(key, F.monotonically_increasing_id().alias("copy"), words.alias("words"))
    rows = fence(rows).where(F.size("words") > 0)
    whole = F.array_repeat(F.xxhash64(F.array_join("words", " ")), shingle)
    hashes = F.when(F.size("words") < shingle, whole).otherwise(F.transform("words", lambda w: F.xxhash64(w)))
    rows = fence(rows.select(key, "copy", hashes.alias("hashes")))
    count = F.size("hashes") - (shingle - 1)
    return rows.select(key, "copy", F.arrays_zip(*[F.slice("hashes", i + 1, count).alias(f"h{i}") for i in range(shingle)]).alias("terms"))


def simhash(rows: DataFrame, key: str, text_col: str, out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """(key, out) of every key whose text has words: the fingerprint in lower-case hexadecimal digits.
    Rows that share a key have one text; ``copy`` counts them apart, so that lanes cannot overflow, and
    their votes scale together.
    """
    terms = _terms(rows, key, text_col, shingle).select(key, "copy", F.posexplode("terms").alias("at", "term"))
    names = [f"h{i}" for i in range(shingle)]
    hashes = [F.xxhash64(F.lit(seed), *[F.col(f"term.{n}") for n in names]).alias(f"x{seed}") for seed in range(SEEDS)]
    terms = terms.select(key, "copy", F.floor(F.col("at") / RUN).cast("int").alias("run"), *hashes)
    lanes = {f"l{seed}_{j}": F.sum(F.shiftrightunsigned(f"x{seed}", j).bitwiseAND(F.lit(LANES)))
             for seed in range(SEEDS) for j in range(16)}
    runs = terms.groupBy(key, "copy", "run").agg(F.count(F.lit(1)).alias("n"), *[c.alias(n) for n, c in lanes.items()])
    bit = lambda seed, b: F.shiftrightunsigned(f"l{seed}_{b % 16}", 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF))
    longs = []
    one = runs.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(bit(s, b)).alias(f"b{s}_{b}")
                                                      for s in range(SEEDS) for b in range(64)])
    for s in range(SEEDS):
        on = [F.when(2 * F.col(f"b{s}_{b}") > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long"))
              .otherwise(F.lit(0).cast("long")) for b in range(64)]
        longs.append(reduce(lambda x, y: x.bitwiseOR(y), on))
    text = F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in longs])
    return one.select(key, text.alias(out))


def known(fp: Column) -> Column:
    """A fingerprint, or that of a text without words."""
    return F.coalesce(fp, F.lit("0" * 16 * SEEDS))


def _word(fp: Column, i: int) -> Column:
    """A 64-bit word of a fingerprint, from its hexadecimal digits."""
    part = lambda a: F.conv(F.substring(fp, 16 * i + a, 8), 16, 10).cast("long")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return reduce(lambda x, y: x + y, [F.bit_count(_word(a, i).bitwiseXOR(_word(b, i))) for i in range(SEEDS)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - distance(a, b) / F.lit(64.0 * SEEDS)


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _mask(first: int, last: int) -> tuple[int, int]:
    """The bits first .. last - 1 of a fingerprint, counted from its front, as two signed words."""
    bits = sum(1 << (64 * SEEDS - 1 - i) for i in range(first, last))
    return _signed(bits >> 64), _signed(bits & ((1 << 64) - 1))


def _met(prints: DataFrame, radius: int, fp_col: str) -> DataFrame:
    """(w0, w1, near): for each fingerprint, as two words, and each part of a key of one of its tables, the array of those
    others in the part that are within the radius and agree in no earlier table."""
    distinct = prints.select(*[_word(F.col(fp_col), i).alias(f"w{i}") for i in range(SEEDS)]).distinct()
    width = 64 * SEEDS
    need = max(8, distinct.count().bit_length() + 4)
    n = next((n for n in range(radius + 1, width + 1) if (n - radius) * (width // n) >= need), width)
    edges = [width * i // n for i in range(n + 1)]
    choices = list(combinations(range(n), n - radius))
    masks = lambda of: F.array(*[F.struct(F.lit(a).cast("long").alias("m0"), F.lit(b).cast("long").alias("m1")) for a, b in of]) \
        if of else F.array().cast("array<struct<m0:bigint,m1:bigint>>")
    block = [_mask(edges[j], edges[j + 1]) for j in range(n)]
    chosen = F.array(*[masks([block[j] for j in c]) for c in choices])
    # a pair agrees in an earlier table if it agrees in a block that this one passes over
    passed = F.array(*[masks([block[j] for j in range(c[-1] if c else 0) if j not in c]) for c in choices])
    # the blocks of a choice, moved to the front: a hash of their bits is the table's key
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[x for j in c for x in (
        F.col("w0").bitwiseAND(F.lit(block[j][0]).cast("long")), F.col("w1").bitwiseAND(F.lit(block[j][1]).cast("long")))]).alias("key"))
        for t, c in enumerate(choices)]
    tables = distinct.select("w0", "w1", F.inline(F.array(*keys)))
    shared = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tables = tables.join(shared.select("t", "key", F.ceil(F.col("n") / CAP).cast("int").alias("parts")), ["t", "key"])
    own = F.pmod(F.xxhash64("w0", "w1"), "parts").cast("int")
    parts = tables.groupBy("t", "key", own.alias("part")).agg(F.collect_list(F.struct("w0", "w1")).alias("others"))
    asked = tables.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def close(o: Column) -> Column:
        x0, x1 = F.col("w0").bitwiseXOR(o["w0"]), F.col("w1").bitwiseXOR(o["w1"])
        bits = F.bit_count(x0) + F.bit_count(x1)
        differs = lambda m: (x0.bitwiseAND(m["m0"]) != 0) | (x1.bitwiseAND(m["m1"]) != 0)
        return (bits > 0) & (bits <= radius) & ~F.exists(F.get(chosen, F.col("t")), differs) & F.forall(F.get(passed, F.col("t")), differs)

    return asked.join(parts, ["t", "key", "part"]).select("w0", "w1", F.filter("others", close).alias("near"))


def _digits(w0: Column, w1: Column) -> Column:
    """A fingerprint from its words."""
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in (w0, w1)])


def near_pairs(prints: DataFrame, radius: int, fp_col: str = "fingerprint") -> DataFrame:
    """(a, b, bits): all pairs a < b of distinct fingerprints that differ in up to ``radius`` bits."""
    met = _met(prints, radius, fp_col).select("w0", "w1", F.explode("near").alias("o"))
    met = met.select(_digits(F.col("w0"), F.col("w1")).alias("a"), _digits(F.col("o.w0"), F.col("o.w1")).alias("b")).where("a < b")
    return met.withColumn("bits", distance(F.col("a"), F.col("b")))


def near_counts(prints: DataFrame, radius: int, fp_col: str = "fingerprint") -> DataFrame:
    """(fp, n): for every distinct fingerprint that has any, how many others differ in up to ``radius`` bits."""
    found = _met(prints, radius, fp_col).select("w0", "w1", F.size("near").alias("n")).where("n > 0")
    return found.groupBy("w0", "w1").agg(F.sum("n").alias("n")).select(_digits(F.col("w0"), F.col("w1")).alias("fp"), "n")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, n_chars, fingerprint) of every document; row stands for the id and text together."""
    rows = keyed(docs, id_col, text_col)
    prints = simhash(rows, "row", "text", "fingerprint", shingle)
    return rows.select("doc_id", "row", "n_chars").join(prints, "row", "left").withColumn(
        "fingerprint", known(F.col("fingerprint")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5("text"))
    return rows.select(row.alias("row"), "doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))


def with_next(ids: DataFrame) -> DataFrame:
    """Each of the distinct (doc_id, n_chars, row) with the row that follows it by id, the last with the first.

    Ids are cut at approximate quantiles, so ranges are equally full however ids are spread; the next of a
    range's last row is the first row of the next range that has rows.
    """
    shares = ", ".join(str(i / SPLITS) for i in range(1, SPLITS))
    cuts = ids.agg(F.expr(f"array_distinct(percentile_approx(doc_id, array({shares}), 10000))").alias("c")).first()[0] or []
    value = lambda c: F.coalesce(c, F.lit(2**63 - 1))
    part = F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), lambda c: c <= value(F.col("doc_id")))) \
        if cuts else F.lit(0)
    rows = ids.withColumn("part", part)
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_last("doc_id"), "row")
    following = F.lead("row").over(inside)
    rows = rows.select("*", following.alias("next"), F.row_number().over(inside).alias("rank"))
    heads = rows.where("rank = 1").select("part", F.col("row").alias("head"))
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(
        F.lead("head").over(order),
        F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return rows.join(heads, "part").select("doc_id", "n_chars", "row", F.coalesce("next", "after").alias("next"))


def edited_texts(texts: DataFrame, order: DataFrame) -> DataFrame:
    """(row, edited): the last half of each text replaced by as much of the start of the next document's.

    ``texts`` is (row, text), dealt by row; from there a prefix goes to the row before it.
    """
    give = order.select(F.col("next").alias("donor"), F.col("row").alias("receiver"),
                        F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    donated = texts.join(give, F.col("row") == F.col("donor")).select(
        "receiver", F.expr("substring(text, 1, half)").alias("prefix"))
    own = F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)")
    return texts.join(donated, F.col("row") == F.col("receiver")).select("row", F.concat(own, "prefix").alias("edited"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(documents(spark, sf_dir))
    order = saved(with_next(rows.select("doc_id", "n_chars", "row").distinct()))
    prints = saved(simhash(rows, "row", "text"))
    # one exchange of texts by row, the same for all that reads it, so that it is made once
    same = Window.partitionBy("row").orderBy("row")
    once = rows.select("row", "text", F.lag(F.lit(1)).over(same).alias("again")).where("again IS NULL").drop("again")
    edited = edited_texts(once, order)
    edited_prints = simhash(edited, "row", "edited", "edited_fingerprint")
    digests = edited.select("row", F.sha2("edited", 256).alias("edited_sha256"))
    next_prints = prints.select(F.col("row").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    out = rows.select("row", "doc_id", "n_chars").join(order.select("row", "next"), "row")
    out = out.join(digests, "row").join(prints, "row", "left").join(edited_prints, "row", "left").join(next_prints, "next", "left")
    blank = order.join(prints, "row", "left_anti").limit(1).select(F.lit("0" * 16 * SEEDS).alias("fingerprint"))
    near = near_counts(prints.select("fingerprint").unionByName(blank), RADIUS)
    near = saved(near)  # few rows, one for each fingerprint that has others near it
    out = out.join(near.withColumnsRenamed({"fp": "of", "n": "n_near"}), known(F.col("fingerprint")) == F.col("of"), "left")
    a, b, c = (known(F.col(x)) for x in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return out.select("doc_id", "n_chars", "edited_sha256", a.alias("fingerprint"), b.alias("edited_fingerprint"),
                      likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
