"""State tables of the ingest, indexed by a hash of their key.

A table is a folder ``<table>/batch=<id>/part=<prefix>/`` of Parquet files. ``part`` is the first hex digits of a
64-bit hash of the row's key (message id, fingerprint, or card + merchant + amount). A batch that asks for some keys
reads only the folders whose prefix begins their hashes: the filter is on partition columns alone, so Spark prunes
the folders before it opens a file (:func:`read_state` with ``touched``).

Folders of different depth live side by side, because a key's hash begins with each of its prefixes. New batches
write with a small depth (few files); :func:`rewrite` folds old batches into one folder each, at a depth at which a
part holds no more than ``rows_per_part`` rows. So what a batch reads depends on the keys it brings and on the
batches since the last rewrite, not on the length of the history.

Only a folder that does not exist counts as empty state; any other failure to read stops the batch. ``upto`` keeps
batches with a smaller id, so a replayed batch never sees its own earlier output.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH = 1
DEEPEST = 4
ROWS_PER_PART = 200_000
#: With more touched parts than this a batch touches most of the table anyway, and no filter is made.
MOST_PARTS = 2048


def columns_of(ddl: str) -> list[str]:
    return [x.split(" ", 1)[0] for x in ddl.split(", ")]


def prefix(keys: Sequence[str | Column], depth: int) -> Column:
    """The first ``depth`` hex digits of the hash of a key."""
    return F.substring(F.lower(F.lpad(F.hex(F.xxhash64(*keys)), 16, "0")), 1, depth)


def touched_parts(rows: DataFrame, keys: Sequence[str | Column]) -> list[str] | None:
    """Parts, of any depth, in which keys of these rows may lie; None if there are too many to list.

    At most ``MOST_PARTS`` prefixes reach the driver.
    """
    deep = rows.select(prefix(keys, DEEPEST).alias("p")).distinct().limit(MOST_PARTS + 1).collect()
    if len(deep) > MOST_PARTS:
        return None
    return sorted({r.p[:n] for r in deep for n in range(1, DEEPEST + 1)})


def read_state(spark: SparkSession, path: str, ddl: str, upto: int | None = None, since: int | None = None,
               with_batch: bool = False, touched: list[str] | None = None) -> DataFrame:
    """A state table, or an empty one if it does not exist."""
    columns = columns_of(ddl) + ["batch"] * with_batch
    try:
        df = spark.read.schema(f"{ddl}, batch bigint, part string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{ddl}, batch bigint").select(*columns)
    if upto is not None:
        df = df.filter(F.col("batch") < F.lit(upto))
    if since is not None:
        df = df.filter(F.col("batch") >= F.lit(since))
    if touched is not None:
        df = df.filter(F.col("part").isin(touched))
    return df.select(*columns)


def write_state(df: DataFrame, path: str, ddl: str, batch_id: int, keys: Sequence[str | Column], depth: int = DEPTH,
                observed: tuple | None = None) -> None:
    """Write a batch's rows of one table, whatever an earlier try of this batch has left there.

    Rows of a part meet before they are written, so that a part is a file or few; a crowded part is split by AQE.
    ``observed``: an Observation and the metrics that this very write fills.
    """
    rows = df.withColumn("part", prefix(keys, depth)).hint("rebalance", "part")
    if observed is not None:
        rows = rows.observe(observed[0], *observed[1])
    rows = rows.select(*columns_of(ddl), "part")
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={batch_id}")


def depth_for(rows: int, rows_per_part: int = ROWS_PER_PART) -> int:
    """The least depth at which evenly spread rows keep to ``rows_per_part``."""
    depth = 1
    while depth < DEEPEST and rows > rows_per_part * 16 ** depth:
        depth += 1
    return depth


def rewrite(df: DataFrame, path: str, ddl: str, batch_id: int, keys: Sequence[str | Column], rows_per_part: int = ROWS_PER_PART) -> None:
    """Write a whole table as one batch, as deep as its size asks for."""
    write_state(df, path, ddl, batch_id, keys, depth_for(df.count(), rows_per_part))
