"""What several operators share: table access, word rules, shared-folder checkpoints, id order."""
from __future__ import annotations

import ctypes
import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.tables import read_table

WORD = "[^\\x20\\x09-\\x0D]+"
LAST_ID = np.iinfo(np.int64).max


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly (doc_id long, text string); other columns, whatever their names, are left out."""
    ship_package(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def saved(df: DataFrame) -> DataFrame:
    """The rows, kept in the shared checkpoint folder: computed once, and safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def n_blocks(nbytes: int, block_bytes: int, least: int = 48) -> int:
    """Blocks grow in number with the data, so that each keeps to ``block_bytes`` on average."""
    return max(least, math.ceil(nbytes / block_bytes))


def ids_of(table: pa.Table, name: str = "doc_id") -> np.ndarray:
    """Ids as int64 for ordering; a null id orders after all others."""
    return table.column(name).combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def blobs_of(table: pa.Table, name: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b or b"" for b in table.column(name).cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Returns memory that a task has freed to the system; a Python worker lives on after its task and would
    keep it. Where the C library has no such call nothing happens."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
