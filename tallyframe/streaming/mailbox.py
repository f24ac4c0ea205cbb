"""A mailbox as a streaming source whose offset is the largest UID (R2, A2).

The raw-mail table grows at its end: UIDs only rise. The source asks for the mails above the last UID, as the polled
mailbox does; the offset that Spark writes to the checkpoint is that UID, so a restart goes on after the last
committed batch and reads nothing twice, whatever the files look like (one file may hold many batches, and be
rewritten by a compaction, without a mail being seen again).

Register and use it::

    register_mailbox(spark)
    spark.readStream.format("mailbox").option("path", folder).load()

Options: ``path`` (a folder of Parquet files in the raw-mail schema, on any file system that pyarrow opens: a local
or mounted path, or a URI such as hdfs:// or s3://), ``start_uid`` (mails above it; 0 by default) and ``split_uids``
(UIDs that one task spans; 100,000). A batch is cut into tasks by UID range, and each task reads only the row groups
whose statistics meet its range. The largest UID is read from the files' footers.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MAIL_DDL = "uid long, msg_id string, received timestamp_ntz, sender string, subject string, html string, text string"
#: Mails that a task holds at a time.
BATCH_ROWS = 8192


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return MAIL_DDL

    def streamReader(self, schema: StructType) -> "MailboxReader":
        return MailboxReader(dict(self.options))


class MailboxReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = int(options.get("start_uid", 0))
        self.split = int(options.get("split_uids", 100_000))

    def _files(self):
        import pyarrow.dataset as ds
        from pyarrow import fs
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        return ds.dataset(path, format="parquet", filesystem=system, exclude_invalid_files=False,
                          ignore_prefixes=["_", "."])

    def initialOffset(self) -> dict:
        return {"uid": self.start}

    def latestOffset(self) -> dict:
        """The largest UID that the files' statistics name."""
        files, largest = self._files(), self.start
        for fragment in (files.get_fragments() if files is not None else ()):
            for group in fragment.row_groups:
                seen = (group.statistics or {}).get("uid") or {}
                largest = max(largest, int(seen.get("max") or 0))
        return {"uid": largest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = int(start["uid"]), int(end["uid"])
        return [InputPartition((a, min(a + self.split, upto))) for a in range(after, upto, self.split)]

    def read(self, partition: InputPartition) -> Iterator:
        """Mails of one range of UIDs: above its first number, up to its second."""
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import parquet
        files = self._files()
        if files is None:
            return
        after, upto = partition.value
        names = [c.split()[0] for c in MAIL_DDL.split(", ")]
        types = {"uid": pa.int64(), "received": pa.timestamp("us")}
        for fragment in files.get_fragments():
            groups = [g.id for g in fragment.row_groups if self._meets(g.statistics, after, upto)]
            if not groups:
                continue
            # pages are decoded as they are asked for: neither a row group nor batches read ahead stand in memory
            with fragment.filesystem.open_input_file(fragment.path) as f:
                file = parquet.ParquetFile(f, metadata=fragment.metadata, buffer_size=1 << 20, pre_buffer=False)
                there = [n for n in names if n in file.schema_arrow.names]
                for batch in file.iter_batches(BATCH_ROWS, groups, there, use_threads=False):
                    uid = batch.column("uid")
                    batch = batch.filter(pc.and_(pc.greater(uid, after), pc.less_equal(uid, upto)))
                    if len(batch):
                        yield pa.RecordBatch.from_arrays([
                            (batch.column(n) if n in there else pa.nulls(len(batch))).cast(types.get(n, pa.string())) for n in names], names=names)

    @staticmethod
    def _meets(statistics: dict | None, after: int, upto: int) -> bool:
        """Whether a row group may hold UIDs of the range; without statistics it may."""
        seen = (statistics or {}).get("uid")
        return not seen or (seen["max"] > after and seen["min"] <= upto)

    def commit(self, end: dict) -> None:
        """Nothing to release: the table is the mailbox's own."""


def register_mailbox(spark: SparkSession) -> None:
    """Makes the format "mailbox" known to the session. The source goes to the workers that plan and read it with its
    code, as those on the driver do not see shipped packages."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Mailbox)
