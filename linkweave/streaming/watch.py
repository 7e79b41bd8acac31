"""Files as they are made and edited: stamps polled by tasks, and only what differs comes through.

``stamps`` is a streaming source: each micro-batch holds the stamps (path, change time, size) of all files
below a table of roots at one moment. The table is dealt out by row groups; a task reads its roots and lists
them, so neither roots nor files are listed by the driver. Empty files have stamps like others; symbolic
links are not followed and have none. ``FileWatcher`` sends the stamps through change detection, so a file speaks
up when it is new or its stamp differs, once per distinct state, and reads it then.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from linkweave.session import scratch
from linkweave.sources.listing import file_stamps
from linkweave.streaming.common import DEFAULT_INTERVAL, FOLD_EVERY, read_batches, write_batch
from linkweave.streaming.detect import ChangeDetector

# The moment of the poll orders the stamps of a file.
STAMP_ROWS = "root string, path string, tick bigint, modified_ms bigint, size bigint"
_FILE_ROWS = "path string, tick bigint, modified_ms bigint, size bigint, content binary"
_FORMAT = "linkweave_stamps"


@dataclass
class _Roots(InputPartition):
    """A row group of the table of roots."""

    file: str
    group: int
    tick: int


class StampSource(DataSource):
    """Option ``roots``: a folder of Parquet files with a column ``root``."""

    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return STAMP_ROWS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StampReader(self.options["roots"])


class _StampReader(DataSourceStreamReader):
    def __init__(self, roots: str):
        self.roots = roots

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[_Roots]:
        system, base = fs.FileSystem.from_uri(self.roots)
        files = [i.path for i in system.get_file_info(fs.FileSelector(base)) if i.path.endswith(".parquet")]
        groups = [(f, g) for f in files for g in range(pq.ParquetFile(f, filesystem=system).num_row_groups)]
        return [_Roots(f, g, end["tick"]) for f, g in groups]

    def read(self, partition: _Roots) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.roots)
        table = pq.ParquetFile(partition.file, filesystem=system).read_row_group(partition.group, columns=["root"])
        for root in table.column("root").to_pylist():
            for path, modified, size in file_stamps(root):
                yield root, path, partition.tick, modified, size


def stream_stamps(spark: SparkSession, roots: str) -> DataFrame:
    """Stamps of all files below the roots in the Parquet table ``roots``, polled once per micro-batch."""
    spark.dataSource.register(StampSource)
    return spark.readStream.format(_FORMAT).option("roots", roots).load()


@dataclass
class FileWatcher:
    """Results below ``root``: ``files`` holds each file as it was when its stamp was new."""

    root: str
    roots: str
    fold_every: int = FOLD_EVERY

    def start(
        self, spark: SparkSession, checkpoint: str, available_now: bool = False, interval: str = DEFAULT_INTERVAL
    ) -> StreamingQuery:
        writer = stream_stamps(spark, self.roots).writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()

    @property
    def _detector(self) -> ChangeDetector:
        # Polls follow one another, so nothing is late and one stamp per file is kept.
        return ChangeDetector(f"{self.root}/stamps", ["path"], ["tick"], "state", "0", None, self.fold_every)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Take in the stamps of one poll; paths below several roots count once."""
        spark = batch.sparkSession
        state = F.concat_ws(":", F.col("modified_ms").cast("string"), F.col("size").cast("string"))
        stamps = batch.groupBy("path", "tick").agg(F.max("modified_ms").alias("modified_ms"), F.max("size").alias("size"))
        with scratch(spark):
            self._detector.process(stamps.withColumn("state", state), batch_id)
            stamp = StructType(StructType.fromDDL(_FILE_ROWS).fields[:-1])
            new = read_batches(spark, f"{self._detector.root}/points", stamp, batch_id, batch_id + 1).drop("batch")
            files = new.repartition("path").mapInPandas(_contents, _FILE_ROWS)
            write_batch(files, f"{self.root}/files", batch_id)

    def files(self, spark: SparkSession) -> DataFrame:
        """``path, tick, modified_ms, size, content`` of every state that was seen."""
        return read_batches(spark, f"{self.root}/files", StructType.fromDDL(_FILE_ROWS)).drop("batch")


def _contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of each path, null if it is gone by now; its next state will say so."""
    for frame in frames:
        for i in range(len(frame)):  # a file at a time, however large they are together
            one = frame.iloc[i:i + 1].copy()
            system, path = fs.FileSystem.from_uri(one["path"].iloc[0])
            try:
                with system.open_input_stream(path) as data:
                    one["content"] = [data.readall()]
            except FileNotFoundError:
                one["content"] = [None]
            yield one
