"""New change files of projects as a stream, listed and read by tasks.

Each micro-batch lists the projects anew, names and sizes only: every task lists the root, takes its share of the project
folders and looks into them. A file that came before is known by its path in a state store, which is spread over the executors
like any streaming state; only what is new is read. The driver sees neither names nor files.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from linkweave.sources.listing import CONTENTS, contents_of, is_hidden, listing_tasks

_FORMAT = "linkweave_change_files"


@dataclass
class _Share(InputPartition):
    """One of ``tasks`` shares of the project folders."""

    share: int


class ChangeFileSource(DataSource):
    """The change files that are there, at every poll. Options ``root`` and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return "chain_id bigint, folder string, inside string, size bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ChangeFileReader(self.options["root"], int(self.options["tasks"]))


class _ChangeFileReader(DataSourceStreamReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict) -> list[_Share]:
        return [_Share(k) for k in range(self.tasks)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        system, base = fs.FileSystem.from_uri(self.root)
        for project in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = project.base_name
            mine = zlib.crc32(name.encode()) % self.tasks == partition.share
            if not mine or project.type != fs.FileType.Directory or not (name.isascii() and name.isdecimal() and int(name) < 2**63):
                continue
            committed = f"{project.path}/committed"
            if system.get_file_info(committed).type != fs.FileType.Directory:
                continue
            for info in system.get_file_info(fs.FileSelector(committed)):
                file = info.base_name
                if info.type == fs.FileType.File and file.endswith(".sql") and not is_hidden(file):
                    yield int(name), f"{self.root.rstrip('/')}/{name}", f"committed/{file}", info.size


def stream_change_files(spark: SparkSession, root: str) -> DataFrame:
    """New committed files as they appear. Committed files never change, so that a
    modified file is not delivered again does no harm; edits are for stamps to find. Empty and hidden files are passed over."""
    spark.dataSource.register(ChangeFileSource)
    listed = spark.readStream.format(_FORMAT).option("root", root).option("tasks", listing_tasks(spark)).load()
    new = listed.dropDuplicates(["folder", "inside"]).where("size > 0")
    text = F.col("content").cast("string")
    return new.mapInArrow(contents_of, CONTENTS).select(
        "chain_id",
        F.element_at(F.split("inside", "/"), -1).alias("filename"),
        F.when(F.is_valid_utf8(text), text).alias("text"),
    )
