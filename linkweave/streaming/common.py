"""Batch folders: the results of micro-batches, one folder each, written again on a rerun."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StructField, StructType

DEFAULT_INTERVAL = "1000 milliseconds"
FOLD_EVERY = 16


def write_batch(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/batch={batch_id}")


def read_batches(
    spark: SparkSession, root: str, schema: StructType, first: int | None = None, below: int | None = None
) -> DataFrame:
    """Rows of the batch folders, with their ``batch``; from ``first`` up to, not including, ``below`` if given.

    A range names its folders, all of which must be there, so nothing else is listed or read.
    """
    with_batch = StructType([*schema.fields, StructField("batch", LongType())])
    reader = spark.read.schema(with_batch)
    if below is not None:
        folders = [f"{root}/batch={i}" for i in range(first or 0, below)]
        return reader.option("basePath", root).parquet(*folders) if folders else spark.createDataFrame([], with_batch)
    try:
        return reader.parquet(root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], with_batch)
        raise


@dataclass(frozen=True)
class KeptTable:
    """A table that micro-batches add to, one folder of additions each, folded into a base now and then.

    ``merge`` makes the table of all additions (with their ``batch``); it must not mind that some of
    them were merged before. So a reader needs one base and fewer than ``fold_every`` folders, however many
    batches there were.
    """

    root: str
    schema: StructType
    merge: Callable[[DataFrame], DataFrame]
    fold_every: int = FOLD_EVERY

    def add(self, df: DataFrame, batch_id: int) -> None:
        write_batch(df.select(*self.schema.fieldNames()), f"{self.root}/added", batch_id)

    def added(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What one batch added."""
        return read_batches(spark, f"{self.root}/added", self.schema, batch_id, batch_id + 1)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table as the batches before ``batch_id`` left it."""
        return self.merge(self._parts(spark, batch_id, (batch_id // self.fold_every) * self.fold_every))

    def fold(self, spark: SparkSession, batch_id: int, merge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write a new base after every ``fold_every``-th batch; to be called when the batch has added all it has."""
        if (batch_id + 1) % self.fold_every == 0:
            rows = self._parts(spark, batch_id + 1, batch_id + 1 - self.fold_every)
            folded = (merge or self.merge)(rows)
            write_batch(folded.select(*self.schema.fieldNames()), f"{self.root}/base", batch_id)

    def _parts(self, spark: SparkSession, below: int, folded: int) -> DataFrame:
        base = read_batches(spark, f"{self.root}/base", self.schema, folded - 1, folded) if folded else None
        rows = read_batches(spark, f"{self.root}/added", self.schema, folded, below)
        return rows if base is None else base.unionByName(rows)


def triggered(writer: DataStreamWriter, available_now: bool, interval: str) -> DataStreamWriter:
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)
