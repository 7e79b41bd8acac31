"""Change detection on a stream of states: a key speaks up only when its state differs.

Rows may arrive in any order within ``lateness``. A late row can make a change, undo one or move it, so what a
micro-batch writes are signed points: those that are new count +1, those that no longer hold -1, and the
points so far are what is left of their sum. To find them, the rows of the touched keys that may still get a
neighbour are taken twice, once with and once without the rows of the batch, and the batch operator
finds the changes of both in one pass. It works block by block, so a hot key does not end up in one task.

Kept across batches are the rows within ``lateness`` of the latest time seen and the last one before
that of every key; they are folded into a base now and then, and keys that were silent for ``expiry`` longer
are forgotten. A keyed state-store operator was measured for this and was slower (README).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, LongType, StructField, StructType, TimestampNTZType

from linkweave.operators.snapshots import change_points
from linkweave.streaming.common import DEFAULT_INTERVAL, FOLD_EVERY, KeptTable, read_batches, triggered, write_batch


@dataclass
class ChangeDetector:
    """Results below ``root``: ``points`` holds signed changes, ``kept`` is its own.

    ``order`` are the columns that order the rows of a key, the first of them a time or number.
    ``lateness`` is what it may lag behind the latest one of earlier batches (an SQL expression like
    ``INTERVAL 2 HOURS`` or ``10``); rows farther behind are dropped and counted. Without it every row is
    taken, and all rows are kept. ``expiry`` is of the same kind: a key whose last row is older than both together counts as
    new again. Rows without a time come first and are never late. A row at a place of its key that an earlier batch
    has taken is dropped, so a row that is delivered again does no harm.
    """

    root: str
    keys: Sequence[str]
    order: Sequence[str]
    state: str
    lateness: str | None = None
    expiry: str | None = None
    fold_every: int = FOLD_EVERY
    _marks: dict[int, tuple[Any, int, int]] = field(default_factory=dict, repr=False)

    def start(
        self,
        stream: DataFrame,
        checkpoint: str,
        available_now: bool = False,
        interval: str = DEFAULT_INTERVAL,
    ) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint
        )
        return triggered(writer, available_now, interval).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Handle one micro-batch. Run again with the same batch, it writes the same."""
        spark, rows = batch.sparkSession, self._rows(batch.schema)
        latest, held = self._mark(spark, batch.schema, batch_id)
        horizon = self._horizon(batch.schema, latest)
        on_time = F.lit(True) if horizon is None else F.coalesce(self._time() >= horizon, F.lit(True))
        seen = Observation()
        taken = batch.observe(
            seen, F.count(F.when(on_time, 1)).alias("rows"), F.count(F.when(~on_time, 1)).alias("late"),
            F.max(self._time()).alias("latest"),
        )
        fresh = taken.where(on_time)
        if held:
            fresh = self._matching(fresh, rows.before(spark, batch_id), [*self.keys, *self.order], "left_anti")
        rows.add(fresh, batch_id)
        found = seen.get
        times = [t for t in (latest, found["latest"]) if t is not None]
        self._note(spark, batch.schema, batch_id, (max(times, default=None), held + found["rows"], found["late"]))

        names = rows.schema.fieldNames()
        new = rows.added(spark, batch_id).select(*names)
        if held:
            kept = self._matching(rows.before(spark, batch_id), new, self.keys, "left_semi")
            sides = kept.select(*names, F.explode(F.array(F.lit(True), F.lit(False))).alias("_with"))
            sides = sides.unionByName(new.withColumn("_with", F.lit(True)))
        else:
            sides = new.withColumn("_with", F.lit(True))
        points = change_points(
            sides, ["_with", *self.keys], self.order, self.state, at_most=2 * held + found["rows"]
        )
        count = F.sum(F.when(F.col("_with"), 1).otherwise(-1)).alias("sign")
        signed = points.groupBy(*names, "previous_state").agg(count).where("sign <> 0") if held else (
            points.select(*names, "previous_state", F.lit(1).cast("bigint").alias("sign"))
        )
        write_batch(signed, f"{self.root}/points", batch_id)
        if self.lateness is not None and (batch_id + 1) % self.fold_every == 0:
            until, left = self._horizon(batch.schema, max(times, default=None)), Observation()
            rows.fold(spark, batch_id, lambda all_rows: self._open(all_rows, until).observe(left, F.count(F.lit(1)).alias("rows")))
            self._note(spark, batch.schema, batch_id, (max(times, default=None), left.get["rows"], found["late"]))

    def points(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """All changes so far. ``schema`` is that of the stream."""
        previous = StructField("previous_state", schema[self.state].dataType)
        kept = StructType([*schema.fields, previous, StructField("sign", LongType())])
        names = kept.fieldNames()[:-1]
        summed = read_batches(spark, f"{self.root}/points", kept).groupBy(*names).agg(F.sum("sign").alias("_times"))
        return summed.where("_times > 0").select(*names, F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_copy")).drop("_copy")

    def late_rows(self, spark: SparkSession, schema: StructType) -> int:
        """How many rows came too late."""
        marks = read_batches(spark, f"{self.root}/kept/marks", self._mark_schema(schema))
        return marks.agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]

    def _rows(self, schema: StructType) -> KeptTable:
        # Without a bound nothing is ever let go of, so there is nothing to fold.
        every = self.fold_every if self.lateness is not None else 1 << 62
        return KeptTable(f"{self.root}/kept/rows", schema, lambda rows: rows, every)

    def _time(self) -> Column:
        return F.col(self.order[0])

    def _horizon(self, schema: StructType, latest: Any) -> Column | None:
        if self.lateness is None or latest is None:
            return None
        return self._literal(latest, schema[self.order[0]].dataType) - F.expr(self.lateness)

    @staticmethod
    def _literal(value: Any, kind: DataType) -> Column:
        """A Python time without a zone would count as one of the session's zone."""
        return F.lit(str(value) if value is not None and isinstance(kind, TimestampNTZType) else value).cast(kind)

    @staticmethod
    def _matching(rows: DataFrame, other: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
        """``rows`` with, or without, a row in ``other`` of the same ``columns``; null is equal to null."""
        there = other.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct()
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
        return rows.join(there, same, how)

    def _open(self, rows: DataFrame, horizon: Column | None) -> DataFrame:
        """Rows that may still get a neighbour: those from the horizon on, and the last one of each key before it."""
        if horizon is None:
            return rows
        after = F.coalesce(self._time() >= horizon, F.lit(False))
        names = [c for c in rows.columns if c != "batch"]
        closed = rows.where(~after)
        if self.expiry is not None:
            closed = closed.where(F.coalesce(self._time() >= horizon - F.expr(self.expiry), F.lit(False)))
        last = F.max_by(F.struct(*names), F.struct(*self.order)).alias("_last")
        return rows.where(after).select(*names).unionByName(closed.groupBy(*self.keys).agg(last).select("_last.*"))

    def _mark_schema(self, schema: StructType) -> StructType:
        number = [StructField("held", LongType()), StructField("late", LongType())]
        return StructType([StructField("latest", schema[self.order[0]].dataType), *number])

    def _mark(self, spark: SparkSession, schema: StructType, batch_id: int) -> tuple[Any, int]:
        """Latest time, and a bound of the rows that are kept, as of before ``batch_id``."""
        if not batch_id:
            return None, 0
        if batch_id - 1 not in self._marks:
            row = read_batches(spark, f"{self.root}/kept/marks", self._mark_schema(schema), batch_id - 1, batch_id).first()
            self._marks[batch_id - 1] = (row["latest"], row["held"], row["late"])
        return self._marks[batch_id - 1][:2]

    def _note(self, spark: SparkSession, schema: StructType, batch_id: int, mark: tuple[Any, int, int]) -> None:
        kinds = self._mark_schema(schema)
        row = spark.range(0, 1, 1, 1).select(*[self._literal(v, f.dataType).alias(f.name) for v, f in zip(mark, kinds)])
        write_batch(row, f"{self.root}/kept/marks", batch_id)
        self._marks = {batch_id: mark}

