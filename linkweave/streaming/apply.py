"""Continuous apply: whatever changes arrive are checked and applied to their targets.

What a micro-batch has to know of earlier ones is kept per chain: how many changes are linked, the
hash of the last one, and whether the chain is broken; besides, changes that wait for one before
them, the last write per key, and the targets that are in step with their chain. A batch is
merged into that. It reads the history of its chains only in two cases: a change arrives once more
under a version that is linked already, to see if it is the same; and a target is new on a chain that
has moved on, to bring it up to date.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from linkweave.functions.text import hash_matches, normalize, packed, parse_version, unpacked
from linkweave.operators.history import TARGET
from linkweave.operators.ordered import broadcast_if_small, with_order
from linkweave.operators.state import STATE_KEY, last_writes
from linkweave.schemas import APPLIED_LOG, CHANGE_LOG, EFFECTS, STATE, TARGETS
from linkweave.session import cut_and_count, scratch
from linkweave.streaming.arrivals import stream_change_files  # noqa: F401, its name here is older
from linkweave.streaming.common import DEFAULT_INTERVAL, FOLD_EVERY, KeptTable, read_batches, triggered, write_batch

# A change row with the key and value it writes (one row per written key).
CHANGE_EVENTS = StructType([*CHANGE_LOG.fields, EFFECTS["key"], EFFECTS["value"]])
_RECORDED = StructType([APPLIED_LOG[c] for c in [*TARGET, "filename", "hash", "previous_hash"]])


# One row per chain: links before and after the batch that ``touched`` it last, and what came of it.
_HEADS = StructType([
    StructField("chain_id", LongType()),
    StructField("links_before", LongType()),
    StructField("links", LongType()),
    StructField("head_hash", StringType()),
    StructField("broken", BooleanType()),
    StructField("gap", BooleanType()),
    StructField("touched", LongType()),
])
# What is left of an event when its body was read: if its hash holds, and the digest of a body that the hash does not name.
_NARROW = StructType([
    *[field for field in CHANGE_EVENTS.fields if field.name != "body"],
    StructField("hash_ok", BooleanType()),
    StructField("other_body", BinaryType()),
])
_MOVED_ON = "not gap and not broken and links > links_before"
_SERVED = StructType([*TARGETS.fields, StructField("behind", BooleanType())])


def _narrow(events: DataFrame) -> DataFrame:
    """Events without their bodies; equal where the events are."""
    ok = F.coalesce(hash_matches("previous_hash", "hash", "body"), F.lit(False))
    named = ok & F.coalesce(normalize("body") == F.col("body"), F.lit(False))
    other = F.when(~named, F.unhex(F.sha2("body", 256)))
    return events.withColumns({"hash_ok": ok, "other_body": other}).select(*_NARROW.fieldNames())


def _marked(rows: DataFrame) -> DataFrame:
    """``chain_id, version`` and 32 bytes for all that a ``_narrow`` change has besides."""
    rest = F.to_json(F.struct("filename", "previous_hash", "hash", "hash_ok", "other_body"))
    return rows.select("chain_id", "version", F.unhex(F.sha2(rest, 256)).alias("mark"))


def _newest_heads(rows: DataFrame) -> DataFrame:
    rest = [c for c in _HEADS.fieldNames() if c != "chain_id"]
    newest = F.max_by(F.struct(*rest), "touched").alias("_newest")
    return rows.groupBy("chain_id").agg(newest).select("chain_id", "_newest.*")


def _served_once(rows: DataFrame) -> DataFrame:
    return rows.select(*TARGET).distinct().withColumn("behind", F.lit(False))


@dataclass
class ContinuousApply:
    """Results below ``root``: ``arrived`` rows, ``state`` writes, ``applied`` rows; ``kept`` is its own.

    A chain moves on when the changes that wait for it and those that arrive follow on its head
    without a gap; then all of them are applied to all its targets. With a gap they wait. A change
    that can never fit (a wrong hash or link, a second change of one version) breaks its
    chain: nothing is applied to it any more. That is what ``apply_pending`` over all that has
    arrived would do. Every batch reads what earlier batches left and writes folders of its own, so one that is run
    again, wherever it failed, writes the same again, and every change takes effect once.
    """

    root: str
    targets: DataFrame
    fold_every: int = FOLD_EVERY

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
        """Take in ``CHANGE_EVENTS`` rows and bring the targets of their chains up to date."""
        spark = batch.sparkSession
        write_batch(batch.select(*CHANGE_EVENTS.fieldNames()), f"{self.root}/arrived", batch_id)
        with scratch(spark):
            pool, rows, stale = self._pool(spark, batch_id)
            conflicts = self._conflicts(spark, pool, batch_id) if stale else None
            on = Observation()
            judged = self._judged(pool, rows, conflicts, batch_id)
            self._heads.add(judged.observe(on, F.count(F.when(F.expr(_MOVED_ON), 1)).alias("moved")), batch_id)
            heads = self._heads.added(spark, batch_id).drop("batch")

            fresh = packed(pool.where("version is null or version > links"))
            waiting = heads.where("gap and not broken").select("chain_id")
            self._waiting.add(unpacked(fresh.where("new").join(waiting, "chain_id", "left_semi")), batch_id)
            moved = heads.where("not gap and not broken").select("chain_id", "links_before", "links")
            ahead = broadcast_if_small(heads.where(_MOVED_ON).select("chain_id"), on.get["moved"])
            linked = fresh.join(ahead, "chain_id", "left_semi")
            self._writes.add(last_writes(linked.select(*EFFECTS.fieldNames())), batch_id)

            behind = self._serve(spark, moved.where("links > 0"), batch_id)
            self._write_results(spark, linked, behind, batch_id)
            self._heads.fold(spark, batch_id)
            self._writes.fold(spark, batch_id)
            self._served.fold(spark, batch_id)
            self._waiting.fold(spark, batch_id, lambda rows: self._still_waiting(rows, self._heads.before(spark, batch_id + 1)))

    @property
    def _heads(self) -> KeptTable:
        return KeptTable(f"{self.root}/kept/heads", _HEADS, _newest_heads, self.fold_every)

    @property
    def _waiting(self) -> KeptTable:
        return KeptTable(f"{self.root}/kept/waiting", _NARROW, lambda rows: rows, self.fold_every)

    @property
    def _writes(self) -> KeptTable:
        return KeptTable(f"{self.root}/kept/writes", EFFECTS, last_writes, self.fold_every)

    @property
    def _served(self) -> KeptTable:
        return KeptTable(f"{self.root}/kept/served", _SERVED, _served_once, self.fold_every)

    @staticmethod
    def _still_waiting(waiting: DataFrame, heads: DataFrame) -> DataFrame:
        """A row waits from the batch it came with until its chain is linked beyond it, or broken."""
        ends = heads.where("gap and not broken").select("chain_id", "links")
        return unpacked(packed(waiting).join(ends, "chain_id").where("version > links").drop("links"))

    def _pool(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, int, int]:
        """Rows that arrived or wait for chains that were touched, with the head of their chain; how many, and how many are of linked versions."""
        arrived = _narrow(read_batches(spark, f"{self.root}/arrived", CHANGE_EVENTS, batch_id, batch_id + 1))
        touched = arrived.select("chain_id").distinct()
        heads = self._heads.before(spark, batch_id).join(touched, "chain_id", "left_semi")
        waiting = self._waiting.before(spark, batch_id).select(*arrived.columns)
        both = arrived.withColumn("new", F.lit(True)).unionByName(waiting.withColumn("new", F.lit(False)))
        rows = unpacked(
            packed(both)
            .join(heads.select("chain_id", "links", "head_hash", "broken", "gap"), "chain_id", "left")
            .where("new or (gap and not broken and version > links)")
            .drop("gap")
            .withColumn("links", F.coalesce("links", F.lit(0)))
            .withColumn("broken", F.coalesce("broken", F.lit(False)))
        )
        seen = Observation()
        again = (F.col("version") <= F.col("links")) & ~F.col("broken")
        pool, count = cut_and_count(rows.observe(seen, F.count(F.when(again, 1)).alias("stale")), "pool")
        return pool, count, seen.get["stale"]

    def _log(self, spark: SparkSession, batch_id: int, wanted: DataFrame) -> DataFrame:
        """Changes that arrived before ``batch_id``, of the chains (and versions) of ``wanted``."""
        arrived = read_batches(spark, f"{self.root}/arrived", CHANGE_EVENTS, 0, batch_id)
        return arrived.select(*CHANGE_LOG.fieldNames()).join(wanted, wanted.columns, "left_semi").distinct()

    def _conflicts(self, spark: SparkSession, pool: DataFrame, batch_id: int) -> DataFrame:
        """Chains with a change that differs from the linked one of its version."""
        again = _marked(pool.where("version <= links and not broken"))
        arrived = _narrow(read_batches(spark, f"{self.root}/arrived", CHANGE_EVENTS, 0, batch_id))
        known = _marked(arrived).join(again.select("chain_id", "version").distinct(), ["chain_id", "version"], "left_semi")
        return again.subtract(known).select("chain_id").distinct()

    def _judged(self, pool: DataFrame, rows: int, conflicts: DataFrame | None, batch_id: int) -> DataFrame:
        """Heads of the touched chains after this batch."""
        head = F.lower("head_hash")
        changes = pool.where("not broken and (version is null or version > links)")
        cased = (F.col("hash") != F.lower("hash")) | (F.col("previous_hash") != F.lower("previous_hash"))
        checked = changes.select(
            "chain_id", "links", head.alias("head"), "filename",
            parse_version("filename").eqNullSafe(F.col("version")).alias("named"),
            F.col("version").cast("bigint").alias("version"),
            F.lower("hash").alias("hash"),
            F.lower("previous_hash").alias("previous"),
            "hash_ok", "other_body",
            F.when(cased, F.concat_ws(":", "hash", "previous_hash")).alias("as_written"),
        )
        placed = with_order(
            checked, ["chain_id"], ["filename", "hash"], ["hash"], at_most=rows, digests=["hash", "previous"], copies="copies"
        )
        place = F.col("links") + F.col("position")
        before = F.when(F.col("position") == 1, F.col("head")).otherwise(F.col("before_hash"))
        misfit = (F.col("version") < place) | ((F.col("version") == place) & ~F.col("previous").eqNullSafe(before))
        faulty = ~F.col("named") | F.col("version").isNull() | ~F.col("hash_ok") | misfit
        judged = placed.groupBy("chain_id").agg(
            F.max(F.coalesce(faulty, F.lit(True))).alias("faulty"),
            F.max(F.coalesce(F.col("version") > place, F.lit(False))).alias("gap"),
            F.count("*").alias("n"),
            F.max_by("hash", "version").alias("last_hash"),
        )
        chains = pool.groupBy("chain_id").agg(
            F.max("links").alias("links_before"), F.max("head_hash").alias("head_hash"), F.max("broken").alias("broken")
        )
        if conflicts is not None:
            differs = conflicts.withColumn("differs", F.lit(True))
            chains = chains.join(differs, "chain_id", "left").withColumn("broken", F.col("broken") | F.coalesce("differs", F.lit(False)))
        broken = F.col("broken") | F.coalesce("faulty", F.lit(False))
        gap = F.coalesce("gap", F.lit(False)) & ~broken
        on = ~broken & ~gap
        return chains.join(judged, "chain_id", "left").select(
            "chain_id",
            "links_before",
            (F.col("links_before") + F.when(on, F.coalesce("n", F.lit(0))).otherwise(0)).alias("links"),
            F.when(on, F.coalesce("last_hash", "head_hash")).otherwise(F.col("head_hash")).alias("head_hash"),
            broken.alias("broken"),
            gap.alias("gap"),
            F.lit(batch_id).cast("bigint").alias("touched"),
        )

    def _serve(self, spark: SparkSession, moved: DataFrame, batch_id: int) -> int:
        """Note the targets of the chains that are up to date; how many of them lack earlier changes."""
        wanted = self.targets.select(*TARGET).distinct().join(moved, "chain_id")
        known = self._served.before(spark, batch_id).select(*TARGET).join(moved, "chain_id", "left_semi")
        served = wanted.join(known.withColumn("known", F.lit(True)), TARGET, "left")
        behind = F.col("known").isNull() & (F.col("links_before") > 0)
        seen = Observation()
        rows = served.select(*TARGET, behind.alias("behind"))
        self._served.add(rows.observe(seen, F.count(F.when(F.col("behind"), 1)).alias("behind")), batch_id)
        return seen.get["behind"]

    def _write_results(self, spark: SparkSession, linked: DataFrame, behind: int, batch_id: int) -> None:
        served = self._served.added(spark, batch_id)
        names = _RECORDED.fieldNames()
        changes = linked.select("chain_id", *names[len(TARGET):]).distinct()
        new_writes = self._writes.added(spark, batch_id).drop("batch")
        if not behind:
            applied, state = served.join(changes, "chain_id"), served.join(new_writes, "chain_id")
        else:
            late = served.where("behind")
            wanted = late.select("chain_id").distinct()
            past = packed(self._log(spark, batch_id, wanted).select(*changes.columns)).unionByName(
                changes.join(wanted, "chain_id", "left_semi")
            )
            applied = served.where("not behind").join(changes, "chain_id").select(*names).unionByName(
                late.join(past.distinct(), "chain_id").select(*names)
            )
            writes = self._writes.before(spark, batch_id + 1)
            state = served.where("not behind").join(new_writes, "chain_id").select(*STATE.fieldNames()).unionByName(
                late.join(writes, "chain_id").select(*STATE.fieldNames())
            )
        write_batch(state.select(*STATE.fieldNames()), f"{self.root}/state", batch_id)
        write_batch(unpacked(applied.select(*names)), f"{self.root}/applied", batch_id)

    def state(self, spark: SparkSession) -> DataFrame:
        """The state of all targets: of all writes to a key, the highest version counts."""
        return (
            read_batches(spark, f"{self.root}/state", STATE)
            .groupBy(*STATE_KEY)
            .agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))
        )

    def applied(self, spark: SparkSession) -> DataFrame:
        return read_batches(spark, f"{self.root}/applied", _RECORDED).drop("batch")

    def chains(self, spark: SparkSession, batches: int) -> DataFrame:
        """``chain_id, links, head_hash, broken, gap`` after so many batches."""
        return self._heads.before(spark, batches).select("chain_id", "links", "head_hash", "broken", "gap")
