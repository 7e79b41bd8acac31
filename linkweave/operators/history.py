"""Committed against applied history, per target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linkweave.functions.text import DIGESTS, packed, unpacked
from linkweave.operators.ordered import with_order
from linkweave.session import cut_lineage

TARGET = ["target_id", "chain_id"]


def compare_histories(changes: DataFrame, applied: DataFrame) -> DataFrame:
    """Every distinct applied row with its position and whether the committed change there
    is equal; ``copies`` says how often the row is recorded.

    Equality is that of one SHA-256 over the file name and both hashes, nulls included, so two hashes travel as
    one, and as they are only where they are asked for. The join itself is a plain equi-join on narrow
    columns, hashes as bytes, which AQE can split where a chain has very many targets.
    """
    entry = F.unhex(F.sha2(F.to_json(F.struct("filename", "hash", "previous_hash")), 256))
    rows = applied.select(*TARGET, "filename", "hash", "previous_hash")
    placed = with_order(rows, TARGET, ["filename", "hash"], weight="copies", digests=DIGESTS, copies="copies")
    committed = changes.select(
        "chain_id", F.col("version").cast("bigint").alias("position"), entry.alias("committed")
    )
    compared = (
        packed(placed.withColumn("ours", entry)).join(committed, ["chain_id", "position"], "left")
        .withColumn("known", F.col("committed").isNotNull())
        .withColumn("same", F.col("ours").eqNullSafe(F.col("committed")))
        .drop("ours", "committed")
    )
    return unpacked(compared)


def chain_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("chain_id").agg(F.count("*").alias("total_committed"))


def stored_totals(changes: DataFrame) -> DataFrame:
    """One stored row per chain. Targets join this table, once: AQE can split a chain with very
    many targets there, which it does not where the other side is aggregated in the same plan."""
    return cut_lineage(chain_totals(changes), "totals")


def _judged(per_target: DataFrame, chains: DataFrame) -> DataFrame:
    """Add committed totals, the history error and whatever else ``chains`` has, per target."""
    count = F.coalesce(F.col("applied_count"), F.lit(0))
    total = F.coalesce(F.col("total_committed"), F.lit(0))
    more = [c for c in chains.columns if c not in ("chain_id", "total_committed")]
    return per_target.join(chains, "chain_id", "left").select(
        *TARGET,
        count.alias("applied_count"),
        total.alias("total_committed"),
        F.col("first.position").alias("diverged_position"),
        F.col("first.filename").alias("diverged_filename"),
        F.when(count > total, "E20").when(F.col("first").isNotNull(), "E21").alias("error_code"),
        *more,
    )


def _applied_counts(changes: DataFrame, applied: DataFrame) -> DataFrame:
    wrong = F.col("known") & ~F.col("same")
    # The second of two copies sits where the next change should be.
    repeated = F.col("copies") > 1
    differs = F.when(
        wrong | repeated,
        F.struct((F.col("position") + F.when(wrong, 0).otherwise(1)).alias("position"), "filename"),
    )
    return (
        compare_histories(changes, applied)
        .groupBy(*TARGET)
        .agg(F.sum("copies").alias("applied_count"), F.min(differs).alias("first"))
    )


def applied_summary(changes: DataFrame, applied: DataFrame) -> DataFrame:
    """Per target with applied rows: how many, how many committed, first difference, code."""
    return _judged(_applied_counts(changes, applied), stored_totals(changes))


def history_divergence(changes: DataFrame, applied: DataFrame) -> DataFrame:
    """Targets whose applied history is not a prefix of the committed one."""
    return applied_summary(changes, applied).where(F.col("error_code").isNotNull())


def orphan_applied(changes: DataFrame, applied: DataFrame) -> DataFrame:
    """Applied rows that no committed change answers to."""
    committed = changes.select("chain_id", "filename")
    return applied.select(*TARGET, "filename", "hash").join(
        committed, ["chain_id", "filename"], "left_anti"
    )


def target_progress(
    changes: DataFrame, applied: DataFrame, targets: DataFrame, chains: DataFrame | None = None
) -> DataFrame:
    """One row per target: applied and committed counts, and the history error if any.

    A target without applied rows has an empty history, which is always a prefix. ``chains``
    may bring the stored totals with more columns per chain, so that there is one join.
    """
    counts = targets.select(*TARGET).join(_applied_counts(changes, applied), TARGET, "left")
    return _judged(counts, stored_totals(changes) if chains is None else chains)


def pending_after(changes: DataFrame, progress: DataFrame) -> DataFrame:
    """The committed changes beyond each target's applied count.

    The missing versions are written out as numbers and then looked up by an equi-join,
    so only pending rows ever exist; changes a target already has are not paired with it.
    Spark takes the written out numbers for as few as the targets they come from; the hint keeps
    them from being broadcast.
    """
    missing = (
        progress.where(F.col("total_committed") > F.col("applied_count"))
        .select(
            *TARGET,
            F.explode(
                F.sequence(
                    (F.col("applied_count") + 1).cast("int"),
                    F.col("total_committed").cast("int"),
                )
            ).alias("version"),
        )
    )
    found = missing.hint("merge").join(
        packed(changes.select("chain_id", "version", "filename", "hash", "previous_hash")),
        ["chain_id", "version"],
    )
    return unpacked(found).select(*TARGET, "version", "filename", "hash", "previous_hash")


def pending_changes(changes: DataFrame, applied: DataFrame, targets: DataFrame) -> DataFrame:
    """Pending changes of the targets whose history holds; the others have to be looked at."""
    progress = target_progress(changes, applied, targets)
    return pending_after(changes, progress.where(F.col("error_code").isNull()))


def pending_by_offset(changes: DataFrame, applied: DataFrame, targets: DataFrame) -> DataFrame:
    """What is left after skipping as many changes as are applied, with no history check."""
    counts = applied.groupBy(*TARGET).agg(F.count("*").alias("applied_count"))
    progress = (
        targets.select(*TARGET)
        .join(counts, TARGET, "left")
        .join(stored_totals(changes), "chain_id")
        .select(*TARGET, F.coalesce("applied_count", F.lit(0)).alias("applied_count"), "total_committed")
    )
    return pending_after(changes, progress)
