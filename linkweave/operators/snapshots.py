"""Snapshots of file stamps, and points where a state changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from linkweave.operators.ordered import broadcast_if_small, with_order
from linkweave.session import cut_and_count

STAMP = ["path", "modified_ms", "size"]


def stamp_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each path as added, removed, modified or same.

    Both snapshots go through one aggregation by path instead of a full outer join: it
    is one shuffle, it combines before shuffling, and fixed-width buffers keep it hashed.
    """
    both = (
        before.select(*STAMP, F.lit(True).alias("old"))
        .unionByName(after.select(*STAMP, F.lit(False).alias("old")))
    )
    sides = both.groupBy("path").agg(
        F.max(F.col("old")).alias("was"),
        F.max(~F.col("old")).alias("is"),
        F.max(F.when(F.col("old"), F.col("modified_ms"))).alias("old_modified_ms"),
        F.max(F.when(F.col("old"), F.col("size"))).alias("old_size"),
        F.max(F.when(~F.col("old"), F.col("modified_ms"))).alias("new_modified_ms"),
        F.max(F.when(~F.col("old"), F.col("size"))).alias("new_size"),
    )
    equal = F.col("old_modified_ms").eqNullSafe(F.col("new_modified_ms")) & F.col(
        "old_size"
    ).eqNullSafe(F.col("new_size"))
    return sides.select(
        "path",
        F.when(~F.col("was"), "added")
        .when(~F.col("is"), "removed")
        .when(equal, "same")
        .otherwise("modified")
        .alias("change"),
        "old_modified_ms",
        "new_modified_ms",
        "old_size",
        "new_size",
    )


def snapshot_equality(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the number of stamps on one side only, and whether there are none.

    Stamps count +1 on one side and -1 on the other, so a single shuffle decides both
    directions of the bag difference.
    """
    signed = (
        before.select(*STAMP, F.lit(1).alias("sign"))
        .unionByName(after.select(*STAMP, F.lit(-1).alias("sign")))
    )
    return (
        signed.groupBy(*STAMP)
        .agg(F.sum("sign").alias("balance"))
        .agg(F.coalesce(F.sum(F.abs("balance")), F.lit(0)).alias("differing_stamps"))
        .select("differing_stamps", (F.col("differing_stamps") == 0).alias("equal"))
    )


def snapshot_changes(stamps: DataFrame) -> DataFrame:
    """Snapshots of a sequence whose bag of stamps differs from that of the one before.

    A stamp counts for its own snapshot and against the next one, so what does not cancel
    out is what came or went; one aggregation by stamp decides the whole sequence. The list
    of snapshot ids is as long as the sequence; stamps meet it where they are read, since dealt out by
    snapshot there would be no more tasks than snapshots. The first snapshot differs from nothing.
    """
    ids = stamps.select("snapshot_id").distinct()
    order = Window.orderBy("snapshot_id")  # of one row per snapshot
    steps, n = cut_and_count(ids.select("snapshot_id", F.lead("snapshot_id").over(order).alias("_next")), "steps")
    own = F.struct(F.col("snapshot_id").alias("at"), F.lit(1).alias("sign"))
    following = F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("at"), F.lit(-1).alias("sign")))
    signed = stamps.join(broadcast_if_small(steps, n), "snapshot_id").select(
        *STAMP, F.inline(F.array_compact(F.array(own, following)))
    )
    balances = signed.groupBy("at", *STAMP).agg(F.sum("sign").alias("balance")).where("balance <> 0")
    return balances.groupBy(F.col("at").alias("snapshot_id")).agg(
        F.coalesce(F.sum(F.when(F.col("balance") > 0, F.col("balance"))), F.lit(0)).alias("appeared"),
        F.coalesce(F.sum(F.when(F.col("balance") < 0, -F.col("balance"))), F.lit(0)).alias("gone"),
    )


def change_points(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str,
    earlier: DataFrame | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Rows whose state differs from the state before it in the same key; the first counts.

    ``earlier`` holds the last state of keys seen before these rows: ``keys`` and ``state``.
    It is joined at position 1 only, so a key with many rows meets it once. ``at_most`` is a
    bound of the number of rows, where one is known.
    """
    placed = with_order(rows, keys, order, carry=[state], at_most=at_most)
    previous = F.col(f"before_{state}")
    first = F.col("position") == 1
    changed = placed.where(first | ~F.col(state).eqNullSafe(previous))
    if earlier is not None:
        seen = earlier.select(
            *keys, F.lit(1).cast("bigint").alias("position"), F.struct(state).alias("_seen")
        )
        changed = changed.join(seen, [*keys, "position"], "left").where(
            F.col("_seen").isNull() | ~F.col("_seen")[state].eqNullSafe(F.col(state))
        )
        previous = F.coalesce(previous, F.col("_seen")[state])
    return changed.select(*rows.columns, previous.alias("previous_state"))
