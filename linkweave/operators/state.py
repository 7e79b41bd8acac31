"""State tables that changes write into: replay, increments, evolving columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from linkweave.operators.history import TARGET

STATE_KEY = [*TARGET, "key"]


def last_writes(effects: DataFrame) -> DataFrame:
    """Per chain and key, the value of the last version that wrote it.

    The aggregation combines before the shuffle, so a hot key costs one row per task.
    """
    return effects.groupBy("chain_id", "key").agg(
        F.max_by("value", "version").alias("value"), F.max("version").alias("version")
    )


def overlay(state: DataFrame, writes: DataFrame) -> DataFrame:
    """State after ``writes``: the higher version wins, so replaying a write is harmless."""
    columns = [*STATE_KEY, "version", "value"]
    return (
        state.select(*columns)
        .unionByName(writes.select(*columns))
        .groupBy(*STATE_KEY)
        .agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
        .select(*columns)
    )


def pending_writes(effects: DataFrame, pending: DataFrame) -> DataFrame:
    """What the pending changes (``target_id, chain_id, version``) leave behind in each target.

    All pending suffixes of a chain end at the same last change. So a key's last write in
    the chain is what a target gets if its version is pending there: the missing versions
    meet the last writes by (chain, version), and only rows that are written come out. The pending rows
    are dealt out by that already; the hint keeps the last writes off the driver.
    """
    return (
        pending.select(*TARGET, "version")
        .join(last_writes(effects).hint("merge"), ["chain_id", "version"])
        .select(*STATE_KEY, "version", "value")
    )


def rebuild_state(effects: DataFrame, targets: DataFrame) -> DataFrame:
    """State of every target after its whole chain, from nothing."""
    return (
        targets.select(*TARGET)
        .join(last_writes(effects), "chain_id")
        .select(*STATE_KEY, "version", "value")
    )


def evolve_union(*histories: DataFrame) -> DataFrame:
    """Histories with different columns in one table; a column not there yet is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), histories)
