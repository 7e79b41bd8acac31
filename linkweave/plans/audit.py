"""Every violation of change logs and applied histories in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkweave.functions.text import parse_version
from linkweave.operators.chain import (
    bad_genesis, broken_link, not_contiguous, positioned, verify_links,
)
from linkweave.operators.history import history_divergence
from linkweave.operators.violations import violation_rows
from linkweave.sources.files import change_log, parse_violations
from linkweave.sources.tables import applied_key_violations


def log_violations(changes: DataFrame) -> DataFrame:
    """E01 and E13-E17 of a change log, one row per distinct change and fault.

    Bodies are hashed where they are read; only narrow columns and the verdict are
    shuffled, once. Copies of a change are counted and placed as one row; where a chain is hot, before they travel.
    """
    checked = verify_links(changes).select(
        "chain_id",
        "filename",
        F.lower("previous_hash").alias("previous_hash"),
        F.lower("hash").alias("hash"),
        "hash_ok",
        parse_version("filename").alias("version"),
    )
    position, version = F.col("position"), F.col("version")
    previous, before = F.col("previous_hash"), F.col("before_hash")

    def fault(found: Column, code: str, detail: Column) -> Column:
        return F.when(
            found, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail"))
        )

    faults = F.array(
        fault(version.isNull(), "E01", F.col("filename")),
        fault(~F.col("hash_ok"), "E13", F.col("hash")),
        fault(version.isNotNull() & not_contiguous(position, version), "E14", position),
        fault(bad_genesis(position, previous), "E15", previous),
        fault(broken_link(position, previous, before), "E16", before),
        fault(F.col("copies") > 1, "E17", F.col("copies")),
    )
    found = positioned(checked, "copies").select(
        "chain_id", "version", "filename", F.explode(F.array_compact(faults)).alias("fault")
    )
    return violation_rows(
        found,
        code=F.col("fault.code"),
        chain_id=F.col("chain_id"),
        version=version,
        filename=F.col("filename"),
        detail=F.col("fault.detail"),
    )


def history_violations(changes: DataFrame, applied: DataFrame) -> DataFrame:
    """E20 or E21 of each target whose history does not hold."""
    return violation_rows(
        history_divergence(changes, applied),
        code=F.col("error_code"),
        chain_id=F.col("chain_id"),
        target_id=F.col("target_id"),
        version=F.when(F.col("error_code") == "E21", F.col("diverged_position")),
        filename=F.when(F.col("error_code") == "E21", F.col("diverged_filename")),
        detail=F.concat_ws(
            " of ", F.col("applied_count").cast("string"), F.col("total_committed").cast("string")
        ),
    )


def key_violations(applied: DataFrame) -> DataFrame:
    """E17-E19 of applied logs: keys that a table with constraints would have refused."""
    by_name = F.col("key_name") == "filename"
    return violation_rows(
        applied_key_violations(applied),
        code=F.when(F.col("key_value").isNull(), "E19").when(by_name, "E17").otherwise("E18"),
        chain_id=F.col("chain_id"),
        target_id=F.col("target_id"),
        filename=F.when(by_name, F.col("key_value")),
        detail=F.concat_ws(" x", F.col("key_name"), F.col("n_rows").cast("string")),
    )


def audit_files(parsed: DataFrame, applied: DataFrame) -> DataFrame:
    """Everything that is wrong with scanned files (``files.parse_changes``) and histories.

    A file that cannot be parsed is reported as such; the log checks see the sound files. A
    later file may be reported for the gap the faulty one leaves, but never an earlier one,
    so ``first_violation`` of the result is where a check from the start would stop.
    """
    return audit(change_log(parsed), applied).unionByName(parse_violations(parsed))


def audit(changes: DataFrame, applied: DataFrame) -> DataFrame:
    return (
        log_violations(changes)
        .unionByName(history_violations(changes, applied))
        .unionByName(key_violations(applied))
    )
