"""Status, apply, rebuild, run, commit, uncommit and validation over whole fleets.

Every gate is a join: a chain or target with a violation is left out and reported, the
others go on. Nothing is decided row by row on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from linkweave.functions.headers import candidate_error
from linkweave.functions.text import (
    has_changes, link_hash, normalize, status_code, to_lf, version_filename,
)
from linkweave.operators.chain import chain_heads, latest_change, next_versions
from linkweave.operators.history import TARGET, chain_totals, pending_after, target_progress
from linkweave.operators.scripts import unknown_placeholders
from linkweave.operators.state import overlay, pending_writes, rebuild_state
from linkweave.operators.violations import first_violation, violation_rows
from linkweave.plans.audit import log_violations
from linkweave.plans.compile import CANDIDATE_PATH, compile_scripts, expand_candidates
from linkweave.session import cut_lineage


def gated_progress(
    changes: DataFrame, applied: DataFrame, targets: DataFrame, chains: DataFrame | None = None
) -> DataFrame:
    """``target_progress`` with ``error_code`` also set where the chain itself is faulty."""
    chains = checked_chains(changes) if chains is None else chains
    return target_progress(changes, applied, targets, chains).select(
        *TARGET,
        "applied_count",
        "total_committed",
        "diverged_filename",
        F.coalesce("chain_error", "error_code").alias("error_code"),
    )


def checked_chains(changes: DataFrame, *more: DataFrame) -> DataFrame:
    """One stored row per chain: its length, its first error, and the columns of ``more``.

    Plans over one log may be given this table as ``chains``, so that the log is checked once for all of them.
    """
    rows = chain_totals(changes)
    for part in (_chain_errors(changes), *more):
        rows = rows.join(part, "chain_id", "full_outer")
    return cut_lineage(rows, "chains")


def _chain_errors(changes: DataFrame) -> DataFrame:
    """Faulty chains with the error that comes first in them."""
    return first_violation(log_violations(changes)).select(
        "chain_id", F.col("error_code").alias("chain_error")
    )


def fleet_status(
    changes: DataFrame, applied: DataFrame, candidates: DataFrame, targets: DataFrame
) -> DataFrame:
    """Per target: pending changes, candidate changes, the two as a code, or the error."""
    changed = candidates.select("chain_id", has_changes("body").alias("candidate_has_changes"))
    rows = target_progress(changes, applied, targets, checked_chains(changes, changed)).withColumn(
        "error_code", F.coalesce("chain_error", "error_code")
    )
    pending = F.col("total_committed") > F.col("applied_count")
    has = F.coalesce("candidate_has_changes", F.lit(False))
    sound = F.col("error_code").isNull()
    return rows.select(
        *TARGET,
        "applied_count",
        "total_committed",
        F.when(sound, pending).alias("pending_committed"),
        F.when(sound, has).alias("candidate_has_changes"),
        F.when(sound, status_code(pending, has)).alias("code"),
        "error_code",
    )


@dataclass
class Applied:
    """What applying pending changes gives."""

    state: DataFrame  # target_id, chain_id, key, version, value
    writes: DataFrame  # the state rows that are new
    applied: DataFrame  # rows to record: target_id, chain_id, filename, hash, previous_hash
    summary: DataFrame  # per target: applied_count, total_committed, error_code


def apply_pending(
    changes: DataFrame,
    effects: DataFrame,
    state: DataFrame,
    applied: DataFrame,
    targets: DataFrame,
    bindings: DataFrame | None = None,
    chains: DataFrame | None = None,
) -> Applied:
    """Bring every sound target to the end of its chain; the others stay as they are.

    With ``bindings``, a pending change that uses an unbound name stops its target there
    (E36): the changes before it are applied, it and those after it are not. The gate is
    decided once and written down, so that the new state, the rows to record and the
    summary all speak of the same targets.
    """
    progress = cut_lineage(gated_progress(changes, applied, targets, chains), "progress")
    sound = progress.where(F.col("error_code").isNull())
    pending = pending_after(changes, sound)
    if bindings is None:
        writes = pending_writes(effects, pending)
    else:
        pending, progress = _up_to_unbound(changes, pending, progress, bindings)
        whole = pending.where("not stopped")
        # The effects are as many as the changes, whatever their files compress to: no broadcast.
        part = pending.where("stopped").join(effects.hint("merge"), ["chain_id", "version"])
        cut_off = part.groupBy(*TARGET, "key").agg(
            F.max("version").alias("version"), F.max_by("value", "version").alias("value")
        )
        writes = pending_writes(effects, whole).unionByName(cut_off)
    fresh = pending.select(*TARGET, "filename", "hash", "previous_hash")
    return Applied(
        state=overlay(state, writes),
        writes=writes,
        applied=fresh,
        summary=apply_summary(progress),
    )


def _up_to_unbound(
    changes: DataFrame, pending: DataFrame, progress: DataFrame, bindings: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Pending rows before the first one with an unbound name, and the progress with E36 set.

    Bodies are looked into once per change; what joins the pending rows are the few
    versions that fail.
    """
    texts = changes.select("chain_id", F.col("version").alias("script_id"), F.col("body").alias("text"))
    failing = unknown_placeholders(texts, bindings).select("chain_id", F.col("script_id").alias("version")).distinct()
    stops = pending.join(failing, ["chain_id", "version"]).groupBy(*TARGET).agg(F.min("version").alias("_stop"))
    stops = cut_lineage(stops, "stops")
    rows = pending.join(stops, TARGET, "left").where(F.col("_stop").isNull() | (F.col("version") < F.col("_stop")))
    rows = rows.withColumn("stopped", F.col("_stop").isNotNull()).drop("_stop")
    progress = progress.join(stops, TARGET, "left").select(
        *progress.columns[:-1],
        F.when(F.col("_stop").isNotNull(), "E36").otherwise(F.col("error_code")).alias("error_code"),
        (F.col("_stop") - 1).alias("_upto"),
    )
    return rows, progress


def apply_summary(progress: DataFrame) -> DataFrame:
    """Changes newly applied and changes committed, per target; none for a faulty one."""
    newly = F.when(F.col("error_code").isNull(), F.col("total_committed") - F.col("applied_count"))
    if "_upto" in progress.columns:
        newly = F.coalesce(F.col("_upto") - F.col("applied_count"), newly)
    return progress.select(
        *TARGET,
        F.coalesce(newly, F.lit(0)).alias("applied_count"),
        "total_committed",
        "error_code",
    )


def rebuild(
    changes: DataFrame, effects: DataFrame, targets: DataFrame, force: bool = False, chains: DataFrame | None = None
) -> Applied:
    """State and applied rows from nothing. The log is checked before anything is given up."""
    if not force:
        raise ValueError("E51 a rebuild replaces the targets; confirm it with force=True")
    none_applied = cut_lineage(
        targets.select(*TARGET)
        .join(checked_chains(changes) if chains is None else chains, "chain_id", "left")
        .select(
            *TARGET,
            F.lit(0).cast("bigint").alias("applied_count"),
            F.coalesce("total_committed", F.lit(0)).alias("total_committed"),
            F.col("chain_error").alias("error_code"),
        ),
        "progress",
    )
    sound = none_applied.where(F.col("error_code").isNull())
    state = rebuild_state(effects, sound)
    return Applied(
        state=state,
        writes=state,
        applied=pending_after(changes, sound).select(*TARGET, "filename", "hash", "previous_hash"),
        summary=apply_summary(none_applied),
    )


def run_candidate(applied: Applied, candidate_effects: DataFrame, failing: DataFrame) -> DataFrame:
    """State after the committed changes with the candidate on top.

    ``candidate_effects`` is ``(chain_id, key, value)``; chains in ``failing`` keep just
    their committed state. The candidate is never part of ``applied.applied``. Its writes
    carry the version it would get, one more than the chain has.
    """
    sound = applied.summary.where(F.col("error_code").isNull()).select(
        *TARGET, (F.col("total_committed") + 1).cast("int").alias("version")
    )
    writes = (
        candidate_effects.join(failing.select("chain_id").distinct(), "chain_id", "left_anti")
        .join(sound, "chain_id")
        .select(*TARGET, "key", "version", "value")
    )
    return overlay(applied.state, writes)


def run_compiled_candidate(
    applied: Applied, candidate_effects: DataFrame, candidates: DataFrame, fragments: DataFrame, bindings: DataFrame
) -> DataFrame:
    """As ``run_candidate``; which candidates cannot run is found by compiling them.

    A chain whose candidate has a faulty include or a placeholder without binding keeps its committed
    state, and so does one whose candidate is blank after compiling: there is nothing to run.
    """
    compiled = compile_scripts(candidates, fragments, bindings)
    runs = compiled.groupBy("chain_id").agg(
        F.min(F.col("error_code").isNull() & has_changes("compiled")).alias("runs")
    )
    idle = candidate_effects.select("chain_id").distinct().join(runs.where("runs"), "chain_id", "left_anti")
    return run_candidate(applied, candidate_effects, idle)


def shadow_verdicts(applied: Applied, effects: DataFrame) -> DataFrame:
    """Per chain, how many state rows a rebuild from nothing and the state at hand do not share.

    Both sides are signed and counted in one aggregation. Targets with an error were not brought
    up and are left out; a chain without a sound target has no row.
    """
    sound = cut_lineage(applied.summary.where(F.col("error_code").isNull()).select(*TARGET), "sound")
    held = applied.state.join(sound, TARGET, "left_semi")
    differing = rebuild_vs_incremental(held, rebuild_state(effects, sound))
    rows = differing.groupBy("chain_id").agg(F.sum(F.abs("balance")).alias("differing_rows"))
    return sound.select("chain_id").distinct().join(rows, "chain_id", "left").select(
        "chain_id", F.coalesce("differing_rows", F.lit(0)).cast("bigint").alias("differing_rows")
    )


def candidate_violations(
    changes: DataFrame, candidates: DataFrame, fragments: DataFrame, bindings: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Expanded candidates, and everything that would stop a clean rebuild plus candidate.

    The rebuild starts from nothing, so all committed bodies count, applied or not.
    """
    expanded, faults = expand_candidates(candidates, fragments)
    # Read by several checks and the caller; expanding is the costly part.
    expanded = cut_lineage(expanded.select("chain_id", to_lf("body").alias("body")), "expanded")

    includes = violation_rows(
        faults,
        code=F.col("error_code"),
        chain_id=F.col("chain_id"),
        filename=F.lit(CANDIDATE_PATH),
        detail=F.col("path"),
    )
    guard = expanded.select("chain_id", candidate_error("body").alias("error_code")).where(
        F.col("error_code").isNotNull()
    )
    guarded = violation_rows(
        guard,
        code=F.col("error_code"),
        chain_id=F.col("chain_id"),
        filename=F.lit(CANDIDATE_PATH),
    )
    scripts = expanded.select(
        "chain_id", F.lit(CANDIDATE_PATH).alias("script_id"), F.col("body").alias("text")
    ).unionByName(
        changes.select("chain_id", F.col("filename").alias("script_id"), F.col("body").alias("text"))
    )
    unbound = unknown_placeholders(scripts, bindings)
    placeholders = violation_rows(
        unbound,
        code=F.lit("E36"),
        chain_id=F.col("chain_id"),
        filename=F.col("script_id"),
        detail=F.col("name"),
    )
    found = (
        log_violations(changes)
        .unionByName(includes)
        .unionByName(guarded)
        .unionByName(placeholders)
    )
    return expanded, found


def state_violations(verdicts: DataFrame) -> DataFrame:
    """E43 of every chain with a differing state row; ``detail`` says how many there are."""
    return violation_rows(
        verdicts.where("differing_rows > 0"),
        code=F.lit("E43"),
        chain_id=F.col("chain_id"),
        detail=F.col("differing_rows"),
    )


def shadow_validation(
    changes: DataFrame,
    candidates: DataFrame,
    fragments: DataFrame,
    bindings: DataFrame,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Violations of a rebuild from nothing followed by the candidate, and of its state if ``verdicts`` are given."""
    found = candidate_violations(changes, candidates, fragments, bindings)[1]
    return found if verdicts is None else found.unionByName(state_violations(verdicts))


@dataclass
class Committed:
    """New change rows, and why the other candidates were not committed."""

    added: DataFrame
    violations: DataFrame


def commit_candidates(
    changes: DataFrame,
    candidates: DataFrame,
    fragments: DataFrame,
    bindings: DataFrame,
    verdicts: DataFrame | None = None,
) -> Committed:
    """Turn every sound candidate into the next change of its chain.

    Includes are expanded in the stored text; placeholders stay, to be filled in when the
    change is applied. With ``verdicts`` (``shadow_verdicts``) a chain whose state is not that of a
    rebuild from nothing is refused (E43).
    """
    expanded, found = candidate_violations(changes, candidates, fragments, bindings)
    if verdicts is not None:
        found = found.unionByName(state_violations(verdicts))
    versions = next_versions(changes)
    full = versions.where(F.col("error_code").isNotNull())
    found = cut_lineage(
        found.unionByName(
            violation_rows(full, code=F.col("error_code"), chain_id=F.col("chain_id"))
        ),
        "violations",
    )
    sound = expanded.join(found.select("chain_id").distinct(), "chain_id", "left_anti")
    heads = chain_heads(changes).select("chain_id", "head_hash")
    added = (
        sound.join(heads, "chain_id", "left")
        .join(versions.select("chain_id", "next_version"), "chain_id", "left")
        .select(
            "chain_id",
            F.coalesce("next_version", F.lit(1)).alias("version"),
            F.col("head_hash").alias("previous_hash"),
            link_hash("head_hash", "body").alias("hash"),
            normalize("body").alias("body"),
        )
        .withColumn("filename", version_filename("version"))
        .select("chain_id", "version", "filename", "previous_hash", "hash", "body")
    )
    return Committed(added, found)


def uncommit_latest(
    changes: DataFrame, applied: DataFrame, candidates: DataFrame, targets: DataFrame
) -> DataFrame:
    """Take the last change of each chain back into its candidate, or say why not.

    A change can only go back while the log is sound and no target has it. Rows without
    ``error_code`` carry the body to restore.
    """
    progress = target_progress(changes, applied, targets)
    per_chain = progress.groupBy("chain_id").agg(
        F.min("error_code").alias("history_error"),
        F.max(F.col("applied_count") == F.col("total_committed")).alias("is_applied"),
    )
    busy = candidates.select("chain_id", has_changes("body").alias("busy"))
    last = latest_change(changes).select("chain_id", "version", "filename", "body")
    code = (
        F.when(F.col("chain_error").isNotNull(), F.col("chain_error"))
        .when(F.col("filename").isNull(), "E40")
        .when(F.col("history_error").isNotNull(), F.col("history_error"))
        .when(F.col("is_applied"), "E41")
        .when(F.col("busy"), "E42")
    )
    return (
        last.join(busy, "chain_id", "full_outer")
        .join(per_chain, "chain_id", "left")
        .join(_chain_errors(changes), "chain_id", "left")
        .select(
            "chain_id",
            "version",
            "filename",
            code.alias("error_code"),
            F.when(code.isNull(), normalize("body")).alias("restored_body"),
        )
    )


def without_uncommitted(changes: DataFrame, uncommitted: DataFrame) -> DataFrame:
    """The log after ``uncommit_latest``."""
    gone = uncommitted.where(F.col("error_code").isNull()).select("chain_id", "version")
    return changes.join(gone, ["chain_id", "version"], "left_anti")


def rebuild_vs_incremental(incremental: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """State rows that only one of the two ways gives; none when both agree.

    Rows count +1 on one side and -1 on the other: one shuffle for both directions.
    """
    columns = [*TARGET, "key", "version", "value"]
    return (
        incremental.select(*columns, F.lit(1).alias("sign"))
        .unionByName(rebuilt.select(*columns, F.lit(-1).alias("sign")))
        .groupBy(*columns)
        .agg(F.sum("sign").alias("balance"))
        .where("balance <> 0")
    )


def replay_counts(state: DataFrame) -> DataFrame:
    """Rows in the state of each target."""
    return state.groupBy(*TARGET).agg(F.count("*").alias("n_rows"))
