import pytest
from pyspark.sql import functions as F

from linkweave.operators import history
from linkweave.operators.chain import build_chain
from linkweave.plans import lifecycle
from linkweave.plans.audit import audit, key_violations
from linkweave.schemas import TARGETS


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, v, f"select {v};") for v in (1, 2, 3)] + [(2, 1, "select 9;")]
    return build_chain(spark.createDataFrame(rows, "chain_id long, version int, body string"))


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(10, 1), (11, 1), (12, 1), (20, 2), (21, 2)], TARGETS)


def applied_rows(log, counts):
    """Applied prefixes: ``{target: (chain, count)}``."""
    parts = [
        log.where((F.col("chain_id") == chain) & (F.col("version") <= n)).select(
            F.lit(target).cast("bigint").alias("target_id"), "chain_id", "filename", "hash", "previous_hash")
        for target, (chain, n) in counts.items()
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def tamper(applied, target, filename, column, value):
    hit = (F.col("target_id") == target) & (F.col("filename") == filename)
    return applied.withColumn(column, F.when(hit, value).otherwise(F.col(column)))


def found(rows):
    return {r.target_id: (r.error_code, r.diverged_filename) for r in rows.collect()}


COUNTS = {10: (1, 2), 11: (1, 3), 20: (2, 1)}


def test_prefixes_hold(log):
    assert found(history.history_divergence(log, applied_rows(log, COUNTS))) == {}


@pytest.mark.parametrize("column, value", [
    ("hash", "b" * 64), ("previous_hash", None), ("filename", "000002.sq"),
])
def test_first_difference_is_reported(log, column, value):
    changed = tamper(applied_rows(log, COUNTS), 11, "000002.sql", column, F.lit(value))
    changed = tamper(changed, 11, "000003.sql", "hash", F.lit("c" * 64))
    name = value if column == "filename" else "000002.sql"
    assert found(history.history_divergence(log, changed)) == {11: ("E21", name)}


def test_hole_in_the_applied_history(log):
    holed = applied_rows(log, COUNTS).where("not (target_id = 11 and filename = '000001.sql')")
    assert found(history.history_divergence(log, holed)) == {11: ("E21", "000002.sql")}


def test_copies_in_the_applied_history(log):
    rows = applied_rows(log, {10: (1, 2), 11: (1, 3)})
    doubled = rows.unionByName(rows.where("filename = '000001.sql'"))
    got = {r.target_id: (r.error_code, r.diverged_position, r.applied_count)
           for r in history.history_divergence(log, doubled).collect()}
    assert got == {10: ("E21", 2, 3), 11: ("E20", 2, 4)}


def test_longer_than_committed_comes_before_differences(log):
    changed = tamper(applied_rows(log, COUNTS), 11, "000001.sql", "hash", F.lit("b" * 64))
    shorter = log.where("not (chain_id = 1 and version > 2)")
    assert found(history.history_divergence(shorter, changed))[11][0] == "E20"
    orphans = history.orphan_applied(shorter, changed)
    assert {(r.target_id, r.filename) for r in orphans.collect()} == {(11, "000003.sql")}


def test_pending_is_the_rest_of_sound_histories(log, targets):
    applied = tamper(applied_rows(log, {10: (1, 2), 11: (1, 1)}), 11, "000001.sql", "hash", F.lit("b" * 64))
    pending = history.pending_changes(log, applied, targets)
    assert sorted((r.target_id, r.version) for r in pending.collect()) == [
        (10, 3), (12, 1), (12, 2), (12, 3), (20, 1), (21, 1),
    ]
    by_offset = history.pending_by_offset(log, applied, targets)
    assert sorted((r.target_id, r.version) for r in by_offset.collect() if r.target_id == 11) == [(11, 2), (11, 3)]


def test_status_codes(spark, log, targets):
    candidates = spark.createDataFrame([(1, " \n"), (2, "-- note")], "chain_id long, body string")
    applied = tamper(applied_rows(log, {10: (1, 3), 11: (1, 1), 12: (1, 1), 20: (2, 1)}), 12, "000001.sql", "hash", F.lit("b" * 64))
    status = lifecycle.fleet_status(log, applied, candidates, targets)
    assert {r.target_id: (r.code, r.error_code) for r in status.collect()} == {
        10: (0, None), 11: (1, None), 12: (None, "E21"), 20: (2, None), 21: (3, None),
    }


def test_audit_joins_everything(log):
    edited = log.withColumn("body", F.when(F.col("version") == 3, "x").otherwise(F.col("body")))
    changed = tamper(applied_rows(log, COUNTS), 20, "000001.sql", "previous_hash", F.lit("b" * 64))
    rows = {(r.chain_id, r.target_id, r.version, r.error_code) for r in audit(edited, changed).collect()}
    assert rows == {(1, None, 3, "E13"), (2, 20, 1, "E21")}


def test_keys(log):
    once = applied_rows(log, COUNTS)
    assert key_violations(once).isEmpty()
    twice = once.unionByName(once.where("target_id = 20"))
    assert sorted(r.error_code for r in key_violations(twice).collect()) == ["E17", "E18"]
    missing = tamper(once, 20, "000001.sql", "hash", F.lit(None))
    assert [r.error_code for r in key_violations(missing).collect()] == ["E19"]
