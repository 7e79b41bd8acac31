import pytest
from pyspark.sql import functions as F

from linkweave.operators.chain import build_chain
from linkweave.operators.history import pending_after
from linkweave.operators.state import evolve_union, pending_writes
from linkweave.plans import lifecycle
from linkweave.schemas import BINDINGS, CANDIDATES, CHANGE_LOG, EFFECTS, SNIPPETS, STATE, TARGETS
from linkweave.functions.headers import render_change
from tests.test_chain import links

BODY = "create table users (id integer primary key);"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, 1, BODY), (1, 2, "insert into :S.users values (1);"), (2, 1, "select 1;"), (3, 1, "a"), (3, 2, "b")]
    return build_chain(frame(spark, rows, "chain_id long, version int, body string"))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def commit(spark, log, candidates, snippets=(), bindings=()):
    result = lifecycle.commit_candidates(
        log, frame(spark, candidates, CANDIDATES), frame(spark, list(snippets), SNIPPETS),
        frame(spark, list(bindings), BINDINGS),
    )
    return result.added.collect(), {(r.chain_id, r.error_code) for r in result.violations.collect()}


def test_first_commit_renders_the_golden_text(spark):
    added, violations = commit(spark, empty(spark, CHANGE_LOG), [(1, BODY + "\r\n")])
    (previous, digest), = links([BODY])
    assert violations == set()
    assert tuple(added[0]) == (1, 1, "000001.sql", None, digest, BODY + "\n")
    rendered = frame(spark, added, CHANGE_LOG).select(
        render_change(F.col("previous_hash"), F.col("hash"), F.col("body")).alias("text"))
    assert rendered.first().text == f"--! Previous: \n--! Hash: {digest}\n\n{BODY}\n"


def test_commit_keeps_placeholders_and_expands_includes(spark, log):
    added, violations = commit(
        spark, log, [(1, "--! include fixtures/a.sql\nselect :S;")],
        [(1, "fixtures/a.sql", "use :S")], [(1, "S", "main")])
    assert violations == set()
    expected = links([BODY, "insert into :S.users values (1);", "use :S\nselect :S;"])[-1]
    assert tuple(added[0]) == (1, 3, "000003.sql", *expected, "use :S\nselect :S;\n")


def test_unsound_candidates_stay(spark, log):
    added, violations = commit(spark, log, [(1, "select 1"), (2, " \n"), (3, "x\n--! Hash: 1")])
    assert added == []
    assert violations == {(1, "E36"), (2, "E30"), (3, "E31")}


def test_broken_log_stops_the_commit(spark, log):
    broken = log.withColumn("body", F.when(F.col("chain_id") == 3, "z").otherwise(F.col("body")))
    added, violations = commit(spark, broken, [(2, "select 2"), (3, "select 2")], bindings=[(1, "S", "m")])
    assert [r.chain_id for r in added] == [2]
    assert violations == {(3, "E13")}


def test_commit_then_uncommit_gives_the_candidate_back(spark, log):
    targets = frame(spark, [(1, 1)], TARGETS)
    body = "select 7;\n"
    result = lifecycle.commit_candidates(
        log.where("chain_id = 1"), frame(spark, [(1, body)], CANDIDATES), empty(spark, SNIPPETS),
        frame(spark, [(1, "S", "m")], BINDINGS))
    longer = log.where("chain_id = 1").unionByName(result.added)
    back = lifecycle.uncommit_latest(
        longer, log.where("chain_id = 1").select(F.lit(1).cast("long").alias("target_id"), "chain_id", "filename", "hash", "previous_hash"),
        frame(spark, [(1, "")], CANDIDATES), targets)
    row = back.first()
    assert (row.error_code, row.filename, row.restored_body) == (None, "000003.sql", body)
    assert lifecycle.without_uncommitted(longer, back).count() == 2


def test_uncommit_refusals(spark, log):
    applied = log.where("chain_id = 2 or (chain_id = 3 and version = 1)").select(
        F.col("chain_id").alias("target_id"), "chain_id", "filename",
        F.when(F.col("chain_id") == 3, F.lit("b" * 64)).otherwise(F.col("hash")).alias("hash"), "previous_hash")
    targets = frame(spark, [(1, 1), (2, 2), (3, 3)], TARGETS)
    candidates = frame(spark, [(1, "busy"), (2, ""), (3, ""), (4, "")], CANDIDATES)
    got = lifecycle.uncommit_latest(log, applied, candidates, targets)
    assert {r.chain_id: (r.error_code, r.restored_body) for r in got.collect()} == {
        1: ("E42", None), 2: ("E41", None), 3: ("E21", None), 4: ("E40", None),
    }


def test_faulty_chain_has_no_status_and_no_uncommit(spark, log):
    broken = log.withColumn("body", F.when(F.col("version") == 2, "z").otherwise(F.col("body")))
    targets = frame(spark, [(1, 1), (2, 2)], TARGETS)
    candidates = frame(spark, [(1, ""), (2, "")], CANDIDATES)
    none = empty(spark, "target_id long, chain_id long, filename string, hash string, previous_hash string")
    status = lifecycle.fleet_status(broken, none, candidates, targets)
    assert {r.target_id: (r.code, r.error_code) for r in status.collect()} == {1: (None, "E13"), 2: (1, None)}
    back = lifecycle.uncommit_latest(broken, none, candidates, targets)
    assert {r.chain_id: r.error_code for r in back.collect()} == {1: "E13", 2: None, 3: "E13"}


@pytest.fixture(scope="module")
def effects(spark):
    return frame(spark, [(1, 1, "a", 1.0), (1, 2, "a", 2.0), (1, 2, "b", 3.0), (2, 1, "a", 4.0),
                         (3, 1, "a", 5.0), (3, 2, "b", 6.0)], EFFECTS)


def state_of(df):
    return {(r.target_id, r.key): (r.version, r.value) for r in df.collect()}


def test_apply_is_idempotent_and_equals_a_rebuild(spark, log, effects):
    targets = frame(spark, [(1, 1), (2, 2), (3, 3), (4, 3)], TARGETS)
    applied = log.where("chain_id = 3 and version = 1").select(
        F.lit(4).cast("long").alias("target_id"), "chain_id", "filename", "hash", "previous_hash")
    before = frame(spark, [(4, 3, "a", 1, 5.0)], STATE)
    once = lifecycle.apply_pending(log, effects, before, applied, targets)
    assert {r.target_id: (r.applied_count, r.total_committed) for r in once.summary.collect()} == {
        1: (2, 2), 2: (1, 1), 3: (2, 2), 4: (1, 2)}
    assert state_of(once.state) == {
        (1, "a"): (2, 2.0), (1, "b"): (2, 3.0), (2, "a"): (1, 4.0), (3, "a"): (1, 5.0), (3, "b"): (2, 6.0),
        (4, "a"): (1, 5.0), (4, "b"): (2, 6.0)}
    recorded = applied.unionByName(once.applied)
    twice = lifecycle.apply_pending(log, effects, once.state, recorded, targets)
    assert twice.applied.isEmpty()
    assert state_of(twice.state) == state_of(once.state)
    rebuilt = lifecycle.rebuild(log, effects, targets, force=True)
    assert lifecycle.rebuild_vs_incremental(twice.state, rebuilt.state).isEmpty()
    assert {r.target_id: r.n_rows for r in lifecycle.replay_counts(rebuilt.state).collect()} == {1: 2, 2: 1, 3: 2, 4: 2}


def test_tampered_target_and_chain_are_left_alone(spark, log, effects):
    targets = frame(spark, [(1, 1), (3, 3), (4, 3)], TARGETS)
    broken = log.withColumn("body", F.when(F.col("chain_id") == 1, "z").otherwise(F.col("body")))
    applied = log.where("chain_id = 3 and version = 1").select(
        F.lit(4).cast("long").alias("target_id"), "chain_id", "filename", F.lit("b" * 64).alias("hash"), "previous_hash")
    got = lifecycle.apply_pending(broken, effects, empty(spark, STATE), applied, targets)
    assert {r.target_id: (r.applied_count, r.error_code) for r in got.summary.collect()} == {
        1: (0, "E13"), 3: (2, None), 4: (0, "E21")}
    assert {k[0] for k in state_of(got.state)} == {3}
    assert {r.target_id for r in got.applied.collect()} == {3}


def test_rebuild_drops_rows_from_elsewhere_and_needs_force(spark, log, effects):
    targets = frame(spark, [(2, 2)], TARGETS)
    with pytest.raises(ValueError, match="E51"):
        lifecycle.rebuild(log, effects, targets)
    rebuilt = lifecycle.rebuild(log, effects, targets, force=True)
    outside = frame(spark, [(2, 2, "alien", 0, 1.0)], STATE)
    diff = lifecycle.rebuild_vs_incremental(rebuilt.state.unionByName(outside.select(*rebuilt.state.columns)), rebuilt.state)
    assert [r.key for r in diff.collect()] == ["alien"]
    assert state_of(rebuilt.state) == {(2, "a"): (1, 4.0)}


def test_candidate_runs_on_top_and_is_not_recorded(spark, log, effects):
    targets = frame(spark, [(1, 1), (2, 2)], TARGETS)
    base = lifecycle.apply_pending(
        log, effects, empty(spark, STATE), empty(spark, "target_id long, chain_id long, filename string, hash string, previous_hash string"), targets)
    candidate = frame(spark, [(1, "a", 9.0), (2, "z", 8.0)], "chain_id long, key string, value double")
    failing = frame(spark, [(2, "bad")], "chain_id long, why string")
    preview = state_of(lifecycle.run_candidate(base, candidate, failing))
    assert preview[(1, "a")] == (3, 9.0) and preview[(1, "b")] == (2, 3.0)
    assert (2, "z") not in preview and preview[(2, "a")] == (1, 4.0)
    assert {r.filename for r in base.applied.collect()} == {"000001.sql", "000002.sql"}


def test_shadow_validation_covers_applied_bodies_too(spark, log):
    found = lifecycle.shadow_validation(
        log, frame(spark, [(1, "select :T")], CANDIDATES), empty(spark, SNIPPETS), empty(spark, BINDINGS))
    assert {(r.chain_id, r.filename, r.error_code, r.detail) for r in found.collect()} == {
        (1, "000002.sql", "E36", "S"), (1, "current.sql", "E36", "T")}


def test_evolving_columns(spark):
    one = frame(spark, [(1,)], "id int")
    two = frame(spark, [(2, "m")], "id int, mail string")
    assert sorted(map(tuple, evolve_union(one, two).collect())) == [(1, None), (2, "m")]


def test_altered_state_is_refused(spark, log):
    """A state that is not that of a rebuild stops the commit of its chain, and only of that."""
    effects = frame(spark, [(1, 1, "a", 1.0), (1, 2, "b", 2.0), (2, 1, "a", 4.0)], EFFECTS)
    targets = frame(spark, [(10, 1), (20, 2)], TARGETS)
    history = "target_id long, chain_id long, filename string, hash string, previous_hash string"
    done = lifecycle.apply_pending(log, effects, empty(spark, STATE), empty(spark, history), targets)
    bound = frame(spark, [(c, n, "x") for c in (1, 2) for n in ("S", "T")], BINDINGS)
    for change, refused in ((0.0, set()), (0.5, {(1, "E43", "2")})):
        held = done.state.withColumn("value", F.col("value") + F.when(F.col("key") == "b", change).otherwise(0.0))
        verdicts = lifecycle.shadow_verdicts(lifecycle.Applied(held, done.writes, done.applied, done.summary), effects)
        got = lifecycle.commit_candidates(
            log, frame(spark, [(1, "select 1"), (2, "select 2")], CANDIDATES), empty(spark, SNIPPETS), bound, verdicts)
        assert {(r.chain_id, r.error_code, r.detail) for r in got.violations.collect()} == refused
        assert {r.chain_id for r in got.added.collect()} == {1, 2} - {c for c, _, _ in refused}


def test_candidates_run_only_if_they_compile(spark, log):
    effects = frame(spark, [(1, 1, "a", 1.0), (2, 1, "a", 4.0)], EFFECTS)
    targets = frame(spark, [(10, 1), (20, 2)], TARGETS)
    history = "target_id long, chain_id long, filename string, hash string, previous_hash string"
    done = lifecycle.apply_pending(log, effects, empty(spark, STATE), empty(spark, history), targets)
    writes = frame(spark, [(1, "a", 9.0), (2, "a", 8.0)], "chain_id long, key string, value double")
    for body, runs in (("select :S", True), ("select :NOPE", False), ("--! include fixtures/none.sql", False), (" \n", False)):
        got = lifecycle.run_compiled_candidate(
            done, writes, frame(spark, [(1, body)], CANDIDATES), empty(spark, SNIPPETS), frame(spark, [(1, "S", "x")], BINDINGS))
        values = {(r.chain_id, r.key): r.value for r in got.collect()}
        assert values == {(1, "a"): 9.0 if runs else 1.0, (2, "a"): 4.0}


def test_written_out_versions_are_not_broadcast(spark, tmp_path):
    """A stored table of few targets is small, the versions that are written out of it need not be."""
    bodies = spark.range(20).select(F.col("id").alias("chain_id"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("version"), F.lit("x").alias("body"))
    build_chain(bodies).write.parquet(f"{tmp_path}/log")
    spark.range(20).selectExpr("id + 100 target_id", "id chain_id", "id applied_count", "50L total_committed").write.parquet(f"{tmp_path}/progress")
    log, progress = spark.read.parquet(f"{tmp_path}/log"), spark.read.parquet(f"{tmp_path}/progress")
    pending = pending_after(log, progress)
    effects = log.select("chain_id", "version", F.lit("k").alias("key"), F.lit(1.0).alias("value"))
    for found in (pending, pending_writes(effects, pending)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert pending.count() == 20 * 50 - 190 and pending_writes(effects, pending).count() == 20
    expected = {(c, v, h) for c, v, h in log.select("chain_id", "version", "hash").collect() if v > c}
    assert {(r.chain_id, r.version, r.hash) for r in pending.collect()} == expected
