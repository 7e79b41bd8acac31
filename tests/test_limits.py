"""Limits and damaged input: long chains, upper-case hashes, late rows, conflicting copies, stray folders."""

import os

import pytest
from pyspark.sql import functions as F

from linkweave.catalog.queries import QUERIES
from linkweave.functions.text import version_filename
from linkweave.operators.snapshots import snapshot_changes
from linkweave.operators import chain, history, includes, scripts, snapshots
from linkweave.operators.state import pending_writes
from linkweave.plans import lifecycle
from linkweave.plans.audit import log_violations
from linkweave.plans.lifecycle import apply_pending
from linkweave.session import cut_lineage, fresh_path, scratch
from linkweave.sources import files, tables
from linkweave.streaming.apply import CHANGE_EVENTS, ContinuousApply
from linkweave.streaming.detect import ChangeDetector


def test_names_end_at_six_digits(spark):
    numbers = spark.createDataFrame([(1,), (999_999,)], "v int").select(version_filename("v").alias("n"))
    assert [r["n"] for r in numbers.collect()] == ["000001.sql", "999999.sql"]
    with pytest.raises(Exception, match="E37"):
        spark.createDataFrame([(1_000_000,)], "v int").select(version_filename("v")).collect()


def _log(spark, bodies, upper=False):
    log = chain.build_chain(spark.createDataFrame(bodies, "chain_id bigint, version int, body string"))
    return log.withColumn("hash", F.upper("hash")) if upper else log


def test_upper_case_hashes_are_sound(spark):
    log = _log(spark, [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], upper=True)
    assert chain.broken_links(log).collect() == [] and log_violations(log).collect() == []
    head = chain.chain_heads(log).first()["head_hash"]
    assert head == head.lower()


def test_writes_follow_pending_versions(spark):
    effects = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0), (1, 3, "a", 3.0)], "chain_id bigint, version int, key string, value double")
    pending = spark.createDataFrame([(7, 1, 3), (8, 1, 2), (8, 1, 3), (9, 1, 1)], "target_id bigint, chain_id bigint, version int")
    found = {(r["target_id"], r["key"], r["version"]) for r in pending_writes(effects, pending).collect()}
    assert found == {(7, "a", 3), (8, "b", 2), (8, "a", 3)}


def test_unbound_name_stops_at_the_good_prefix(spark):
    log = _log(spark, [(1, 1, "a"), (1, 2, "b :S"), (1, 3, "c :NOPE"), (1, 4, "d")])
    effects = spark.createDataFrame([(1, v, f"k{v % 2}", float(v)) for v in range(1, 5)], "chain_id bigint, version int, key string, value double")
    targets = spark.createDataFrame([(5, 1), (6, 1)], "target_id bigint, chain_id bigint")
    done = log.where("version <= 3").selectExpr("6L as target_id", "chain_id", "filename", "hash", "previous_hash")
    empty = spark.createDataFrame([], "target_id bigint, chain_id bigint, key string, version int, value double")
    bindings = spark.createDataFrame([(1, "S", "x")], "chain_id bigint, name string, value string")
    result = apply_pending(log, effects, empty, done, targets, bindings)
    assert {(r["target_id"], r["key"], r["version"]) for r in result.state.collect()} == {(5, "k1", 1), (5, "k0", 2), (6, "k0", 4)}
    assert sorted((r["target_id"], r["filename"]) for r in result.applied.collect()) == [(5, "000001.sql"), (5, "000002.sql"), (6, "000004.sql")]
    assert {(r["target_id"], r["applied_count"], r["error_code"]) for r in result.summary.collect()} == {(5, 2, "E36"), (6, 1, None)}


def _detect(spark, kind, batches):
    detector = ChangeDetector(fresh_path(spark, "late"), ["k"], ["ts"], "s", "0", fold_every=2)
    schema = f"k bigint, ts bigint, s {kind}"
    for n, rows in enumerate(batches):
        detector.process(spark.createDataFrame([(1, *r) for r in rows], schema), n)
    points = detector.points(spark, spark.createDataFrame([], schema).schema)
    return sorted((r["ts"], r["s"], r["previous_state"]) for r in points.collect())


def test_late_rows_are_dropped(spark):
    found = _detect(spark, "string", [[(1, "a"), (5, "b")], [(3, "a")], [(6, "b")], [(7, "c"), (6, "x")]])
    assert found == [(1, "a", None), (5, "b", "a"), (7, "c", "b")]


def test_states_of_any_type(spark):
    assert _detect(spark, "bigint", [[(1, 10)], [(2, 10), (3, 11)]]) == [(1, 10, None), (3, 11, 10)]


@pytest.mark.parametrize("order", [0, 1])
def test_conflicting_copies_stop_a_chain(spark, order):
    log = _log(spark, [(1, 1, "a")]).first()
    rows = [(*log[:6], "key", 1.0), (*log[:5], "tampered\n", "key", 9.0)]
    job = ContinuousApply(fresh_path(spark, "conflict"), spark.createDataFrame([(5, 1)], "target_id bigint, chain_id bigint"))
    order_ = rows if order else rows[::-1]
    values = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in order_]
    names = log.__fields__
    frame = spark.createDataFrame([dict(zip([*names, "key", "value"], v)) for v in values], CHANGE_EVENTS)
    job.process(frame, 0)
    assert job.state(spark).collect() == [] and job.applied(spark).collect() == []


def test_stray_folders_and_numbers_in_the_root(spark, tmp_path):
    root = tmp_path / "12" / "committed"
    for name in ("3", "archive", "9" * 30):
        (root / name / "committed").mkdir(parents=True)
        (root / name / "committed" / "000001.sql").write_text("--! Previous: \n--! Hash: x\n\nselect 1;\n")
        (root / name / "current.sql").write_text("select 2;")
        (root / name / "fixtures" / "7" / "fixtures").mkdir(parents=True)
        (root / name / "fixtures" / "7" / "fixtures" / "a.sql").write_text("x")
    assert [r["chain_id"] for r in files.scan_changes(spark, str(root)).collect()] == [3]
    assert [r["chain_id"] for r in files.read_candidates(spark, str(root)).collect()] == [3]
    found = files.scan_snippets(spark, str(root)).collect()
    assert [(r["chain_id"], r["path"]) for r in found] == [(3, "fixtures/7/fixtures/a.sql")]


def test_repeated_bindings(spark):
    bindings = spark.createDataFrame(
        [(1, "A", "x"), (1, "A", "x"), (1, "B", "y"), (1, "B", "z"), (2, "C", None)], "chain_id bigint, name string, value string"
    )
    text = spark.createDataFrame([(1, "s", "select :A"), (1, "t", "select :B")], "chain_id bigint, script_id string, text string")
    found = {r["script_id"]: (r["rendered"], r["error_code"]) for r in scripts.render(text, bindings).collect()}
    assert found["s"] == ("select x", None) and found["t"][1] == "E36"
    assert [(r["name"], r["error_code"]) for r in scripts.repeated_bindings(bindings).collect()] == [("B", "E65")]


def test_recorded_names_and_hashes_are_unique(spark):
    tables.ensure_applied_log(spark, "guarded_log")
    kind = "target_id bigint, chain_id bigint, filename string, hash string, previous_hash string"
    first = spark.createDataFrame([(1, 1, "000001.sql", "a", None)], kind)
    assert tables.record_applied(first, "guarded_log").collect() == []
    more = spark.createDataFrame(
        [(1, 1, "000001.sql", "a", None), (1, 1, "000002.sql", "a", None), (1, 1, "000001.sql", "b", None), (1, 1, "000003.sql", "c", "a"),
         (2, 1, "000001.sql", "a", None), (3, 1, "000001.sql", "p", None), (3, 1, "000001.sql", "q", None)], kind
    )
    refused = {(r["target_id"], r["filename"], r["hash"], r["error_code"]) for r in tables.record_applied(more, "guarded_log").collect()}
    assert refused == {(1, "000002.sql", "a", "E18"), (1, "000001.sql", "b", "E17"), (3, "000001.sql", "p", "E17"), (3, "000001.sql", "q", "E17")}
    kept = {(r["target_id"], r["filename"]) for r in tables.read_applied(spark, "guarded_log").collect()}
    assert kept == {(1, "000001.sql"), (1, "000003.sql"), (2, "000001.sql")}


def test_snapshot_sequence(spark):
    stamps = [(1, "a", 1, 1), (1, "b", 1, 1), (2, "a", 1, 1), (2, "b", 1, 1), (5, "a", 2, 1), (5, "b", 1, 1), (5, "b", 1, 1), (6, "b", 1, 1)]
    frame = spark.createDataFrame(stamps, "snapshot_id bigint, path string, modified_ms bigint, size bigint")
    found = {r["snapshot_id"]: (r["appeared"], r["gone"]) for r in snapshots.snapshot_changes(frame).collect()}
    assert found == {1: (2, 0), 5: (2, 1), 6: (0, 2)}


def test_a_chain_with_very_many_targets_is_split(spark):
    log = _log(spark, [(c, 1, "a") for c in range(20)])
    targets = spark.range(100_000).selectExpr("id as target_id", "case when id < 95000 then 1L else id % 20 end as chain_id")
    applied = spark.createDataFrame([], "target_id bigint, chain_id bigint, filename string, hash string, previous_hash string")
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        stored = spark.read.parquet(_stored(spark, targets))
        progress = history.target_progress(log, applied, stored)
        assert progress.where("total_committed = 1 and applied_count = 0").count() == 100_000
        rows = progress.where("chain_id >= 0")
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in limits:
            spark.conf.unset(k)


def test_deep_includes_are_one_scan(spark):
    depth = 40
    kind = "chain_id bigint, path string, text string"
    parts = [(1, f"fixtures/{n}.sql", f"--! include {n + 1}.sql\nselect {n};\n") for n in range(depth)] + [(1, f"fixtures/{depth}.sql", "select 0;\n")]
    roots = spark.createDataFrame([(1, "current.sql", "--! include fixtures/0.sql\n")], "chain_id bigint, root string, text string")
    walk = includes.traverse(roots, spark.createDataFrame(parts, kind))
    assert walk.closure().count() == depth + 1 and walk.violations().count() == 0
    plan = walk.closure()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1


def test_scope_removes_what_was_stored(spark):
    outer = cut_lineage(spark.range(3))
    with scratch(spark):
        inner = cut_lineage(spark.range(5))
        path = inner.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert inner.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and outer.count() == 3


def _stored(spark, df):
    path = fresh_path(spark, "targets")
    df.write.parquet(path)
    return path


def test_snapshots_are_not_dealt_out_by_their_number(spark, tmp_path):
    """Three snapshots of many stamps: no shuffle that has three tasks' worth of keys carries the stamps."""
    stamps = spark.range(3000).selectExpr("id % 3 + 1 snapshot_id", "concat('a/', id div 3) path", "1L modified_ms", "if(id = 5, 2L, 1L) size")
    stamps.write.parquet(f"{tmp_path}/stamps")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the stamps' files are large
        found = snapshot_changes(spark.read.parquet(f"{tmp_path}/stamps"))
        assert "hashpartitioning(snapshot_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(1, 1000, 0), (3, 1, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_digests_are_shuffled_as_bytes(spark, tmp_path):
    """Log checks and histories; rows of one file name still stand in the order of their hashes as texts."""
    texts = ["0" * 64, "F" * 64, "f" * 64, "f" * 63, "", "zz", "Zz", "a" * 65, None, "9" * 64]
    spark.createDataFrame(
        [(1, 2, "000001.sql", t, texts[-i - 1]) for i, t in enumerate(texts)],
        "chain_id long, target_id long, filename string, hash string, previous_hash string",
    ).write.parquet(f"{tmp_path}/applied")
    applied = spark.read.parquet(f"{tmp_path}/applied")
    rows = [(1, v, "000001.sql", t, texts[-v - 1], "x\n") for v, t in list(enumerate(sorted(texts, key=lambda t: (t is not None, t)), 1))[:9]]
    changes = spark.createDataFrame(rows, "chain_id long, version int, filename string, hash string, previous_hash string, body string")
    compared = history.compare_histories(changes, applied)
    found = sorted((r.position, r.hash, r.previous_hash) for r in compared.select("position", "hash", "previous_hash").collect() if r.hash)
    order = sorted(texts, key=lambda t: (t is not None, t))
    assert [(p, h) for p, h, _ in found] == [(p, h) for p, h in enumerate(order, 1) if h]
    assert {(h, q) for _, h, q in found} == {(t, texts[-i - 1]) for i, t in enumerate(texts) if t}
    for df in (compared, log_violations(changes)):
        assert df._jdf.queryExecution().executedPlan().toString().count("unhex(") >= 2


def test_logs_and_histories_travel_once_to_be_placed(spark, tmp_path):
    """Copies are counted where rows are placed: one shuffle of the log, one of the applied rows before they meet the log."""
    log = cut_lineage(_log(spark, [(1, v, "b") for v in (1, 2, 3)]))
    applied = cut_lineage(log.withColumn("target_id", F.lit(7).cast("bigint")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        exchanges = [
            df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
            for df in (log_violations(log), history.compare_histories(log, applied.unionByName(applied)))
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert exchanges[0] == 1 and exchanges[1] <= 3


def test_a_chain_is_built_with_more_columns(spark):
    changes = spark.createDataFrame([(1, 2, "b", "k", 2.0), (1, 1, "a", None, None)], "chain_id long, version int, body string, key string, value double")
    built = chain.build_chain(changes, ["key", "value"])
    plain = chain.build_chain(changes)
    assert sorted(built.drop("key", "value").collect()) == sorted(plain.collect()) and built.columns[-2:] == ["key", "value"]
    assert {(r.version, r.key, r.value) for r in built.collect()} == {(1, None, None), (2, "k", 2.0)}


def test_histories_meet_the_log_by_one_digest(spark):
    """Where hashes are not asked for, neither side of the join has them; nulls and empty texts stay apart."""
    kept = [("a" * 64, None), ("b" * 64, ""), ("c" * 64, None), (None, "null"), ("e" * 64, "x")]
    log = spark.createDataFrame(
        [(1, v, f"{v:06}.sql", h, p, "b\n") for v, (h, p) in enumerate(kept, 1)],
        "chain_id long, version int, filename string, hash string, previous_hash string, body string",
    )
    held = [("a" * 64, None), ("b" * 64, None), ("c" * 64, ""), (None, None), ("e" * 64, "x"), ("f" * 64, "y")]
    applied = spark.createDataFrame(
        [(7, 1, f"{v:06}.sql", h, p) for v, (h, p) in enumerate(held, 1)],
        "target_id long, chain_id long, filename string, hash string, previous_hash string",
    )
    told = history.compare_histories(log, applied).select("position", "known", "same")
    assert sorted(map(tuple, told.collect())) == [
        (1, True, True), (2, True, False), (3, True, False), (4, True, False), (5, True, True), (6, False, False),
    ]

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    join = next(n for n in nodes(told._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join")
    for side in range(2):
        assert "hash#" not in join.children().apply(side).output().mkString(",")


def test_a_rebuild_and_a_replay_check_the_log_once(spark, tmp_path, monkeypatch):
    rows = [(10 * u + k, f"2024-01-01 00:00:{k:02}", u, "click" if k % 2 else "view", float(k), "{}") for u in (3, 4, 13) for k in range(6)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp")
    ).write.parquet(f"{tmp_path}/events.parquet")
    checks = []
    monkeypatch.setattr(lifecycle, "log_violations", lambda log: checks.append(1) or log_violations(log))
    differing = QUERIES["rebuild_vs_incremental"](spark, str(tmp_path)).collect()
    # The altered histories of chains 3 and 13 keep their first target at the three changes it had.
    assert {(r.target_id, r.chain_id) for r in differing} == {(9, 3), (39, 13)}
    assert len(checks) == 1
