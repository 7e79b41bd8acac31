import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators.chain import build_chain
from linkweave.operators.snapshots import change_points
from linkweave.plans.lifecycle import apply_pending, rebuild
from linkweave.schemas import APPLIED_LOG, CHANGE_LOG, EFFECTS, STATE, TARGETS
from linkweave.sources.files import change_log, parse_changes
from linkweave.streaming.apply import CHANGE_EVENTS, ContinuousApply, stream_change_files
from linkweave.streaming.detect import ChangeDetector

STATES = "k long, n int, s string"


def write_files(spark, rows, schema, folder):
    """One file per list of rows, oldest first, so that each becomes a micro-batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")


def in_batches(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    parts = [
        [(1, 1, "a"), (1, 2, "a"), (2, 1, None)],
        [(1, 3, "a"), (2, 2, None), (2, 3, "x")],
        [(1, 4, "b"), (1, 5, "a")],
        [(3, 1, "c"), (1, 6, "a"), (2, 4, "x"), (2, 5, None)],
        [(1, 7, "b"), (2, 6, None)],
    ]
    write_files(spark, parts, STATES, f"{tmp_path}/in")
    schema = spark.createDataFrame([], STATES).schema
    detector = ChangeDetector(f"{tmp_path}/out", ["k"], ["n"], "s", fold_every=2)
    detector.start(in_batches(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/cp", True).awaitTermination()
    all_rows = spark.createDataFrame([r for p in parts for r in p], STATES)
    expected = change_points(all_rows, ["k"], ["n"], "s")
    key = lambda df: sorted(map(repr, (tuple(r) for r in df.select("k", "n", "s", "previous_state").collect())))
    assert key(detector.points(spark, schema)) == key(expected)

    # A rerun of the last batch writes the same rows again.
    detector.process(spark.createDataFrame(parts[4], STATES), 4)
    assert key(detector.points(spark, schema)) == key(expected)

    # Later files are picked up from the checkpoint.
    spark.createDataFrame([(3, 2, "c"), (3, 3, "d")], STATES).coalesce(1).write.parquet(f"{tmp_path}/in/009")
    detector.start(in_batches(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/cp", True).awaitTermination()
    more = detector.points(spark, schema).where("k = 3").collect()
    assert sorted((r.n, r.previous_state) for r in more) == [(1, None), (3, "c")]


def as_rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select("k", "n", "s", "previous_state").collect())))


@pytest.mark.parametrize("lateness,fold_every", [(None, 4), ("60", 2), ("25", 2)])
def test_rows_in_any_arrival(spark, tmp_path, lateness, fold_every):
    """Parts that overlap in time, repeated rows, null keys and times; late ones are dropped by the bound alone."""
    rng = random.Random(fold_every)
    rows = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(60)]), rng.choice(["a", "b", None])) for _ in range(150)]
    rows = [(k, n, f"{k}{n}" if n is None else "ab"[hash((k, n)) % 2]) for k, n, _ in rows]  # equal places, equal states
    parts = [rows[i::6] for i in range(6)] if lateness != "25" else [
        sorted(rows, key=lambda r: (r[1] or 0) + rng.randint(0, 30))[i * 25:(i + 1) * 25] for i in range(6)
    ]
    schema = spark.createDataFrame([], STATES).schema
    detector = ChangeDetector(f"{tmp_path}/out", ["k"], ["n"], "s", lateness, fold_every=fold_every)
    taken, latest, late = [], None, 0
    for i, part in enumerate(parts):
        for _ in range(2 if i in (2, 3) else 1):  # two are run again
            detector.process(spark.createDataFrame(part, STATES), i)
        ok = [r for r in part if lateness is None or latest is None or r[1] is None or r[1] >= latest - int(lateness)]
        late += len(part) - len(ok)
        taken += ok
        latest = max([latest if latest is not None else -1, *(r[1] for r in part if r[1] is not None)])
        expected = change_points(spark.createDataFrame(taken, STATES), ["k"], ["n"], "s")
        if i in (1, 5):
            assert as_rows(detector.points(spark, schema)) == as_rows(expected)
    assert detector.late_rows(spark, schema) == late and (late > 0) == (lateness == "25")


def test_a_silent_key_is_forgotten(spark, tmp_path):
    schema = spark.createDataFrame([], STATES).schema
    parts = [[(1, 1, "a"), (2, 1, "a")], [(2, 90, "a")], [(1, 95, "a"), (2, 95, "a")], [(1, 96, "a")]]
    found = {}
    for expiry in (None, "20"):
        detector = ChangeDetector(f"{tmp_path}/{expiry}", ["k"], ["n"], "s", "10", expiry, fold_every=1)
        for i, part in enumerate(parts):
            detector.process(spark.createDataFrame(part, STATES), i)
        found[expiry] = sorted((r.k, r.n) for r in detector.points(spark, schema).collect())
    assert found == {None: [(1, 1), (2, 1)], "20": [(1, 1), (1, 95), (2, 1)]}


def test_continuous_apply_takes_changes_in_any_order(spark, tmp_path):
    rows = [(c, v, f"select {v}") for c in (1, 2) for v in (1, 2, 3)]
    log = build_chain(spark.createDataFrame(rows, "chain_id long, version int, body string"))
    effects = spark.createDataFrame(
        [(c, v, "k" if v < 3 else "j", float(10 * c + v)) for c in (1, 2) for v in (1, 2, 3)], EFFECTS)
    events = [tuple(r) for r in log.join(effects, ["chain_id", "version"]).select(*CHANGE_EVENTS.fieldNames()).collect()]
    by = {(r[0], r[1]): r for r in events}
    parts = [[by[1, 1], by[2, 3]], [by[1, 2], by[2, 1]], [by[2, 2], by[1, 3]]]
    targets = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], TARGETS)
    job = ContinuousApply(f"{tmp_path}/out", targets)
    write_files(spark, parts, CHANGE_EVENTS, f"{tmp_path}/in")
    job.start(in_batches(spark, CHANGE_EVENTS, f"{tmp_path}/in"), f"{tmp_path}/cp", True).awaitTermination()

    def check():
        expected = rebuild(log, effects, targets, force=True)
        as_set = lambda df: sorted(map(tuple, df.select("target_id", "chain_id", "key", "version", "value").collect()))
        assert as_set(job.state(spark)) == as_set(expected.state)
        names = ["target_id", "chain_id", "filename", "hash"]
        assert sorted(map(tuple, job.applied(spark).select(*names).collect())) == sorted(
            map(tuple, expected.applied.select(*names).collect()))

    check()
    job.process(spark.createDataFrame(parts[2], CHANGE_EVENTS), 2)  # rerun after a crash
    check()


def events_of(spark, chains):
    """Change events of ``chains`` (id to length), one effect each, by chain and version."""
    rows = [(c, v, f"select {v}") for c, n in chains.items() for v in range(1, n + 1)]
    log = build_chain(spark.createDataFrame(rows, "chain_id long, version int, body string"))
    effects = [(c, v, f"k{v % 3}", float(100 * c + v)) for c, v, _ in rows]
    joined = log.join(spark.createDataFrame(effects, EFFECTS), ["chain_id", "version"]).select(*CHANGE_EVENTS.fieldNames())
    return {(r["chain_id"], r["version"]): tuple(r) for r in joined.collect()}


def compare_with_apply(spark, job, events, targets):
    """The rows that ``apply_pending`` gives over all events at once."""
    received = spark.createDataFrame(events, CHANGE_EVENTS)
    expected = apply_pending(
        received.select(*CHANGE_LOG.fieldNames()).distinct(), received.select(*EFFECTS.fieldNames()),
        spark.createDataFrame([], STATE), spark.createDataFrame([], APPLIED_LOG), targets,
    )
    for ours, theirs, names in (
        (job.state(spark), expected.state, ["target_id", "chain_id", "key", "version", "value"]),
        (job.applied(spark), expected.applied, ["target_id", "chain_id", "filename", "hash", "previous_hash"]),
    ):
        assert sorted(map(repr, ours.select(*names).collect())) == sorted(map(repr, theirs.select(*names).collect()))


def test_ten_batches_give_what_apply_pending_gives(spark, tmp_path):
    """Changes in any order, once more, one batch run again; chains that break, that keep a gap, that never start."""
    rng = random.Random(4)
    by = events_of(spark, {1: 25, 2: 9, 3: 6, 4: 4, 5: 5, 6: 1})
    bad = {  # before anything of the chain is linked, as apply_pending over everything decides
        (3, 1): (*by[3, 1][:4], "f" * 64, *by[3, 1][5:]),
        (4, 2): (*by[4, 2][:3], "e" * 64, *by[4, 2][4:]),
    }
    sent = [bad.get(k, e) for k, e in by.items() if k not in ((5, 1), (6, 1))]
    sent += rng.sample([e for k, e in by.items() if k[0] in (1, 2)], 12)
    sent.append((6, 1, "first.sql", None, by[6, 1][4], by[6, 1][5], "k", 1.0))
    rng.shuffle(sent)
    parts = [sent[i::10] for i in range(10)]
    targets = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 6), (70, 7)], TARGETS)
    job = ContinuousApply(f"{tmp_path}/out", targets, fold_every=4)
    for i, part in enumerate(parts):
        job.process(spark.createDataFrame(part, CHANGE_EVENTS), i)
        if i in (3, 6):
            job.process(spark.createDataFrame(part, CHANGE_EVENTS), i)  # a rerun, also of one that folds
    compare_with_apply(spark, job, sent, targets)
    ends = {r["chain_id"]: (r["links"], r["broken"], r["gap"]) for r in job.chains(spark, 10).collect()}
    assert ends == {1: (25, False, False), 2: (9, False, False), 3: (0, True, False), 4: (0, True, False), 5: (0, False, True), 6: (0, True, False)}


def test_a_batch_needs_no_history(spark, tmp_path):
    """What arrived in earlier batches is taken away; results are the same, and folders that are read stay few."""
    by = events_of(spark, {1: 6, 2: 6})
    targets = spark.createDataFrame([(10, 1), (20, 2)], TARGETS)
    job = ContinuousApply(f"{tmp_path}/out", targets, fold_every=2)
    for i in range(6):
        job.process(spark.createDataFrame([by[1, i + 1], by[2, i + 1]], CHANGE_EVENTS), i)
        if i:
            (tmp_path / f"out/arrived/batch={i - 1}").rename(tmp_path / f"gone{i}")
        if i >= 3:
            old = 2 * ((i + 1) // 2) - 3
            for kind in ("heads", "waiting", "writes", "served"):
                folder = tmp_path / f"out/kept/{kind}/added/batch={old}"
                if folder.exists():
                    folder.rename(tmp_path / f"gone-{kind}{i}")
    compare_with_apply(spark, job, list(by.values()), targets)


def test_a_new_target_and_a_changed_copy(spark, tmp_path):
    by = events_of(spark, {1: 6, 2: 6})
    one = spark.createDataFrame([(10, 1), (20, 2)], TARGETS)
    job = ContinuousApply(f"{tmp_path}/out", one)
    first = [by[c, v] for c in (1, 2) for v in (1, 2, 3)]
    job.process(spark.createDataFrame(first, CHANGE_EVENTS), 0)
    both = spark.createDataFrame([(10, 1), (20, 2), (11, 1), (21, 2)], TARGETS)
    job = ContinuousApply(f"{tmp_path}/out", both)
    changed = (*by[2, 2][:5], "select other", *by[2, 2][6:])
    job.process(spark.createDataFrame([by[1, 4], by[1, 2], changed, by[2, 4]], CHANGE_EVENTS), 1)
    counts = {r["target_id"]: r["count"] for r in job.applied(spark).groupBy("target_id").count().collect()}
    assert counts == {10: 4, 11: 4, 20: 3}  # 11 got all, 21 nothing: its chain is broken
    job.process(spark.createDataFrame([by[1, 5], by[1, 6], by[2, 5]], CHANGE_EVENTS), 2)
    whole = spark.createDataFrame([(10, 1), (11, 1)], TARGETS)
    state = sorted(map(tuple, job.state(spark).where("chain_id = 1").select("target_id", "chain_id", "key", "version", "value").collect()))
    log = spark.createDataFrame([by[1, v] for v in range(1, 7)], CHANGE_EVENTS)
    expected = rebuild(log.select(*CHANGE_LOG.fieldNames()), log.select(*EFFECTS.fieldNames()), whole, force=True).state
    assert state == sorted(map(tuple, expected.select("target_id", "chain_id", "key", "version", "value").collect()))


def test_new_change_files_arrive_once(spark, tmp_path):
    golden = "25f048318278a4e1670bffb6bdd9de29acec798dcb8e00bff69ac48ec3dfdb3c"
    folder = tmp_path / "p/7/committed"
    folder.mkdir(parents=True)
    (folder / "000001.sql").write_text(f"--! Hash: {golden}\n\nselect 1;\n")
    (folder / "readme.md").write_text("no")

    def run():
        stream = stream_change_files(spark, f"{tmp_path}/p")
        writer = stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        writer.format("parquet").start(f"{tmp_path}/seen").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/seen")

    log = change_log(parse_changes(run()))
    assert [tuple(r)[:5] for r in log.collect()] == [(7, 1, "000001.sql", None, golden)]
    (folder / "000002.sql").write_text("x")
    assert {r.filename for r in run().collect()} == {"000001.sql", "000002.sql"}


def test_change_files_are_listed_by_tasks_and_delivered_once(spark, tmp_path):
    golden = "25f048318278a4e1670bffb6bdd9de29acec798dcb8e00bff69ac48ec3dfdb3c"

    def put(name, text=f"--! Hash: {golden}\n\nselect 1;\n"):
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)

    def run():
        stream = stream_change_files(spark, f"{tmp_path}/p")
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert "linkweave_change_files" in plan and "binaryFile" not in plan
        writer = stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        writer.format("parquet").start(f"{tmp_path}/seen").awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/seen").select("chain_id", "filename").collect())

    for name in ("7/committed/.x.sql", "7/committed/_x.sql", "7/committed/a.SQL", "7/committed/deep/1.sql", "x7/committed/1.sql",
                 "99999999999999999999/committed/1.sql", "8/committed", "9/current.sql", "007/committed/000001.sql"):
        put(name)
    put("7/committed/000002.sql", "")
    for c in range(10, 60):
        put(f"{c}/committed/000001.sql")
    first = [(7, "000001.sql"), *((c, "000001.sql") for c in range(10, 60))]
    assert run() == first
    put("7/committed/000002.sql", "late text")  # was there before
    put("7/committed/000001.sql")
    put("11/committed/000002.sql", "x")
    assert run() == sorted([*first, (7, "000001.sql"), (11, "000002.sql")])
    assert run() == sorted([*first, (7, "000001.sql"), (11, "000002.sql")])


def test_waiting_changes_are_written_once(spark, tmp_path):
    """With the batch they come in and without their bodies, however long their chain waits; a base holds them too."""
    events = events_of(spark, {1: 5})
    targets = spark.createDataFrame([(10, 1)], TARGETS)
    job = ContinuousApply(f"{tmp_path}/out", targets, fold_every=2)
    for i, versions in enumerate([(1, 3), (5,), (2, 4)]):
        job.process(spark.createDataFrame([events[1, v] for v in versions], CHANGE_EVENTS), i)
    kept = [job._waiting.added(spark, i) for i in range(3)]
    assert [sorted(r.version for r in rows.collect()) for rows in kept] == [[1, 3], [5], []] and "body" not in kept[0].columns
    compare_with_apply(spark, job, list(events.values()), targets)
