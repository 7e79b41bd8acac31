import os
import uuid

import pytest
from pyspark.sql import functions as F

from linkweave.operators.chain import build_chain
from linkweave.plans.audit import log_violations
from linkweave.schemas import APPLIED_LOG, CANDIDATES
from linkweave.session import cut_lineage, fresh_path, shared_dir
from linkweave.sources import files, tables

GOLDEN = "25f048318278a4e1670bffb6bdd9de29acec798dcb8e00bff69ac48ec3dfdb3c"


@pytest.fixture()
def root(tmp_path):
    def put(path, data):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("1/committed/000001.sql", f"--! Previous: \n--! Hash: {GOLDEN}\n\nselect 1;\n")
    put("1/committed/notes.txt", "not a change")
    put("1/committed/old/000002.sql", "in a sub-folder")
    put("1/current.sql", "select 2;\n")
    put("1/fixtures/a.sql", "A")
    put("1/fixtures/shared/b.txt", "B")
    put("2/committed/1.sql", f"--! Hash: {GOLDEN}\n\nselect 1;\n")
    put("2/committed/000002.sql", b"\xff\xfe")
    put("2/committed/000003.sql", "select 1;")
    put("2/current.sql", "")
    put("2/committed/000004.sql", "")
    put("2/current/part.sql", "x")
    put("3/current.sql", "x")
    put("1/fixtures/empty", "")
    return tmp_path


def test_scan_and_parse(spark, root):
    parsed = files.parse_changes(files.scan_changes(spark, str(root)))
    assert {(r.chain_id, r.filename): r.error_code for r in parsed.collect()} == {
        (1, "000001.sql"): None, (2, "1.sql"): "E01", (2, "000002.sql"): "E02", (2, "000003.sql"): "E10",
        (2, "000004.sql"): "E10",
    }
    log = files.change_log(parsed)
    assert tuple(log.first()) == (1, 1, "000001.sql", None, GOLDEN, "select 1;\n")
    assert log_violations(log).isEmpty()
    assert files.parse_violations(parsed).count() == 4


def test_missing_folder_is_empty(spark, tmp_path):
    assert files.scan_changes(spark, str(tmp_path / "none")).isEmpty()


def test_candidates_and_snippets(spark, root):
    assert sorted(map(tuple, files.read_candidates(spark, str(root)).collect())) == [(1, "select 2;\n"), (2, ""), (3, "x")]
    assert sorted(map(tuple, files.scan_snippets(spark, str(root)).collect())) == [
        (1, "fixtures/a.sql", "A"), (1, "fixtures/empty", ""), (1, "fixtures/shared/b.txt", "B")]
    faults = files.folder_violations(spark, str(root)).collect()
    assert {(r.chain_id, r.filename, r.error_code) for r in faults} == {(2, "current", "E38"), (3, "committed", "E02")}


def test_stamps_see_edits_but_read_no_content(spark, root):
    stamps = files.scan_stamps(spark, [f"{root}/1/fixtures", f"{root}/1/current.sql"], 1)
    before = {os.path.basename(r.path): (r.modified_ms, r["size"]) for r in stamps.collect()}
    assert set(before) == {"a.sql", "b.txt", "current.sql", "empty"} and before["empty"][1] == 0 and before["a.sql"][1] == 1
    (root / "1/fixtures/a.sql").write_text("AA")
    after = {os.path.basename(r.path): r["size"] for r in files.scan_stamps(spark, [f"{root}/1/fixtures"], 2).collect()}
    assert after["a.sql"] == 2
    plan = stamps._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("content" not in line for line in schemas)


def test_written_changes_read_back(spark, tmp_path):
    rows = [(c, v, f"select {c}\n\nfrom {v};\n") for c in (1, 2) for v in (1, 2, 3)]
    log = build_chain(spark.createDataFrame(rows, "chain_id long, version int, body string"))
    files.write_changes(log, str(tmp_path / "out"))
    back = files.change_log(files.parse_changes(files.read_written_changes(spark, str(tmp_path / "out"))))
    assert sorted(map(repr, back.select(*log.columns).collect())) == sorted(map(repr, log.collect()))
    text = next((tmp_path / "out/chain_id=1/version=1").glob("part-*.txt")).read_text()
    assert text.endswith("select 1\n\nfrom 1;\n") and text.startswith("--! Previous: \n--! Hash: ")


def test_applied_log_table(spark):
    table = f"applied_{uuid.uuid4().hex}"
    assert not tables.log_exists(spark, table)
    assert tables.read_applied_if_present(spark, table).isEmpty()
    with pytest.raises(ValueError, match="E50"):
        tables.read_applied_if_present(spark, table, manage=False)
    with pytest.raises(ValueError, match="E50"):
        tables.ensure_applied_log(spark, table, manage=False)
    tables.ensure_applied_log(spark, table)
    tables.ensure_applied_log(spark, table, manage=False)
    rows = spark.createDataFrame(
        [(1, 1, "000001.sql", "h", None), (1, 1, "000001.sql", "h", None), (2, 1, "000001.sql", "h", None)],
        "target_id long, chain_id long, filename string, hash string, previous_hash string")
    tables.record_applied(rows, table)
    tables.record_applied(rows, table)
    got = tables.read_applied(spark, table)
    assert got.dtypes == [(f.name, f.dataType.simpleString()) for f in APPLIED_LOG.fields] and got.count() == 2
    assert got.where("applied_at is null").isEmpty()
    assert tables.applied_key_violations(got).isEmpty()
    spark.sql(f"INSERT INTO {table} (target_id, chain_id, filename, hash, previous_hash) VALUES (3, 1, 'f', 'h', null)")
    assert spark.table(table).where("target_id = 3 and applied_at is not null").count() == 1


def test_snapshots_are_published_last(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, "a")], CANDIDATES)
    assert tables.current(spark, root, "candidates", CANDIDATES).isEmpty()
    assert tables.publish(one, root, "candidates") == 1
    (tmp_path / "candidates/v=2-crashed").mkdir()
    assert [tuple(r) for r in tables.current(spark, root, "candidates", CANDIDATES).collect()] == [(1, "a")]
    old = tables.current(spark, root, "candidates", CANDIDATES)
    new = spark.createDataFrame([(1, "b"), (2, "c")], CANDIDATES)
    refused = tables.put_candidates(new, old, root)
    assert [tuple(r) for r in refused.collect()] == [(1, "E42")]
    latest = tables.current(spark, root, "candidates", CANDIDATES)
    assert sorted(map(tuple, latest.collect())) == [(1, "a"), (2, "c")]
    tables.put_candidates(spark.createDataFrame([(1, "")], CANDIDATES), latest, root)
    assert sorted(map(tuple, tables.current(spark, root, "candidates", CANDIDATES).collect())) == [(1, ""), (2, "c")]


def test_an_append_reads_the_touched_buckets(spark):
    table = "applied_buckets"
    tables.ensure_applied_log(spark, table)
    schema = "target_id long, chain_id long, filename string, hash string, previous_hash string"
    tables.record_applied(spark.createDataFrame([(c, c, "000001.sql", f"h{c}", None) for c in range(200)], schema), table)
    one = spark.createDataFrame([(7, 7, "000002.sql", "g", "h7"), (7, 7, "000001.sql", "h7", None)], schema)
    plan = tables.applied_of_chains(one, table)._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "bucket" in filters.split("PartitionFilters: [")[1].split("]")[0]
    read = tables.applied_of_chains(one, table)
    assert len(read.inputFiles()) < 10 and [r.hash for r in read.collect()] == ["h7"]
    assert tables.record_applied(one, table).isEmpty() and tables.read_applied(spark, table).count() == 201
    spark.sql(f"INSERT INTO {table} (target_id, chain_id, filename, hash) VALUES (7, 7, '000003.sql', 'by hand')")
    again = spark.createDataFrame([(7, 7, "000003.sql", "k", None), (7, 7, "000004.sql", "g", None)], schema)
    assert sorted((r.filename, r.error_code) for r in tables.record_applied(again, table).collect()) == [
        ("000003.sql", "E17"), ("000004.sql", "E18")]


def test_two_writers_lose_nothing(spark, tmp_path):
    """The second writer publishes between reading and publishing of the first; both edits are there afterwards."""
    root = str(tmp_path)
    tables.publish(spark.createDataFrame([(1, "")], CANDIDATES), root, "candidates")

    def with_row(chain_id, body, meanwhile=()):
        todo = list(meanwhile)

        def change(old):
            made = spark.createDataFrame([tuple(r) for r in old.collect()] + [(chain_id, body)], CANDIDATES)
            if todo:
                todo.pop()()
            return made

        return tables.update(spark, root, "candidates", CANDIDATES, change)

    assert with_row(2, "b", [lambda: with_row(3, "c"), lambda: with_row(4, "d")]) == 4
    latest = tables.current(spark, root, "candidates", CANDIDATES)
    assert sorted(map(tuple, latest.collect())) == [(1, ""), (2, "b"), (3, "c"), (4, "d")]
    with pytest.raises(tables.PublishConflict):
        tables.publish(latest, root, "candidates", base=3)
    assert not tables._claim(spark, root, "candidates", 4, "candidates/other")
    assert tables.edit_candidates(spark.createDataFrame([(1, "x"), (2, "y")], CANDIDATES), root).collect()[0]["chain_id"] == 2
    assert sorted(map(tuple, tables.current(spark, root, "candidates", CANDIDATES).collect())) == [(1, "x"), (2, "b"), (3, "c"), (4, "d")]


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)

    def write(i):
        return tables.update(
            spark, root, "candidates", CANDIDATES,
            lambda old: old.unionByName(spark.createDataFrame([(i, "x")], CANDIDATES)), attempts=50)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(6)))
    assert sorted(versions) == list(range(1, 7))
    assert sorted(r.chain_id for r in tables.current(spark, root, "candidates", CANDIDATES).collect()) == list(range(6))


def test_bindings_are_interpolated(spark, tmp_path):
    (tmp_path / "b.json").write_text(
        '{"chain_id": 1, "name": "A", "value": "${HOME_X:-d}/x"}\n{"chain_id": 1, "name": "B", "value": "${NOPE}"}\n')
    rows = tables.read_bindings(spark, str(tmp_path / "b.json"), variables={"HOME_X": ""}).collect()
    assert {r.name: (r.value, r.error_code) for r in rows} == {"A": ("/x", None), "B": (None, "E62")}


def test_identifiers(spark):
    names = spark.createDataFrame([("ok",), ("9",), (None,)], "name string")
    assert {r.name for r in tables.identifier_violations(names, "name").collect()} == {"9", None}


def test_cut_lineage_goes_through_the_shared_folder(spark):
    kept = cut_lineage(spark.range(5).withColumn("x", F.array("id")))
    assert kept.count() == 5 and "parquet" in kept._jdf.queryExecution().optimizedPlan().toString()
    assert all(shared_dir(spark).split("/")[-1] in f for f in kept.inputFiles())
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
