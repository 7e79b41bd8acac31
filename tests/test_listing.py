import os
import re

from linkweave.sources import files
from linkweave.sources.listing import project_files, project_folders, read_contents, stamps_below, tops_of_roots


def plan(df):
    return re.sub(r"[#@][0-9a-fA-F]+L?|plan_id=\d+", "", df._jdf.queryExecution().executedPlan().toString())


def put(root, path, data=b"x"):
    full = root / path
    full.parent.mkdir(parents=True, exist_ok=True)
    full.write_bytes(data)


def test_plan_does_not_grow_with_projects(spark, tmp_path):
    put(tmp_path, "1/committed/000001.sql")
    few = plan(files.scan_changes(spark, str(tmp_path)))
    for i in range(2, 2001):
        os.makedirs(tmp_path / str(i))
    put(tmp_path, "1999/committed/000001.sql", b"late")
    scanned = files.scan_changes(spark, str(tmp_path))
    assert plan(scanned) == few and "FileScan" not in few
    assert sorted((r.chain_id, r.text) for r in scanned.collect()) == [(1, "x"), (1999, "late")]
    assert project_folders(spark, str(tmp_path)).count() == 2000


def test_files_of_one_project_are_read_by_many_tasks(spark, tmp_path):
    for i in range(1, 401):
        put(tmp_path, f"7/committed/{i:06d}.sql", b"%d" % i)
    found = read_contents(project_files(project_folders(spark, str(tmp_path)), "committed", ".sql"))
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 4 and max(sizes) < 200


def test_names_that_are_seen_and_not(spark, tmp_path):
    put(tmp_path, "5/committed/.hidden.sql")
    put(tmp_path, "5/committed/_x.sql")
    put(tmp_path, "5/committed/.sql")
    put(tmp_path, "5/committed/a.SQL")
    put(tmp_path, "5/committed/ä b%20.sql", "ü".encode())
    put(tmp_path, "x5/committed/000001.sql")
    put(tmp_path, "99999999999999999999/committed/000001.sql")
    put(tmp_path, "6")
    put(tmp_path, "8/current.sql/part.sql")
    put(tmp_path, "8/fixtures")
    found = {(r.chain_id, r.filename, r.text) for r in files.scan_changes(spark, str(tmp_path)).collect()}
    assert found == {(5, ".hidden.sql", "x"), (5, "_x.sql", "x"), (5, "ä b%20.sql", "ü")}
    assert files.read_candidates(spark, str(tmp_path)).isEmpty() and files.scan_snippets(spark, str(tmp_path)).isEmpty()


def test_stamps_of_a_table_of_roots(spark, tmp_path):
    put(tmp_path, "a/1.sql", b"12")
    put(tmp_path, "a/deep/2.sql", b"")
    os.symlink(tmp_path / "a/1.sql", tmp_path / "a/link.sql")
    given = [(f"{tmp_path}/a", 1), (f"{tmp_path}/a", 2), (f"{tmp_path}/a/1.sql", 3), (f"{tmp_path}/none", 4), (None, 5)]
    roots = spark.createDataFrame(given, "root string, path int")
    found = sorted((r.snapshot_id, r.path, r["size"]) for r in files.scan_stamps_of(roots, 9).collect())
    assert found == [(9, f"{tmp_path}/a/1.sql", 2), (9, f"{tmp_path}/a/deep/2.sql", 0)]
    assert files.scan_stamps_of(roots.where("path > 3"), 9).isEmpty()


def test_stamps_are_listed_by_tasks_and_as_before(spark, tmp_path):
    """No file is known to the plan; hidden names, links, empty files and roots named twice count as Spark's file source counts them."""
    for i in range(300):
        put(tmp_path, f"{i}/committed/000001.sql", b"%d" % i)
    for name in ("5/.hidden", "5/_x/deep.sql", "5/_a=b", "5/_metadata", "5/_metadata.d/y", "5/x._COPYING_"):
        put(tmp_path, name)
    for name in ("5/_x/empty", "top", "6/ä b%20"):
        put(tmp_path, name, b"" if name == "5/_x/empty" else b"yy")
    os.symlink(tmp_path / "7", tmp_path / "linked")
    os.symlink(tmp_path / "5/_x/empty", tmp_path / "5/nothing")
    roots = [str(tmp_path), str(tmp_path), f"{tmp_path}/none"]
    stamps = files.scan_stamps(spark, roots, 1)
    assert "binaryFile" not in plan(stamps)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).where("length > 0")
    expected = [(r.path, int(r.modificationTime.timestamp() * 1000 + 0.5), r.length) for r in read.select("path", "modificationTime", "length").collect()]
    found = [(r.path, r.modified_ms, r["size"]) for r in stamps.collect()]
    assert sorted(r[::2] for r in found if r[2]) == sorted(r[::2] for r in 2 * expected) and len(expected) == 305
    assert {r[:2] for r in found if r[2]} == {r[:2] for r in expected}
    assert [(r[0], r[2]) for r in found if not r[2]] == [(f"file:{tmp_path}/5/_x/empty", 0)]
    from pyspark.sql import functions as F

    below = files.scan_stamps_of(spark.createDataFrame([(str(tmp_path),)], "root string"), 1)
    assert below.count() == 309 and "link" not in {r.path.rpartition("/")[2] for r in below.collect()}
    tasks = stamps_below(tops_of_roots(spark.createDataFrame([(str(tmp_path), True)], "root string, first boolean")))
    assert tasks.select(F.spark_partition_id()).distinct().count() > 4
