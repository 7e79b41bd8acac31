import os

from linkweave.streaming.watch import FileWatcher, file_stamps


def test_new_edited_and_empty_files_arrive_once(spark, tmp_path):
    one, two = tmp_path / "a/1", tmp_path / "b"
    (one / "committed").mkdir(parents=True)
    two.mkdir()
    (one / "current.sql").write_text("select 1;")
    (one / "committed/000001.sql").write_text("")
    (two / "x.sql").write_text("x")
    os.symlink(two / "x.sql", one / "link.sql")
    os.symlink(two, one / "folder")
    roots = f"{tmp_path}/roots"
    given = [(str(one),), (str(two),), (str(two / "x.sql"),), (f"{tmp_path}/none",)]
    spark.createDataFrame(given, "root string").repartition(2).write.parquet(roots)
    watcher = FileWatcher(f"{tmp_path}/out", roots, fold_every=2)

    def poll():
        watcher.start(spark, f"{tmp_path}/cp", available_now=True).awaitTermination()
        return sorted((r.path[len(str(tmp_path)) + 1:], bytes(r.content), r.size) for r in watcher.files(spark).collect())

    first = [("a/1/committed/000001.sql", b"", 0), ("a/1/current.sql", b"select 1;", 9), ("b/x.sql", b"x", 1)]
    assert poll() == first
    assert poll() == first  # nothing differs, nothing comes
    (one / "current.sql").write_text("select 22;")
    (one / "committed/000001.sql").write_text("now")
    (two / "y.sql").write_text("")
    edited = sorted([*first, ("a/1/current.sql", b"select 22;", 10), ("a/1/committed/000001.sql", b"now", 3), ("b/y.sql", b"", 0)])
    assert poll() == edited
    os.utime(two / "x.sql", (1, 1))  # only the time differs
    assert poll() == sorted([*edited, ("b/x.sql", b"x", 1)])


def test_stamps_of_a_file_a_folder_and_nothing(tmp_path):
    (tmp_path / "f").write_bytes(b"12")
    assert [(p, s) for p, _, s in file_stamps(str(tmp_path / "f"))] == [(str(tmp_path / "f"), 2)]
    assert len(list(file_stamps(str(tmp_path)))) == 1 and list(file_stamps(str(tmp_path / "none"))) == []
