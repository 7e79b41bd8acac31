import pytest
from pyspark.sql import functions as F

from linkweave.operators.chain import build_chain
from linkweave.sources import committed
from linkweave.sources.committed import CommitRefused, commit_changes, recover_commits
from linkweave.sources.files import change_log, parse_changes, scan_changes


@pytest.fixture(scope="module")
def log(spark):
    rows = [(c, v, f"select {c}, {v}") for c in range(5) for v in range(1, 4)]
    return build_chain(spark.createDataFrame(rows, "chain_id long, version int, body string")).persist()


def rows(df):
    return sorted(map(repr, df.select("chain_id", "version", "filename", "previous_hash", "hash", "body").collect()))


def all_paths(root):
    return sorted(p for p in root.rglob("*"))


def test_written_files_are_read_back(spark, log, tmp_path):
    root = f"file://{tmp_path}"
    assert commit_changes(log.where("version < 3"), root) == 10
    assert commit_changes(log, root) == 15  # the same texts once more do no harm
    assert rows(change_log(parse_changes(scan_changes(spark, root)))) == rows(log)
    assert not (tmp_path / "_staging").exists() and len(list(tmp_path.rglob("*.sql"))) == 15
    assert commit_changes(log.limit(0), root) == 0


def test_a_failing_job_leaves_nothing(spark, log, tmp_path):
    broken = log.withColumn("body", F.when(F.col("chain_id") == 4, F.raise_error(F.lit("broken on purpose"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="broken on purpose"):
        commit_changes(broken.repartition(5, "chain_id"), f"file://{tmp_path}")
    assert all_paths(tmp_path) == []


def test_another_text_is_refused_as_a_whole(spark, log, tmp_path):
    root = f"file://{tmp_path}"
    commit_changes(log.where("chain_id = 1"), root)
    before = {p: p.read_bytes() for p in tmp_path.rglob("*.sql")}
    other = log.withColumn("body", F.when((F.col("chain_id") == 1) & (F.col("version") == 2), "other\n").otherwise(F.col("body")))
    with pytest.raises(CommitRefused, match="1/committed/000002.sql"):
        commit_changes(other, root)
    assert {p: p.read_bytes() for p in tmp_path.rglob("*.sql")} == before and not (tmp_path / "_staging").exists()


def test_a_lost_driver(spark, log, tmp_path, monkeypatch):
    """Lost after the ready mark the commit is finished later, lost before it is taken back."""
    root = f"file://{tmp_path}"

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(committed, "_move", lost)
        with pytest.raises(RuntimeError):
            commit_changes(log, root)
    assert change_log(parse_changes(scan_changes(spark, root))).isEmpty()
    unready = tmp_path / "_staging/dead/7/committed"
    unready.mkdir(parents=True)
    (unready / "000001.sql").write_text("half")
    assert recover_commits(spark, root) == 1 and recover_commits(spark, root) == 0
    assert rows(change_log(parse_changes(scan_changes(spark, root)))) == rows(log) and not (tmp_path / "_staging").exists()
