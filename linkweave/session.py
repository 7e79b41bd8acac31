"""Session helpers: a local session for tests, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def local_session(cores: str = "8", name: str = "linkweave") -> SparkSession:
    """A ``local[cores]`` session; on a cluster use the session the cluster gives you."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkweave-"))
    return context.getCheckpointDir()


_scopes: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    path = f"{shared_dir(spark).rstrip('/')}/linkweave-{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what plans stored inside the scope; results must be used or written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Whatever executor is lost later, nothing has to be computed again; and later plans see
    a table with known size and prunable columns. zstd, because digits of hashes take twice the space in Spark's default.
    """
    return cut_and_count(df, label)[0]


def cut_and_count(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``cut_lineage``, with the number of rows, which the write counts on its way."""
    path = fresh_path(df.sparkSession, label)
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    return kept, rows.get["rows"]
