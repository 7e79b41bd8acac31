"""Applied logs, candidate and state snapshots, and bindings as tables.

Parquet tables know no primary keys and no transaction over two tables. Keys are kept by
guarded appends, and results are published in an order that a crash cannot spoil: data
first, in a folder nobody reads yet, then the row that makes it count.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from linkweave.functions.templates import interpolate
from linkweave.functions.text import has_changes, is_identifier
from linkweave.operators.violations import uniqueness_violations
from linkweave.schemas import APPLIED_LOG, BINDINGS, CANDIDATES
from linkweave.session import cut_lineage

_APPLIED_KEY = ["target_id", "chain_id", "filename"]
# Partitions of the applied log; fixed for the life of a log.
LOG_BUCKETS = 64
_BUCKET = "bucket"
# How often a version file that is still empty is looked at.
_LOOKS = 50


def log_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def applied_bucket(chain_id: Column | str) -> Column:
    """The bucket of the applied log that the rows of a chain are in."""
    return F.pmod(F.xxhash64(chain_id), F.lit(LOG_BUCKETS)).cast("int")


def ensure_applied_log(spark: SparkSession, table: str, manage: bool = True) -> None:
    """Create the applied log if it may be managed; otherwise it has to be there (E50).

    It is partitioned by a bucket of the chain, so that an append reads the buckets it touches only.
    """
    if log_exists(spark, table):
        return
    if not manage:
        raise ValueError(f"E50 applied log {table} is missing and is not managed")
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}"
        + (" DEFAULT current_timestamp()" if f.name == "applied_at" else "")
        for f in APPLIED_LOG.fields
    )
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, {_BUCKET} INT) USING parquet PARTITIONED BY ({_BUCKET})")


def read_applied(spark: SparkSession, table: str) -> DataFrame:
    """The applied log. Rows carry their order in ``filename``; sort where it is shown."""
    return spark.table(table).select(*APPLIED_LOG.fieldNames())


def read_applied_if_present(spark: SparkSession, table: str, manage: bool = True) -> DataFrame:
    """As ``read_applied``; a missing log is empty if managed, else an error (E50)."""
    if log_exists(spark, table):
        return read_applied(spark, table)
    if not manage:
        raise ValueError(f"E50 applied log {table} is missing and is not managed")
    return spark.createDataFrame([], APPLIED_LOG)


def applied_of_chains(pending: DataFrame, table: str) -> DataFrame:
    """Applied rows of the chains in ``pending``, from their buckets alone.

    The touched buckets, ``LOG_BUCKETS`` numbers at most, come to the driver and prune the scan. Rows that
    were put in without a bucket, and logs that have none, are read as well.
    """
    spark = pending.sparkSession
    log, chains = spark.table(table), pending.select("chain_id").distinct()
    if _BUCKET in log.columns:
        touched = [row[0] for row in chains.select(applied_bucket("chain_id")).distinct().collect()]
        log = log.where(F.col(_BUCKET).isin(touched) | F.col(_BUCKET).isNull())
    return log.join(chains, "chain_id", "left_semi").select(*APPLIED_LOG.fieldNames())


def record_applied(pending: DataFrame, table: str) -> DataFrame:
    """Append applied rows that are not recorded yet; a repeated call adds nothing.

    File name and hash are unique in the history of a target's chain. Rows that would break
    this, among themselves or against the log, are not recorded but returned (E17, E18). Of the log, only
    the buckets of the pending chains are read, once.
    """
    spark = pending.sparkSession
    columns, scope = [*_APPLIED_KEY, "hash", "previous_hash"], ["target_id", "chain_id"]
    pending = cut_lineage(pending.select(*columns), "pending")
    known = applied_of_chains(pending, table)
    rows = pending.withColumn("_new", F.lit(True)).unionByName(known.select(*columns).withColumn("_new", F.lit(False)))
    rows = rows.groupBy(*columns).agg(F.max("_new").alias("_new"), F.sum(F.when(F.col("_new"), 0).otherwise(1)).alias("_known"))
    same = Window.partitionBy(*scope, "filename", "hash")
    rows = rows.withColumn("_fresh", F.col("_new") & (F.max("_known").over(same) == 0))
    size = F.col("_known") + F.col("_fresh").cast("int")
    for key, code in (("filename", "E17"), ("hash", "E18")):
        rows = rows.withColumn(f"_{code}", F.sum(size).over(Window.partitionBy(*scope, key)) > 1)
    code = F.when(F.col("_E17"), "E17").when(F.col("_E18"), "E18")
    fresh = cut_lineage(rows.where("_fresh").select(*columns, code.alias("error_code")), "fresh")
    sound = fresh.where(F.col("error_code").isNull()).withColumn("applied_at", F.current_timestamp())
    names = APPLIED_LOG.fieldNames()
    if _BUCKET in spark.table(table).columns:
        # One file per bucket and append, not one per bucket and task.
        sound = sound.withColumn(_BUCKET, applied_bucket("chain_id")).repartition(_BUCKET)
        names = [*names, _BUCKET]
    sound.select(*names).write.insertInto(table)
    return fresh.where(F.col("error_code").isNotNull())


def applied_key_violations(applied: DataFrame) -> DataFrame:
    """File names and hashes that are missing or repeated within one target's chain."""
    return uniqueness_violations(applied, ["target_id", "chain_id"], ["filename", "hash"])


class PublishConflict(RuntimeError):
    """Someone else published the version that was to be next."""


def _versions(spark: SparkSession, root: str, name: str):
    """File system and folder of the version files of a table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _latest(spark: SparkSession, root: str, name: str) -> tuple[int, str | None]:
    files, folder = _versions(spark, root, name)
    if not files.exists(folder):
        return 0, None
    numbers = [int(status.getPath().getName()) for status in files.listStatus(folder) if status.getPath().getName().isdigit()]
    if not numbers:
        return 0, None
    for _ in range(_LOOKS):
        row = spark.read.text(f"{root}/_versions/{name}/{max(numbers):020}").first()
        if row is not None:
            return max(numbers), f"{root}/{row['value']}"
        time.sleep(0.1)  # its writer made the file and is about to fill it
    raise PublishConflict(f"version {max(numbers)} of {name} was claimed but names no data; remove its file")


def _claim(spark: SparkSession, root: str, name: str, version: int, folder: str) -> bool:
    """Create the file that makes ``folder`` the given version; false if that version is there."""
    files, path = _versions(spark, root, name)
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{version:020}")
    try:
        out = files.create(file, False)
    except Py4JJavaError:
        if files.exists(file):
            return False
        raise
    out.write(bytearray(folder.encode()))
    out.close()
    return True


def publish(df: DataFrame, root: str, name: str, base: int | None = None) -> int:
    """Write a new snapshot of table ``name`` and make it the current one; gives its version.

    The data come first, in a folder nobody reads yet, then a version file that is created only if it is
    not there. With ``base``, the version ``df`` was made from, a snapshot that came between is a
    ``PublishConflict`` and nothing is published; ``update`` tries again. Without it the snapshot stands for itself and
    takes the next free version.
    """
    spark = df.sparkSession
    if base is not None and _latest(spark, root, name)[0] != base:
        raise PublishConflict(f"{name} is no longer at version {base}")
    folder = f"{name}/data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    version = base
    while True:
        version = (_latest(spark, root, name)[0] if version is None else version) + 1
        if _claim(spark, root, name, version, folder):
            return version
        if base is not None:
            raise PublishConflict(f"version {version} of {name} was published meanwhile")
        version = None


def update(
    spark: SparkSession, root: str, name: str, schema: StructType, change: Callable[[DataFrame], DataFrame], attempts: int = 10
) -> int:
    """Publish ``change`` of the current snapshot, made anew from the newer one as often as someone else was first."""
    for _ in range(attempts):
        base = _latest(spark, root, name)[0]
        try:
            return publish(change(current(spark, root, name, schema)), root, name, base)
        except PublishConflict:
            continue
    raise PublishConflict(f"{name} was published by others {attempts} times in a row")


def current(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """The current snapshot of table ``name``; empty before the first one."""
    folder = _latest(spark, root, name)[1]
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def put_candidates(new: DataFrame, old: DataFrame, root: str) -> DataFrame:
    """Publish candidates with ``new`` bodies put in; returns the refused ones (E42).

    A body is only ever put into a candidate without changes. Clearing a candidate is
    putting an empty body, which is always allowed. ``old`` is what the caller knows; where others edit the
    same candidates, ``edit_candidates`` starts from what is current.
    """
    settled, refused = _put(new, old)
    publish(settled, root, "candidates")
    return refused


def edit_candidates(new: DataFrame, root: str) -> DataFrame:
    """As ``put_candidates`` on the current candidates, whoever else publishes; returns the refused ones (E42)."""
    refused = []

    def change(old: DataFrame) -> DataFrame:
        settled, out = _put(new, old)
        refused[:] = [out]
        return settled

    update(new.sparkSession, root, "candidates", CANDIDATES, change)
    return refused[0]


def _put(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    incoming = new.select("chain_id", F.col("body").alias("_new"))
    both = old.join(incoming, "chain_id", "full_outer")
    refused = (
        F.col("_new").isNotNull() & has_changes("_new")
        & F.coalesce(has_changes("body"), F.lit(False))
    )
    settled = both.select(
        "chain_id",
        F.when(refused, F.col("body")).otherwise(F.coalesce("_new", "body")).alias("body"),
    )
    return settled, both.where(refused).select("chain_id", F.lit("E42").alias("error_code"))


def read_bindings(
    spark: SparkSession,
    path: str,
    format: str = "json",
    variables: Mapping[str, str] | None = None,
) -> DataFrame:
    """Bindings with ``${...}`` in their values filled in from ``variables``.

    ``error_code`` holds what is wrong with a value; names are checked by
    ``scripts.invalid_bindings``.
    """
    rows = spark.read.schema(BINDINGS).format(format).load(path)
    pairs = [F.lit(part) for pair in (variables or {}).items() for part in pair]
    known = F.create_map(*pairs).cast("map<string,string>")
    return rows.withColumn("filled", interpolate("value", known)).select(
        "chain_id", "name", F.col("filled.value").alias("value"), "filled.error_code"
    )


def identifier_violations(names: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may not be used as an identifier (E63)."""
    return names.where(~F.coalesce(is_identifier(column), F.lit(False))).withColumn(
        "error_code", F.lit("E63")
    )
