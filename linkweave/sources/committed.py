"""Change files written whole or not at all: ``<root>/<chain>/committed/<six digits>.sql``.

A commit has three steps, each of them a Spark job over the rows or over what the step before left:

1. tasks write every file below a staging folder, whose name readers skip; a file that is there already with
   another text stops the commit;
2. a ready mark is written: from here on the commit counts;
3. tasks move the files into place, and the staging folder goes.

A failure before the mark leaves nothing but a staging folder, which is removed at once, or by ``recover_commits`` if
the driver was lost. After the mark ``recover_commits`` finishes the moves; moving again what is moved does no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkweave.sources.files import rendered_changes

_STAGING = "_staging"
_READY = "_ready"


class CommitRefused(ValueError):
    """A change file is there already with another text."""


def commit_changes(changes: DataFrame, root: str) -> int:
    """Write the files of all ``changes``; how many there are. Files that are there with the same text stay."""
    spark, stage = changes.sparkSession, f"{root.rstrip('/')}/{_STAGING}/{uuid.uuid4().hex}"
    named = rendered_changes(changes).select(
        F.concat_ws("/", F.col("chain_id").cast("string"), F.lit("committed"), "filename").alias("path"), "text"
    )
    try:
        written = named.mapInArrow(lambda batches: _stage(batches, root, stage), "n bigint, conflicts bigint, example string")
        n, conflicts, example = written.agg(F.sum("n"), F.sum("conflicts"), F.min("example")).first()
        if conflicts:
            raise CommitRefused(f"{conflicts} change files are there with another text, {example} among them")
    except BaseException:
        _remove(stage)
        raise
    if not n:
        _remove(stage)
        return 0
    system, base = fs.FileSystem.from_uri(stage)
    with system.open_output_stream(f"{base}/{_READY}"):
        pass
    _move(spark, root, stage)
    return n


def recover_commits(spark: SparkSession, root: str) -> int:
    """Finish the commits that are marked ready and remove the others; how many were finished. To be called when none runs."""
    system, base = fs.FileSystem.from_uri(root)
    finished = 0
    for info in system.get_file_info(fs.FileSelector(f"{base}/{_STAGING}", allow_not_found=True)):
        stage = f"{root.rstrip('/')}/{_STAGING}/{info.base_name}"
        if system.get_file_info(f"{info.path}/{_READY}").type == fs.FileType.File:
            _move(spark, root, stage)
            finished += 1
        else:
            _remove(stage)
    return finished


def _stage(batches: Iterator[pa.RecordBatch], root: str, stage: str) -> Iterator[pa.RecordBatch]:
    """Write texts below ``stage``, one sub-folder per chain; count them and the conflicts with what is in place."""
    system, base = fs.FileSystem.from_uri(root)
    staged = fs.FileSystem.from_uri(stage)[1]
    for batch in batches:
        conflicts, example = 0, None
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode()
            if system.get_file_info(f"{base}/{path}").type == fs.FileType.File:
                with system.open_input_stream(f"{base}/{path}") as there:
                    if there.readall() != data:
                        conflicts, example = conflicts + 1, path
            target = f"{staged}/{path}"
            system.create_dir(target.rpartition("/")[0], recursive=True)
            with system.open_output_stream(target) as out:
                out.write(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.num_rows], pa.int64()), pa.array([conflicts], pa.int64()), pa.array([example], pa.string())],
            names=["n", "conflicts", "example"],
        )


def _move(spark: SparkSession, root: str, stage: str) -> None:
    """Move what is staged into place, a chain at a time in a task, then remove the staging folder."""
    listed = spark.createDataFrame([(stage,)], "folder string").mapInArrow(_chains, "chain string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed.repartition(parts, "chain").mapInArrow(lambda batches: _place(batches, root, stage), "n bigint").agg(F.sum("n")).first()
    _remove(stage)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("folder").to_pylist():
            system, base = fs.FileSystem.from_uri(uri)
            found = [i.base_name for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["chain"])


def _place(batches: Iterator[pa.RecordBatch], root: str, stage: str) -> Iterator[pa.RecordBatch]:
    system, base = fs.FileSystem.from_uri(root)
    staged = fs.FileSystem.from_uri(stage)[1]
    for batch in batches:
        moved = 0
        for chain in batch.column("chain").to_pylist():
            folder = f"{chain}/committed"
            system.create_dir(f"{base}/{folder}", recursive=True)
            for info in system.get_file_info(fs.FileSelector(f"{staged}/{folder}", allow_not_found=True)):
                system.move(info.path, f"{base}/{folder}/{info.base_name}")
                moved += 1
        yield pa.RecordBatch.from_arrays([pa.array([moved], pa.int64())], names=["n"])


def _remove(stage: str) -> None:
    system, base = fs.FileSystem.from_uri(stage)
    if system.get_file_info(base).type == fs.FileType.Directory:
        system.delete_dir(base)
    above = base.rpartition("/")[0]
    if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
        system.delete_dir(above)
