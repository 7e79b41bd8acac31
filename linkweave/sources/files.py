"""Folders of projects: ``<root>/<chain_id>/{committed/*.sql, current.sql, fixtures/**}``.

Tasks list and read the files; each file is one row, its text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linkweave.functions.headers import parse_change, render_change
from linkweave.functions.text import parse_version, version_filename
from linkweave.operators.violations import violation_rows
from linkweave.schemas import CANDIDATES, SNIPPETS, STAMPS
from linkweave.session import cut_lineage
from linkweave.sources.listing import (
    folder_faults, project_files, project_folders, read_contents, stamps_below, stamps_of_roots, tops_of_roots,
)


def _text() -> list[Column]:
    """``text``, null where the bytes are not UTF-8."""
    text = F.col("content").cast("string")
    return [F.when(F.is_valid_utf8(text), text).alias("text")]


def _project_texts(spark: SparkSession, root: str, name: str, **options) -> DataFrame:
    """``chain_id, inside, text`` of the files of ``name`` in every project."""
    found = read_contents(project_files(project_folders(spark, root), name, **options))
    return found.select("chain_id", "inside", *_text())


def scan_changes(spark: SparkSession, root: str) -> DataFrame:
    """Committed files ``(chain_id, filename, text)``; sub-folders are not entered."""
    found = _project_texts(spark, root, "committed", suffix=".sql")
    return found.select("chain_id", F.element_at(F.split("inside", "/"), -1).alias("filename"), "text")


def parse_changes(files: DataFrame) -> DataFrame:
    """Scanned files with the parsed columns and the error code of the parse, if any."""
    parsed = files.withColumn("parsed", parse_change("text"))
    version = parse_version("filename")
    return parsed.select(
        "chain_id",
        version.alias("version"),
        "filename",
        "parsed.previous_hash",
        "parsed.hash",
        "parsed.body",
        F.when(version.isNull(), "E01")
        .when(F.col("text").isNull(), "E02")
        .otherwise(F.col("parsed.error_code"))
        .alias("error_code"),
    )


def change_log(parsed: DataFrame) -> DataFrame:
    """The sound rows of ``parse_changes`` as a change log."""
    return parsed.where(F.col("error_code").isNull()).drop("error_code")


def parse_violations(parsed: DataFrame) -> DataFrame:
    """The faulty rows of ``parse_changes`` as violations."""
    return violation_rows(
        parsed.where(F.col("error_code").isNotNull()),
        code=F.col("error_code"),
        chain_id=F.col("chain_id"),
        version=F.col("version"),
        filename=F.col("filename"),
    )


def rendered_changes(changes: DataFrame) -> DataFrame:
    """``(chain_id, filename, text)`` of change rows: what their files hold."""
    text = render_change(F.col("previous_hash"), F.col("hash"), F.col("body"))
    return changes.select("chain_id", version_filename("version").alias("filename"), text.alias("text"))


def write_change_table(changes: DataFrame, out: str) -> None:
    """Rendered changes as one Parquet table, for logs of any size; read it as ``(chain_id, filename, text)``."""
    rendered_changes(changes).write.parquet(out)


def export_files(rows: DataFrame, root: str) -> int:
    """Write ``(path, text)`` rows as files below ``root``, each where its path says; how many.

    For projects that tools are to open: a file per row, written by the tasks. A task that
    runs again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = rows.select("path", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_changes(changes: DataFrame, out: str) -> None:
    """Rendered change files, one per change; see ``write_change_table`` for large logs.

    Spark names the files, so the folders say which change it is.
    """
    text = render_change(F.col("previous_hash"), F.col("hash"), F.col("body"))
    (
        changes.select("chain_id", "version", F.regexp_replace(text, r"\n\z", "").alias("value"))
        .repartition("chain_id", "version")
        .write.partitionBy("chain_id", "version")
        .mode("overwrite")
        .text(out)
    )


def read_written_changes(spark: SparkSession, out: str) -> DataFrame:
    """Files of ``write_changes`` as ``(chain_id, filename, text)``."""
    return (
        spark.read.schema("value string, chain_id bigint, version int")
        .text(out, wholetext=True)
        .select(
            "chain_id",
            version_filename("version").alias("filename"),
            F.col("value").alias("text"),
        )
    )


def read_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The candidate of each chain, whole."""
    found = _project_texts(spark, root, "current.sql")
    return found.where(F.col("inside") == "current.sql").select("chain_id", F.col("text").alias("body")).to(CANDIDATES)


def folder_violations(spark: SparkSession, root: str) -> DataFrame:
    """E02 where there is no ``committed`` folder, E38 where candidates are in a folder."""
    return violation_rows(
        folder_faults(spark, root),
        code=F.col("error_code"),
        chain_id=F.col("chain_id"),
        filename=F.col("filename"),
    )


def scan_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Fragments below ``fixtures``, with their path inside the project."""
    found = _project_texts(spark, root, "fixtures", recursive=True)
    return found.where(F.col("inside").startswith("fixtures/")).select("chain_id", F.col("inside").alias("path"), "text").to(SNIPPETS)


def scan_stamps(spark: SparkSession, roots: list[str], snapshot_id: int) -> DataFrame:
    """Path, change time and size of all files below a few ``roots``; contents are not read. See ``scan_stamps_of``.

    Tasks list, as there, but what Spark's file sources pass over has no row unless it is empty, links are followed to files
    that are not, and a root that is named again gives these again. What is right in the roots is stored, so it is listed once.
    """
    named = [(root, root not in roots[:i]) for i, root in enumerate(roots)]
    tops = cut_lineage(tops_of_roots(spark.createDataFrame(named, "root string, first boolean")), "tops")
    printed = F.when(F.col("path").startswith("/"), F.concat(F.lit("file:"), "path")).otherwise(F.col("path"))
    found = stamps_below(tops).where("(size > 0 and not hidden) or (size = 0 and first and not linked)")
    return _as_stamps(found.select(printed.alias("path"), "modified_ms", "size"), snapshot_id)


def scan_stamps_of(roots: DataFrame, snapshot_id: int) -> DataFrame:
    """The same below every ``root`` of a table, listed by tasks: one plan for any number of roots.

    Null roots are passed over, roots without files give no rows, repeated roots count once; a file below two
    roots has one row. Symbolic links are not followed. Other columns are not read.
    """
    listed = stamps_of_roots(roots).groupBy("path").agg(F.max("modified_ms").alias("modified_ms"), F.max_by("size", "modified_ms").alias("size"))
    return _as_stamps(listed, snapshot_id)


def _as_stamps(found: DataFrame, snapshot_id: int) -> DataFrame:
    return found.select(F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), "path", "modified_ms", "size").to(STAMPS)
